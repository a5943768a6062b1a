"""MIME trees, mail messages and web archives."""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass, field
from urllib.parse import unquote_to_bytes

from ..functions.entities import decode_text
from .html_render import IMAGE_TYPES, Renderer, main_content
from .html_tree import parse_html
from .lines import SPACES, WS, escape_inline, heading, join_blocks, titled

#: A plain body is a stub under so many characters and this share of the HTML's; depth of forwarded mail.
STUB, SHARE, DEPTH = 200, 0.6, 4


@dataclass
class Part:
    headers: list[tuple[str, str]]
    kind: str
    params: dict[str, str]
    body: bytes
    parts: list[Part] = field(default_factory=list)

    def header(self, name: str) -> str | None:
        return next((decode_header(v) for k, v in self.headers if k == name), None)

    @property
    def disposition(self) -> tuple[str, dict[str, str]]:
        return parameterised(next((v for k, v in self.headers if k == "content-disposition"), ""))

    @property
    def filename(self) -> str | None:
        name = self.disposition[1].get("filename") or self.params.get("name")
        return decode_header(name) if name else None

    @property
    def cid(self) -> str | None:
        v = self.header("content-id")
        return v.strip(WS).strip("<>") if v else None

    def text(self) -> str:
        return decode_text(self.body, self.params.get("charset"))

    def leaves(self) -> list[Part]:
        return [x for p in self.parts for x in p.leaves()] if self.parts else [self]


def split_unquoted(text: str, mark: str) -> list[str]:
    return [m for m in re.findall(rf'((?:"(?:\\.|[^"\\])*"?|[^"{re.escape(mark)}])*)(?:{re.escape(mark)}|$)', text)]


def parameterised(header: str) -> tuple[str, dict[str, str]]:
    """A header's value and parameters, with continued and encoded ones put together."""
    first, *rest = split_unquoted(header, ";")
    raw: dict[str, str] = {}
    for item in rest:
        name, eq, value = item.partition("=")
        value = value.strip(WS)
        if eq and name.strip(WS):
            raw[name.strip(WS).lower()] = re.sub(r"\\(.)", r"\1", value[1:].removesuffix('"')) if value.startswith('"') else value
    out = {k: v for k, v in raw.items() if "*" not in k}
    parts: dict[str, list[tuple[int, bool, str]]] = {}
    for k, v in raw.items():
        if m := re.fullmatch(r"([^*]+)(?:\*(\d+))?(\*?)", k):
            if "*" in k:
                parts.setdefault(m[1], []).append((int(m[2] or 0), bool(m[3]), v))
    for name, found in parts.items():
        found.sort()
        whole, charset = b"", None
        for k, coded, v in found:
            if coded and k == 0 and v.count("'") >= 2:
                charset, _, v = v.split("'", 2)
            whole += unquote_to_bytes(v) if coded else v.encode("latin-1", "replace")
        out[name] = decode_text(whole, charset)
    return first.strip(WS).lower(), out


def decode_header(text: str) -> str:
    def word(m: re.Match) -> str:
        data = base64.b64decode(re.sub(r"[^A-Za-z0-9+/]", "", m[3]) + "===") if m[2].lower() == "b" else quoted_printable(m[3].replace("_", " "))
        return decode_text(data, m[1].split("*")[0])

    text = re.sub(r"(\?=)\s+(?==\?)", r"\1", text)
    return re.sub(r"=\?([^?]+)\?([bBqQ])\?([^?]*)\?=", word, text).strip(WS)


def quoted_printable(body: str) -> bytes:
    body = re.sub(r"[ \t]+(?=\r?\n)", "", body)
    body = re.sub(r"=(?:\r\n|\n|\r)", "", body)
    return re.sub(rb"=([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), body.encode("latin-1", "replace"))


def parse_mime(data: bytes) -> Part:
    return _parse(data.decode("latin-1"))


def _parse(raw: str) -> Part:
    m = re.search(r"\r\n\r\n|\n\n", raw) if not re.match(r"\r?\n", raw) else re.match(r"\r?\n", raw)
    head, body = (raw[: m.start()], raw[m.end() :]) if m else (raw, "")
    headers = [(k.strip(WS).lower(), v.strip(WS)) for line in re.split(r"\r\n|\n", re.sub(r"(?:\r\n|\n)[ \t]+", " ", head)) for k, c, v in [line.partition(":")] if c]
    get = lambda n: next((v for k, v in headers if k == n), "")
    kind, params = parameterised(get("content-type") or "text/plain")
    if kind.startswith("multipart/") and params.get("boundary"):
        return Part(headers, kind, params, b"", [_parse(p) for p in split_multipart(body, params["boundary"])])
    coding = get("content-transfer-encoding").lower()
    data = base64.b64decode(re.sub(r"[^A-Za-z0-9+/]", "", body) + "===") if coding == "base64" else quoted_printable(body) if coding == "quoted-printable" else body.encode("latin-1")
    return Part(headers, kind, params, data)


def split_multipart(body: str, boundary: str) -> list[str]:
    found = list(re.finditer(rf"(?:^|\r\n|\n|\r)--{re.escape(boundary)}(--)?[ \t]*(?=\r|\n|$)", body))
    out = []
    for k, m in enumerate(found):
        if m[1]:
            break
        stop = found[k + 1].start() if k + 1 < len(found) else len(body)
        out.append(re.sub(r"^(?:\r\n|\n|\r)", "", body[m.end() : stop]))
    return out


def describe_size(n: int) -> str:
    return f"{n} B" if n < 1024 else f"{int(n / 1024 + 0.5)} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB"


def choose_body(message: Part) -> tuple[Part | None, Part | None]:
    leaves = [p for p in message.leaves() if p.disposition[0] != "attachment"]
    plain, html = (next((p for p in leaves if p.kind == k), None) for k in ("text/plain", "text/html"))
    if plain and html:
        n, m = len(plain.text().strip(WS)), len(SPACES.sub(" ", parse_html(html.text()).text()).strip(WS))
        return (html, plain) if n < STUB and n < SHARE * m else (plain, html)
    return plain or html, None


def _plain(text: str) -> list[str]:
    return ["\n".join(x if re.match(r"\s*>", x) else escape_inline(x) for x in re.split(r"\r\n|\r|\n", text.strip(WS)))]


def _page(html: str, parts: list[Part], save, furniture: bool) -> tuple[list[str], set, list]:
    doc = parse_html(html)
    root, dropped = main_content(doc) if furniture else (next(doc.all("body"), doc), [])
    by = {f"cid:{p.cid}": p for p in parts if p.cid} | {p.header("content-location"): p for p in parts if p.header("content-location")}
    images, placed = {}, set()
    for e in root.all("img"):
        p = by.get(e.attrs.get("src", "").strip(WS))
        if p is not None and p.kind in IMAGE_TYPES and (embed := save(p.body, IMAGE_TYPES[p.kind])):
            images[e.attrs["src"].strip(WS)] = embed
            placed.add(id(p))
    return Renderer(images).lines(root), placed, dropped


def _message(message: Part, save, warnings: list[str], depth: int) -> list[str]:
    out: list[str] = []
    if depth:
        subject = message.header("subject")
        out += [heading(min(depth + 1, 6), "Forwarded message" + (f": {escape_inline(subject)}" if subject else "")), ""]
        out += [f"**{k.title()}:** {escape_inline(v)}" for k in ("from", "to", "date") if (v := message.header(k))] + [""]
    body, other = choose_body(message)
    placed: set = set()
    if body is not None and body.kind == "text/html":
        lines, placed, _ = _page(body.text(), message.leaves(), save, False)
        out += lines
    elif body is not None:
        out += _plain(body.text())
    else:
        warnings.append("The message has no text body")
    if other is not None:
        warnings.append("The HTML version was converted, as the plain text is a stub" if body.kind == "text/html" else "The plain text was converted; there is an HTML version too")
    named = []
    for p in message.leaves():
        if p is body or p is other or id(p) in placed:
            continue
        if p.kind == "message/rfc822":
            if depth < DEPTH:
                out += ["", *_message(parse_mime(p.body), save, warnings, depth + 1)]
            else:
                warnings.append("A deeper forwarded message was left out")
        elif p.kind in IMAGE_TYPES and (embed := save(p.body, IMAGE_TYPES[p.kind])):
            out += ["", embed]
        elif p.body:
            named.append(f"{p.filename or p.kind} ({describe_size(len(p.body))})")
    if named:
        warnings.append("Attachments not converted: " + ", ".join(named))
    return out


def read_eml(data: bytes, save=lambda data, ext: None) -> dict:
    message, warnings = parse_mime(data), []
    lines = titled(_message(message, save, warnings, 0), message.header("subject"))
    front = [(k, message.header(k)) for k in ("from", "to", "cc", "date", "subject")]
    return {"markdown": join_blocks(lines), "warnings": warnings, "frontmatter": [(k, v) for k, v in front if v]}


def read_mhtml(data: bytes, save=lambda data, ext: None) -> dict:
    message = parse_mime(data)
    page = next((p for p in message.leaves() if p.kind == "text/html"), None)
    if page is None:
        raise ValueError("the archive holds no page")
    lines, _, dropped = _page(page.text(), message.leaves(), save, True)
    warnings = ["Left out page furniture: " + ", ".join(f"{t} ({n} words)" for t, n in dropped)] if dropped else []
    kinds = sorted({p.kind for p in message.leaves() if p is not page and not p.kind.startswith("image/")})
    if kinds:
        warnings.append("Parts not converted: " + ", ".join(kinds))
    url = message.header("snapshot-content-location") or page.header("content-location")
    front = [("url", url), ("saved", message.header("date"))]
    return {"markdown": join_blocks(lines), "warnings": warnings, "frontmatter": [(k, v) for k, v in front if v]}
