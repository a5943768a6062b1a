"""HTML elements to Markdown lines, and web pages to notes."""

from __future__ import annotations

import base64
import re
from urllib.parse import unquote_to_bytes

from ..functions.entities import decode_entities, decode_text
from .html_tree import Element, parse_html
from .lines import SPACES, WS, escape_inline, fence, heading, join_blocks, table, titled

#: Element sets, image types, selectors of a page's content, its least length, and the cap of spans.
IGNORED = set("script style noscript template svg canvas iframe object embed video audio map area input button select option textarea label link meta base title".split())
BLOCK = set("address article aside blockquote body center details div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
WHOLE = set("table ul ol dl pre blockquote h1 h2 h3 h4 h5 h6".split())
IMAGE_TYPES = {"image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/bmp": "bmp", "image/tiff": "tiff", "image/svg+xml": "svg", "image/avif": "avif"}
CONTENT_IDS, CONTENT_CLASSES, LEAST_CONTENT, MOST_SPAN = {"content", "main", "main-content"}, {"post-content", "entry-content", "article-body", "markdown-body"}, 200, 100


class Renderer:
    """``images``: source to embed; ``href``: rewrites a link's target, None drops the link; ``missing``: sources without an embed."""

    def __init__(self, images: dict[str, str] | None = None, href=None):
        self.images, self.href, self.missing = images or {}, href or (lambda x: x), []

    def lines(self, root: Element) -> list[str]:
        out: list[str] = []
        if root.tag in WHOLE:
            self.block(root, out)
        else:
            self.children(root, out)
        return out

    def children(self, parent: Element, out: list[str]) -> None:
        run: list = []

        def flush() -> None:
            text = self.inline(run).strip(WS)
            run.clear()
            if text:
                out.extend([text, ""])

        for c in parent.children:
            if isinstance(c, Element) and c.tag in IGNORED:
                continue
            if isinstance(c, Element) and c.tag in BLOCK:
                flush()
                self.block(c, out)
            else:
                run.append(c)
        flush()

    def block(self, e: Element, out: list[str]) -> None:
        t = e.tag
        if re.fullmatch("h[1-6]", t):
            text = SPACES.sub(" ", self.inline(e.children).replace("\n", " ")).strip(WS)
            if text:
                out.extend([heading(int(t[1]), text), ""])
        elif t == "hr":
            out.extend(["---", ""])
        elif t == "pre":
            code = e.text()
            inner = next(e.all("code"), e)
            m = re.search(r"(?:language|lang|highlight)-([\w+#-]+)", inner.attrs.get("class", "") + " " + e.attrs.get("class", ""), re.A)
            out.extend(["\n".join(fence(code, m[1] if m else "")), ""])
        elif t == "blockquote":
            out.extend([("> " + x) if x else ">" for x in _trimmed(self.lines_of(e))] + [""])
        elif t in ("ul", "ol"):
            out.extend([*self.list(e), ""])
        elif t == "table":
            out.extend([*self.table(e), ""])
        elif t == "dl":
            for c in e.children:
                if isinstance(c, Element) and c.tag == "dt":
                    text = self.inline(c.children).strip(WS)
                    if text:
                        out.append("- " + _wrap(text, "**"))
                elif isinstance(c, Element) and c.tag == "dd":
                    out.extend("  " + x if x else "" for x in _trimmed(self.lines_of(c)))
            out.append("")
        elif t in ("figcaption", "summary"):
            text = self.inline(e.children).strip(WS)
            if text:
                out.extend([_wrap(text, "*" if t == "figcaption" else "**"), ""])
        else:
            self.children(e, out)
            out.append("")

    def lines_of(self, e: Element) -> list[str]:
        out: list[str] = []
        self.children(e, out)
        return out

    def list(self, e: Element) -> list[str]:
        out, k = [], int(e.attrs["start"]) if re.fullmatch(r"-?\d+", e.attrs.get("start", "")) else 1
        for c in e.children:
            if not (isinstance(c, Element) and c.tag == "li"):
                continue
            mark = f"{k}." if e.tag == "ol" else "-"
            k += 1
            inner = _trimmed(self.lines_of(c))
            inner = [x for j, x in enumerate(inner) if x or not (j + 1 < len(inner) and re.match(r"\s*(-|\d+\.) ", inner[j + 1]))]
            if inner:
                pad = " " * (len(mark) + 1)
                out.append(f"{mark} {inner[0]}")
                out.extend(pad + x if x else "" for x in inner[1:])
        return out

    def table(self, e: Element) -> list[str]:
        rows: list[list[str]] = []
        held: dict[int, int] = {}
        for tr in _rows(e):
            row: list[str] = []

            def skip(row=row) -> None:
                while held.get(len(row), 0) > 0:
                    held[len(row)] -= 1
                    row.append("")

            for cell in tr.children:
                if not (isinstance(cell, Element) and cell.tag in ("td", "th")):
                    continue
                skip()
                text = SPACES.sub(" ", self.inline(cell.children).replace("\n", "<br>")).strip(WS)
                down = _span(cell, "rowspan")
                for j in range(_span(cell, "colspan")):
                    held[len(row)] = down - 1
                    row.append(text if j == 0 else "")
            skip()
            if row:
                rows.append(row)
        return table(rows)

    def inline(self, nodes: list) -> str:
        out = []
        for n in nodes:
            if isinstance(n, str):
                out.append(escape_inline(SPACES.sub(" ", n)))
            elif n.tag not in IGNORED:
                out.append(self.element(n))
        return "".join(out)

    def element(self, e: Element) -> str:
        t = e.tag
        if t == "br":
            return "\n"
        if t == "img":
            return self.image(e)
        if t in ("code", "kbd", "samp", "tt"):
            code = SPACES.sub(" ", e.text()).strip(WS)
            if not code:
                return ""
            mark = "`" * (1 + max(map(len, re.findall("`+", code)), default=0))
            pad = " " if code[0] == "`" or code[-1] == "`" else ""
            return mark + pad + code + pad + mark
        text = self.inline(e.children)
        if t == "a":
            if any(True for _ in e.all("img")) or not text.strip(WS):
                return text if text.strip(WS) else ""
            target = e.attrs.get("href", "").strip(WS)
            target = None if not target or target.lower().startswith("javascript:") else self.href(target)
            return text if not target else f"[{text.strip(WS)}]({'<' + target + '>' if re.search(r'[\s()]', target) else target})"
        marks = {"strong": "**", "b": "**", "em": "*", "i": "*", "cite": "*", "var": "*", "dfn": "*", "del": "~~", "s": "~~", "strike": "~~", "mark": "=="}
        if t in marks:
            return _wrap(text, marks[t])
        if t in ("sup", "sub"):
            return f"<{t}>{text}</{t}>" if text.strip(WS) else ""
        return f"“{text}”" if t == "q" else text

    def image(self, e: Element) -> str:
        src, alt = e.attrs.get("src", "").strip(WS), SPACES.sub(" ", e.attrs.get("alt", "")).strip(WS)
        if src in self.images:
            return self.images[src]
        if src:
            self.missing.append(src)
        if re.match(r"https?://", src, re.I):
            return f"![{escape_inline(alt)}]({src})"
        return f"*[image: {escape_inline(alt)}]*" if alt else ""


def _wrap(text: str, mark: str) -> str:
    core = text.strip(WS)
    if not core:
        return text
    at = text.index(core)
    return text[:at] + mark + core + mark + text[at + len(core) :]


def _trimmed(lines: list[str]) -> list[str]:
    a, b = 0, len(lines)
    while a < b and not lines[a].strip(WS):
        a += 1
    while b > a and not lines[b - 1].strip(WS):
        b -= 1
    out: list[str] = []
    for x in lines[a:b]:
        if x.strip(WS) or (out and out[-1]):
            out.append(x if x.strip(WS) else "")
    return out


def _rows(e: Element):
    for c in e.children:
        if isinstance(c, Element):
            if c.tag == "tr":
                yield c
            elif c.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(c)


def _span(cell: Element, name: str) -> int:
    m = re.match(r"\s*(\d+)", cell.attrs.get(name, ""))
    return min(max(int(m[1]), 1), MOST_SPAN) if m else 1


def text_length(e: Element) -> int:
    return len(SPACES.sub(" ", e.text()).strip(WS))


def main_content(doc: Element) -> tuple[Element, list[tuple[str, int]]]:
    """The page's content and (tag, words) of the furniture taken out of it."""
    body = next((c for c in doc.children if isinstance(c, Element) and c.tag == "body"), doc)
    articles = list(doc.all("article"))
    found = next(doc.all("main"), None) or next((e for e in doc.walk() if e.attrs.get("role") == "main"), None)
    found = found or (articles[0] if len(articles) == 1 else None)
    found = found or next((e for e in doc.walk() if e.attrs.get("id") in CONTENT_IDS or CONTENT_CLASSES & set(e.attrs.get("class", "").split())), None)
    root = found if found is not None and text_length(found) >= LEAST_CONTENT else body
    dropped = []
    for e in list(root.all("nav", "header", "footer", "aside")):
        if e.parent and any(p is root for p in _up(e)):
            words = len(e.text().split())
            if words:
                dropped.append((e.tag, words))
            e.parent.children.remove(e)
            e.parent = None
    return root, dropped


def _up(e: Element):
    while e.parent:
        e = e.parent
        yield e


def data_uri(src: str) -> tuple[bytes, str] | None:
    m = re.match(r"data:([^;,]*)((?:;[^;,]*)*),(.*)", src, re.S)
    ext = IMAGE_TYPES.get(m[1].strip().lower()) if m else None
    if not ext:
        return None
    return (base64.b64decode(re.sub(r"[^A-Za-z0-9+/]", "", m[3]) + "===") if ";base64" in m[2].lower() else unquote_to_bytes(m[3])), ext


def _meta(doc: Element, *names: str) -> str | None:
    for name in names:
        for e in doc.all("meta"):
            if name in (e.attrs.get("property"), e.attrs.get("name")) and e.attrs.get("content", "").strip(WS):
                return e.attrs["content"].strip(WS)
    return None


def read_html(data: bytes, save=lambda data, ext: None) -> dict:
    """A web page as markdown, warnings and ordered front matter."""
    head = data[:4096].decode("latin-1")
    m = re.search(r"<meta[^>]+charset\s*=\s*[\"']?\s*([\w-]+)", head, re.I | re.A) or re.search(r"<\?xml[^>]+encoding\s*=\s*[\"']([\w-]+)", head, re.I | re.A)
    doc = parse_html(decode_text(data, m[1] if m else None))
    title = next((SPACES.sub(" ", decode_entities(e.text())).strip(WS) for e in doc.all("title")), None) or next((SPACES.sub(" ", e.text()).strip(WS) for e in doc.all("h1")), None) or None
    link = next((e.attrs.get("href", "").strip(WS) for e in doc.all("link") if "canonical" in e.attrs.get("rel", "").lower().split()), None)
    front = [("title", title), ("url", _meta(doc, "og:url") or link), ("author", _meta(doc, "author", "article:author")), ("published", _meta(doc, "article:published_time", "date"))]
    root, dropped = main_content(doc)
    images, shown = {}, []
    for e in root.all("img"):
        src = e.attrs.get("src", "").strip(WS)
        if src and src not in images and (found := data_uri(src)) and (embed := save(*found)):
            images[src] = embed
    r = Renderer(images)
    shown = titled(r.lines(root), title)
    warnings = []
    if dropped:
        warnings.append("Left out page furniture: " + ", ".join(f"{t} ({n} words)" for t, n in dropped))
    remote = list(dict.fromkeys(s for s in r.missing if re.match(r"https?://", s, re.I)))
    local = list(dict.fromkeys(s for s in r.missing if not re.match(r"https?://", s, re.I)))
    if remote:
        warnings.append(f"{len(remote)} remote image(s) are links")
    if local:
        warnings.append("Images not kept: " + ", ".join(s[:80] for s in local[:5]) + ("…" if len(local) > 5 else ""))
    return {"markdown": join_blocks(shown), "warnings": warnings, "frontmatter": [(k, v) for k, v in front if v]}
