"""Notebooks (formats 3 and 4) to notes."""

from __future__ import annotations

import base64
import json
import re

from ..functions.entities import decode_text
from .html_render import Renderer
from .html_tree import parse_html
from .lines import WS, escape_inline, fence, heading, join_blocks

_ANSI = re.compile(r"\x1b\[[0-9;?]*[ -/]*[@-~]")
#: The third format's short output names, and image types in order of preference.
_SHORT = {"text": "text/plain", "html": "text/html", "svg": "image/svg+xml", "png": "image/png", "jpeg": "image/jpeg", "latex": "text/latex"}
_IMAGES = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/svg+xml": "svg"}


def text_of(v) -> str:
    return v if isinstance(v, str) else "".join(x for x in v if isinstance(x, str)) if isinstance(v, list) else ""


def _record(v) -> dict:
    return v if isinstance(v, dict) else {}


class _Notebook:
    def __init__(self, save):
        self.save, self.unsaved, self.dropped, self.language = save, 0, set(), ""

    def image(self, value, mime: str) -> str | None:
        data = text_of(value)
        raw = data.encode() if mime == "image/svg+xml" else base64.b64decode(re.sub(r"[^A-Za-z0-9+/]", "", data) + "===")
        return self.save(raw, _IMAGES[mime])

    def bundle(self, b: dict) -> list[str]:
        for mime in _IMAGES:
            if mime in b:
                if embed := self.image(b[mime], mime):
                    return [embed]
                self.unsaved += 1
                break
        if said := text_of(b.get("text/markdown")).strip(WS):
            return [said]
        if "text/html" in b:
            doc = parse_html(text_of(b["text/html"]))
            lines = Renderer().lines(next(doc.all("body"), doc))
            if any(x.strip(WS) for x in lines):
                return lines
        if text_of(b.get("text/plain")).strip(WS):
            return fence(_ANSI.sub("", text_of(b["text/plain"])))
        self.dropped.update(k for k in b if k != "text/plain")
        return []

    def output(self, o: dict) -> list[str]:
        kind = o.get("output_type")
        if kind == "stream":
            text = _ANSI.sub("", text_of(o.get("text")))
            label = ["*stderr:*", ""] if "stderr" in (o.get("name"), o.get("stream")) else []
            return [*label, *fence(text)] if text.strip(WS) else []
        if kind in ("error", "pyerr"):
            trace = _ANSI.sub("", "\n".join(x for x in o.get("traceback") or [] if isinstance(x, str)))
            said = f"**{escape_inline(text_of(o.get('ename')))}: {escape_inline(text_of(o.get('evalue')))}**"
            return [said, "", *(fence(trace) if trace.strip(WS) else [])]
        if kind in ("execute_result", "display_data", "pyout"):
            data = _record(o.get("data")) or {_SHORT[k]: v for k, v in o.items() if k in _SHORT}
            return self.bundle(data)
        self.dropped.add(str(kind))
        return []

    def cell(self, c: dict) -> list[str]:
        kind, source = c.get("cell_type"), text_of(c.get("source", c.get("input")))
        if kind == "markdown":
            for name, found in _record(c.get("attachments")).items():
                mime = next((m for m in _IMAGES if m in _record(found)), None)
                embed = self.image(found[mime], mime) if mime else None
                if embed:
                    source = re.sub(rf"!\[[^\]]*\]\(attachment:{re.escape(name)}\)", lambda _, e=embed: e, source)
                else:
                    self.unsaved += 1
            return [source.strip(WS), ""]
        if kind == "heading":
            return [heading(int(c.get("level", 1)), escape_inline(source.strip(WS))), ""]
        out = ["\n".join(fence(source, self.language if kind == "code" else "")), ""] if source.strip(WS) else []
        for o in c.get("outputs") or [] if kind == "code" else []:
            out += ["\n".join(x) if x and x[0].startswith("`") else "\n\n".join(y for y in x if y) for x in [self.output(_record(o))] if x] + [""]
        return out


def read_notebook(data: bytes, save=lambda data, ext: None) -> dict:
    book = json.loads(decode_text(data))
    if not isinstance(book, dict):
        raise ValueError("not a notebook")
    cells = book.get("cells")
    if not isinstance(cells, list):
        cells = [c for w in book.get("worksheets") or [] for c in _record(w).get("cells") or []]
    if not cells:
        raise ValueError("the notebook has no cells")
    meta = _record(book.get("metadata"))
    kernel, info = _record(meta.get("kernelspec")), _record(meta.get("language_info"))
    n = _Notebook(save)
    n.language = str(info.get("name") or kernel.get("language") or kernel.get("name") or "").lower()
    lines = [x for c in cells for x in n.cell(_record(c))]
    warnings = []
    if n.unsaved:
        warnings.append(f"{n.unsaved} image(s) not kept")
    if n.dropped:
        warnings.append("Output types not converted: " + ", ".join(sorted(n.dropped)))
    front = [("cells_converted", f"{len(cells)}/{len(cells)}"), ("kernel", kernel.get("display_name")), ("language", n.language)]
    return {"markdown": join_blocks(lines), "warnings": warnings, "frontmatter": [(k, str(v)) for k, v in front if v]}
