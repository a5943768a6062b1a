"""Word documents to Markdown: paragraphs, lists and tables of the body in order."""

from __future__ import annotations

import re

from .html_render import _wrap
from .lines import WS, escape_inline, heading, join_blocks, squash, table
from .package import Package, attr, every, image, kid, kids, tag

MAIN = "word/document.xml"


def read_docx(data: bytes, save=lambda data, ext: None) -> dict:
    package = Package(data)
    root = package.xml(MAIN)
    if root is None:
        raise ValueError("no document part")
    doc = _Document(package, save)
    out: list[str] = []
    for e in kid(root, "body") if kid(root, "body") is not None else ():
        if tag(e) == "p":
            out.extend(doc.paragraph(e))
        elif tag(e) == "tbl":
            rows = [["\n".join(t for p in kids(c, "p") if (t := doc.runs(p).strip(WS))) for c in kids(r, "tc")] for r in kids(e, "tr")]
            out.extend(["", *table(rows), ""])
    warnings = [f"{doc.lost} image(s) could not be kept"] if doc.lost else []
    return {"markdown": join_blocks(out), "warnings": warnings, "frontmatter": []}


class _Document:
    def __init__(self, package: Package, save):
        self.package, self.save, self.rels, self.lost = package, save, package.rels(MAIN), 0
        numbering = package.xml("word/numbering.xml")
        levels = {attr(a, "abstractNumId"): {attr(v, "ilvl"): attr(kid(v, "numFmt"), "val", "") for v in kids(a, "lvl") if kid(v, "numFmt") is not None} for a in kids(numbering, "abstractNum")}
        self.formats = {attr(n, "numId"): levels.get(attr(kid(n, "abstractNumId"), "val"), {}) for n in kids(numbering, "num") if kid(n, "abstractNumId") is not None}

    def paragraph(self, p) -> list[str]:
        text = self.runs(p).strip(WS)
        if not text:
            return [""]
        props = kid(p, "pPr")
        style = kid(props, "pStyle")
        style = attr(style, "val", "") if style is not None else ""
        m = re.fullmatch(r"heading\s*([0-9])", style, re.I)
        level = {"title": 1, "subtitle": 2}.get(style.lower()) or (int(m[1]) if m else None)
        if level:
            return ["", heading(level, text.replace("\n", " ")), ""]
        number = kid(props, "numPr", "numId")
        if number is not None and attr(number, "val", "0") != "0":
            at = kid(props, "numPr", "ilvl")
            depth = attr(at, "val", "0") if at is not None else "0"
            ordered = self.formats.get(attr(number, "val"), {}).get(depth, "bullet") not in ("bullet", "none")
            return ["  " * int(depth) + ("1. " if ordered else "- ") + text]
        return ["", text, ""]

    def runs(self, parent) -> str:
        out = []
        for e in parent:
            t = tag(e)
            if t == "r":
                out.append(self.run(e))
            elif t == "hyperlink":
                text = self.runs(e)
                target = self.rels.get(attr(e, "id", ""), ("", ""))[1] or ("#" + attr(e, "anchor") if attr(e, "anchor") else "")
                out.append(f"[{text}]({target})" if target and text.strip(WS) else text)
            elif t in ("ins", "smartTag", "sdt"):
                out.append(self.runs(e))
        return squash("".join(out))

    def run(self, r) -> str:
        text, embeds = "", ""
        for e in r:
            t = tag(e)
            if t == "t":
                text += escape_inline(e.text or "")
            elif t == "tab":
                text += " "
            elif t in ("br", "cr"):
                text += "\n"
            elif t in ("drawing", "pict", "object"):
                ids = [attr(x, "embed") or attr(x, "id") for x in every(e, "blip", "imagedata")]
                embed = next((m for i in ids if (m := image(self.package, self.rels.get(i, ("", ""))[1], self.save))), None)
                self.lost += embed is None and bool(ids)
                embeds += embed or ""
        for name, mark in (("i", "*"), ("b", "**")):
            on = kid(r, "rPr", name)
            if on is not None and attr(on, "val", "1").lower() not in ("0", "false", "off"):
                text = _wrap(text, mark)
        return text + embeds
