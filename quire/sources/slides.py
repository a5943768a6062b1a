"""Slide decks to Markdown: a heading a slide, its pictures, tables, text and notes."""

from __future__ import annotations

from .html_render import _wrap
from .lines import SPACES, WS, escape_inline, join_blocks, squash, table
from .package import Package, attr, every, image, kid, kids, tag

MAIN = "ppt/presentation.xml"


def read_pptx(data: bytes, save=lambda data, ext: None) -> dict:
    package = Package(data)
    root, rels = package.xml(MAIN), package.rels(MAIN)
    if root is None:
        raise ValueError("no presentation part")
    found = [rels.get(attr_id(s), ("", "")) for s in kids(kid(root, "sldIdLst"), "sldId")]
    out, lost, charts = [], 0, 0
    for n, path in enumerate((p for kind, p in found if kind == "slide"), 1):
        slide = package.xml(path)
        if slide is None:
            continue
        body, links, title = [], package.rels(path), ""
        for shape in _shapes(kid(slide, "cSld", "spTree")):
            if tag(shape) == "pic":
                embed = next((m for b in every(shape, "blip") if (m := image(package, links.get(attr(b, "embed", ""), ("", ""))[1], save))), None)
                lost += embed is None
                body.extend([embed, ""] if embed else [])
            elif tag(shape) == "graphicFrame":
                grid = next(every(shape, "tbl"), None)
                charts += grid is None
                if grid is not None:
                    body.extend([*table([["\n".join(t for p in kids(kid(c, "txBody"), "p") if (t := _text(p, links))) for c in kids(r, "tc")] for r in kids(grid, "tr")]), ""])
            elif kid(shape, "txBody") is not None:
                kind = _placeholder(shape)
                if kind in ("title", "ctrTitle") and not title:
                    title = SPACES.sub(" ", " ".join(_text(p, links, True) for p in kids(kid(shape, "txBody"), "p"))).strip(WS)
                    continue
                body.extend([*_body(kid(shape, "txBody"), links, kind), ""])
        notes = package.xml(next((p for k, p in links.values() if k == "notesSlide"), None))
        said = [t for s in _shapes(kid(notes, "cSld", "spTree")) if _placeholder(s) == "body" for p in kids(kid(s, "txBody"), "p") if (t := _text(p, links))]
        out.extend([f"## Slide {n}" + (f": {title}" if title else ""), "", *body])
        if said:
            out.extend(["### Notes", "", *(x for t in said for x in (t, ""))])
    warnings = [f"{lost} image(s) could not be kept"] if lost else []
    if charts:
        warnings.append(f"{charts} chart(s) or diagram(s) not converted")
    return {"markdown": join_blocks(out), "warnings": warnings, "frontmatter": []}


def attr_id(e) -> str:
    """The relationship id, not the slide's own."""
    return next((v for k, v in e.attrib.items() if k.endswith("}id")), "")


def _shapes(parent):
    for e in parent if parent is not None else ():
        if tag(e) == "grpSp":
            yield from _shapes(e)
        elif tag(e) in ("sp", "pic", "graphicFrame"):
            yield e


def _placeholder(shape) -> str:
    ph = next(every(shape, "ph"), None)
    return attr(ph, "type", "obj") if ph is not None else ""


def _body(body, links: dict, kind: str) -> list[str]:
    shown = [(p, t) for p in kids(body, "p") if (t := _text(p, links))]
    listed = kind in ("body", "subTitle") or len(kids(body, "p")) > 1
    out: list[str] = []
    for p, text in shown:
        props = kid(p, "pPr")
        if listed and kid(props, "buNone") is None:
            out.append("  " * int(attr(props, "lvl", "0") if props is not None else 0) + "- " + text)
        else:
            out.extend(["", text, ""])
    return out


def _text(p, links: dict, plain: bool = False) -> str:
    out = []
    for r in p:
        if tag(r) == "br":
            out.append(" ")
        if tag(r) not in ("r", "fld"):
            continue
        t, props = kid(r, "t"), kid(r, "rPr")
        text = escape_inline((t.text if t is not None else "") or "")
        if not plain and props is not None:
            for name, mark in (("i", "*"), ("b", "**")):
                text = _wrap(text, mark) if attr(props, name, "0") in ("1", "true") else text
            link = kid(props, "hlinkClick")
            target = links.get(attr_id(link), ("", ""))[1] if link is not None else ""
            text = f"[{text}]({target})" if target and text.strip(WS) else text
        out.append(text)
    return squash("".join(out))
