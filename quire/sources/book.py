"""E-books to Markdown: chapters in spine order through the HTML renderer."""

from __future__ import annotations

import re

from ..functions.entities import decode_text
from .html_render import Renderer
from .html_tree import Element, parse_html
from .lines import SPACES, WS, escape_inline, join_blocks, opening_heading
from .package import Package, attr, every, image, kid, kids, resolve


def read_epub(data: bytes, save=lambda data, ext: None) -> dict:
    package = Package(data)
    if "META-INF/encryption.xml" in package.names:
        raise ValueError("the book is encrypted")
    path = next((e.get("full-path") for e in every(package.xml("META-INF/container.xml"), "rootfile")), None) or next((n for n in package.names if n.endswith(".opf")), None)
    opf = package.xml(path)
    if opf is None:
        raise ValueError("no package document")
    manifest = {e.get("id"): (resolve(path, e.get("href", "")), e.get("media-type", ""), e.get("properties", "")) for e in kids(kid(opf, "manifest"), "item")}
    spine = [manifest[e.get("idref")] for e in kids(kid(opf, "spine"), "itemref") if e.get("idref") in manifest]
    titles = _contents(package, manifest)
    out, done, missing, lost = [], 0, [], []
    for part, _kind, _props in spine:
        raw = package.read(part)
        if raw is None:
            missing.append(part)
            continue
        root = parse_html(decode_text(raw))
        for e in list(root.all("svg")):
            pictures = list(e.all("image", "img"))
            if pictures and e.parent:
                p = pictures[0]
                new = Element("img", {"src": p.attrs.get("xlink:href") or p.attrs.get("href") or p.attrs.get("src", "")})
                new.parent = e.parent
                e.parent.children[e.parent.children.index(e)] = new
        images = {}
        for e in root.all("img"):
            src = e.attrs.get("src", "").strip(WS)
            if src and src not in images and (m := image(package, resolve(part, src.split("#")[0]), save)):
                images[src] = m
        r = Renderer(images, lambda x: x if re.match(r"(?!file:)[a-z][a-z0-9+.-]*:", x, re.I) else None)
        lines = r.lines(root)
        lost.extend(r.missing)
        if not any(x.strip(WS) for x in lines):
            continue
        done += 1
        if opening_heading(lines) is None and part in titles:
            out.extend([f"# {escape_inline(titles[part])}", ""])
        out.extend([*lines, ""])
    unused = [p for p, kind, props in manifest.values() if "html" in kind and "nav" not in props.split() and p not in {s[0] for s in spine}]
    warnings = [f"{label}: " + ", ".join(names[:5]) + ("…" if len(names) > 5 else "") for label, names in (("Missing files", missing), ("Documents outside the reading order", unused), ("Images not kept", list(dict.fromkeys(lost)))) if names]
    meta = kid(opf, "metadata")
    front = [(key, next(("".join(e.itertext()).strip(WS) for e in kids(meta, name)), "")) for key, name in (("title", "title"), ("author", "creator"), ("publisher", "publisher"), ("language", "language"), ("published", "date"))]
    return {"markdown": join_blocks(out), "warnings": warnings, "frontmatter": [*((k, v) for k, v in front if v), ("chapters_converted", f"{done}/{len(spine)}")]}


def _contents(package: Package, manifest: dict) -> dict[str, str]:
    """Part to its first title, of the navigation document, then of the older table."""
    found: dict[str, str] = {}

    def note(base: str, href: str | None, label: str) -> None:
        label = SPACES.sub(" ", label).strip(WS)
        if href and label:
            found.setdefault(resolve(base, href.split("#")[0]), label)

    for part, _kind, props in manifest.values():
        if "nav" in props.split():
            for a in every(package.xml(part), "a"):
                note(part, attr(a, "href"), "".join(a.itertext()))
    for part, kind, _props in manifest.values():
        if kind == "application/x-dtbncx+xml":
            for p in every(package.xml(part), "navPoint"):
                label, content = kid(p, "navLabel", "text"), kid(p, "content")
                note(part, content.get("src") if content is not None else None, (label.text if label is not None else "") or "")
    return found
