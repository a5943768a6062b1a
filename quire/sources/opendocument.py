"""OpenDocument text, sheets and slides to Markdown; the body's own element says which it is."""

from __future__ import annotations

import base64
import binascii
import re

from .lines import WS, escape_inline, heading, join_blocks, squash, table
from .package import Package, attr, every, kid, kids, resolve, tag

#: The format's generated indexes, its elements without text, and types of images.
INDEXES = ("table-of-content", "illustration-index", "table-index", "object-index", "user-index", "alphabetical-index", "bibliography")
SILENT_BLOCKS = ("tracked-changes", "sequence-decls", "forms", "soft-page-break")
SILENT_MARKS = ("bookmark", "bookmark-start", "bookmark-end", "soft-page-break", "sequence-decls", "annotation")
MIME = {"image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/bmp": "bmp", "image/tiff": "tiff", "image/svg+xml": "svg", "image/avif": "avif"}
VALUES = ("date-value", "time-value", "value", "boolean-value")
#: Cells or rows that one repeat count stands for at most, and spaces.
MOST_REPEATS, MOST_SPACES = 4096, 100


def read_opendocument(data: bytes, save=lambda data, ext: None, hidden: bool = True, keeps: bool = True) -> dict:
    """``hidden``: convert hidden sheets as well.  Errors: no content part, or no body in it."""
    package = Package(data)
    root = package.xml("content.xml")
    if root is None:
        raise ValueError("not an OpenDocument file (no content.xml)")
    body = next(every(root, "body"), None)
    if body is None:
        raise ValueError("this OpenDocument file has no body")
    doc = _Document(package, root, save)
    sheet, deck = kid(body, "spreadsheet"), kid(body, "presentation")
    if sheet is not None:
        lines, said, front = doc.workbook(sheet, hidden)
    elif deck is not None:
        lines, said, front = doc.slides(deck)
    else:
        text = kid(body, "text") if kid(body, "text") is not None else kid(body, "drawing")
        lines, said, front = doc.flow(body if text is None else text), [], []
    if doc.lost:
        said.append(lost_images(doc.lost, keeps))
    if doc.indexes:
        n = len(doc.indexes)
        said.append(f"{n} generated index{'' if n == 1 else 'es'} left out ({', '.join(doc.indexes)})")
    if doc.notes:
        lines += ["", "---", "", *(f"[^{k}]: {note}" for k, note in enumerate(doc.notes, 1))]
    return {"markdown": join_blocks(lines), "warnings": said, "frontmatter": [*_metadata(package), *front]}


def lost_images(n: int, keeps: bool) -> str:
    images = "1 image" if n == 1 else f"{n} images"
    return f"{images} could not be kept (metafiles, mostly)" if keeps else f"{images} left out, as images are not kept"


def _metadata(package: Package) -> list[tuple[str, str]]:
    meta = package.xml("meta.xml")
    said = lambda name: squash(re.sub(r"\s+", " ", "".join(e.itertext()))) if (e := next(every(meta, name), None)) is not None else ""
    return [(k, v) for k, v in (("title", said("title")), ("author", said("initial-creator") or said("creator"))) if v]


def _number(value: str | None, least: int = 1) -> int:
    try:
        n = int(float(value or 1))
    except (ValueError, OverflowError):
        return least
    return max(least, n)


class _Document:
    def __init__(self, package: Package, root, save):
        self.package, self.save = package, save
        self.lost, self.notes, self.indexes = 0, [], []
        self.marks: dict[str, tuple[bool, bool]] = {}  # italic, bold
        self.ordered: dict[str, dict[int, bool]] = {}
        self.hidden: set[str] = set()
        for part in (root, package.xml("styles.xml")):  # automatic styles, then those shared
            for style in every(part, "style"):
                self._style(style)
            for style in every(part, "list-style"):
                levels = self.ordered.setdefault(attr(style, "name", ""), {})
                levels.update({_number(attr(x, "level")): tag(x) == "list-level-style-number" for x in style})

    def _style(self, style) -> None:
        name, family = attr(style, "name"), attr(style, "family")
        if not name:
            return
        if family == "text":
            p = kid(style, "text-properties")
            weight, posture = ("", "") if p is None else (attr(p, "font-weight", ""), attr(p, "font-style", ""))
            self.marks[name] = posture in ("italic", "oblique"), weight not in ("", "normal")
        elif family == "table":
            p = kid(style, "table-properties")
            if p is not None and attr(p, "display") == "false":
                self.hidden.add(name)

    # -- blocks

    def flow(self, parent) -> list[str]:
        """Block elements of a body, cell, text box or note, one after another; unknown ones are looked into."""
        out: list[str] = []
        for e in parent:
            t = tag(e)
            if t in SILENT_BLOCKS:
                continue
            if t == "h":
                text = self.inline(e)
                out += ["", heading(_number(attr(e, "outline-level")), text), ""] if text else []
            elif t == "p":
                text = self.inline(e)
                out += ["", text, ""] if text else []
            elif t == "list":
                out += ["", *self.items(e, 0, None), ""]
            elif t == "table":
                out += ["", *table(_filled([self.cells(r, self.cell) for r in _rows(e)], drop_empty=True)), ""]
            elif t in INDEXES:
                self.indexes.append(attr(e, "name") or t)
            elif t == "text-box":
                out += ["", *self.flow(e), ""]
            elif t in ("frame", "custom-shape", "g"):
                shown = self.frame(e)
                out += ["", *shown, ""] if shown else []
            elif len(e):
                out += self.flow(e)
        return out

    def frame(self, e) -> list[str]:
        """The image of a frame, else its text; charts and embedded objects give nothing."""
        if tag(e) == "text-box":
            return self.flow(e)
        picture = next(every(e, "image"), None)
        if picture is not None:
            embed = self.picture(picture)
            if embed is None:
                self.lost += 1
                return []
            title = next(every(e, "title"), None)
            caption = squash("".join(title.itertext())) if title is not None else ""
            return [embed, f"*{escape_inline(caption)}*"] if caption else [embed]
        box = next(every(e, "text-box"), None)
        return self.flow(box) if box is not None else []

    def picture(self, e) -> str | None:
        href = attr(e, "href")
        if href:
            path = resolve("content.xml", href)
            m = re.search(r"\.([A-Za-z0-9]+)$", path)
            ext = m[1].lower() if m else None
            data = self.package.read(path) if ext and ext not in ("emf", "wmf") else None
            return self.save(data, ext) if data else None
        inside = next(every(e, "binary-data"), None)
        try:
            data = base64.b64decode(re.sub(r"\s+", "", "".join(inside.itertext()))) if inside is not None else b""
        except binascii.Error:
            data = b""
        return self.save(data, MIME.get((attr(e, "mime-type") or "image/png").strip().lower().split(";")[0], "png")) if data else None

    def items(self, e, depth: int, style: str | None) -> list[str]:
        style = attr(e, "style-name") or style
        mark = "1. " if self.ordered.get(style or "", {}).get(depth + 1) else "- "
        out = []
        for item in kids(e, "list-item", "list-header"):
            lead = "  " * depth + mark
            for node in item:
                if tag(node) == "list":
                    out += self.items(node, depth + 1, style)
                elif text := self.inline(node):
                    out.append(lead + text)
                    lead = "  " * (depth + 1)  # a further paragraph of the item
        return out

    def cell(self, e) -> str:
        return "\n".join(x for x in self.flow(e) if x.strip(WS))

    def cells(self, row, show) -> list[str]:
        runs = [("" if tag(c) == "covered-table-cell" else show(c), min(_number(attr(c, "number-columns-repeated")), MOST_REPEATS)) for c in kids(row, "table-cell", "covered-table-cell")]
        while runs and not runs[-1][0].strip(WS):
            runs.pop()
        return [text for text, n in runs for _ in range(n)][:MOST_REPEATS]

    # -- sheets and slides

    def workbook(self, sheet, hidden: bool):
        out, skipped, done = [], [], 0
        tables = kids(sheet, "table")
        for t in tables:
            name = attr(t, "name") or f"Sheet {done + 1}"
            if not hidden and attr(t, "style-name", "") in self.hidden:
                skipped.append(name)
                continue
            rows = _filled([self.cells(r, self.value) for r in _rows(t)])
            out += ["", heading(2, escape_inline(name)), "", *(table(rows) if rows else ["*(empty sheet)*"]), ""]
            done += 1
        return out, [f"Skipped (hidden): {', '.join(skipped)}."] if skipped else [], [("sheets_converted", f"{done}/{len(tables)}")]

    def value(self, c) -> str:
        """What the sheet shows, else the stored value, else a picture over the grid."""
        shown = "\n".join(x for p in kids(c, "p") if (x := self.inline(p)))
        stored = next((v for k in VALUES if (v := attr(c, k))), None)
        return shown or (escape_inline(stored) if stored else " ".join(x for f in kids(c, "frame") for x in self.frame(f)))

    def slides(self, deck):
        out, pages = [], kids(deck, "page")
        for k, page in enumerate(pages, 1):
            shapes = [e for e in page if "drawing" in str(e.tag).split("}")[0] or str(e.tag).startswith("draw:")]
            head = next((e for e in shapes if attr(e, "class") in ("title", "outline-title")), None)
            title = squash(" ".join(self.frame(head))) if head is not None else ""
            out += ["", heading(2, title or f"Slide {k}"), ""]
            for e in shapes:
                if e is not head and (shown := self.frame(e)):
                    out += [*shown, ""]
            said = [x for x in self.flow(kid(page, "notes")) if x.strip(WS)] if kid(page, "notes") is not None else []
            out += ["", "> [!note]- Speaker notes", *(f"> {x}" for x in said), ""] if said else []
        return out, [], [("slides_converted", f"{len(pages)}/{len(pages)}")]

    # -- inline

    def inline(self, e) -> str:
        return self._inline(e, (False, False)).strip(WS)

    def _inline(self, e, marks: tuple[bool, bool]) -> str:
        out = _marked(e.text, marks)
        for c in e:
            out += self._element(c, marks) + _marked(c.tail, marks)
        return out

    def _element(self, c, marks: tuple[bool, bool]) -> str:
        t = tag(c)
        if t == "span":
            own = self.marks.get(attr(c, "style-name", ""), (False, False))
            return self._inline(c, (marks[0] or own[0], marks[1] or own[1]))
        if t == "a":
            text, href = self._inline(c, marks), attr(c, "href")
            return f"[{text}]({href})" if href and text.strip(WS) else text
        if t == "s":
            return " " * min(_number(attr(c, "c")), MOST_SPACES)
        if t == "tab":
            return " "
        if t == "line-break":
            return "\n"
        if t == "note":
            return self._note(c)
        if t == "frame":
            return " ".join(self.frame(c))
        return "" if t in SILENT_MARKS else self._inline(c, marks)

    def _note(self, e) -> str:
        body = next(every(e, "note-body"), None)
        text = " ".join(x for x in self.flow(body) if x.strip(WS)) if body is not None else ""
        if not text:
            return ""
        self.notes.append(text)
        return f"[^{len(self.notes)}]"


def _marked(raw: str | None, marks: tuple[bool, bool]) -> str:
    text = escape_inline(re.sub(r"\s+", " ", raw or ""))
    core = text.strip(WS)
    if not core or not any(marks):
        return text
    lead, mark = text[: len(text) - len(text.lstrip(WS))], "*" * (marks[0] + 2 * marks[1])
    return f"{lead}{mark}{core}{mark}{text[len(lead) + len(core):]}"


def _rows(e) -> list:
    """Rows as often as they repeat, those of header and group elements in their place."""
    out = []
    for c in e:
        if tag(c) == "table-row":
            out += [c] * min(_number(attr(c, "number-rows-repeated")), MOST_REPEATS)
        elif tag(c) in ("table-header-rows", "table-rows", "table-row-group"):
            out += _rows(c)
    return out


def _filled(rows: list[list[str]], drop_empty: bool = False) -> list[list[str]]:
    rows = [r for r in rows if r] if drop_empty else rows
    while rows and not any(c.strip(WS) for c in rows[-1]):
        rows.pop()
    return rows
