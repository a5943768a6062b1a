"""PDF files to Markdown from their text layer: shown strings to positioned items, items to lines and blocks."""

from __future__ import annotations

import math

import numpy as np

from . import page_layout as layout
from .lines import escape_inline, join_blocks
from .page_layout import Item
from .pdf_fonts import Font
from .pdf_objects import Document, Operator, Parser, Stream
from .png import bilevel, encode_png, with_alpha
from .recognition import Engine, Recognition, recognise

#: Least side of a picture, share of the largest from which a scan's pictures are read, pages listed.
LEAST_SIDE, LEAST_SHARE, LISTED = 64, 0.2, 12
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: Forms within forms that are followed.
DEEPEST = 12


def times(a: tuple, b: tuple) -> tuple:
    """The transform ``a`` followed by ``b``."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


class Page:
    """Items and pictures that a page's content shows, in the order shown."""

    def __init__(self, doc: Document, info: dict, fonts: dict):
        self.doc, self.fonts = doc, fonts
        self.items: list[Item] = []
        self.images: list[Stream] = []
        content = doc.get(info, "Contents")
        parts = []
        for c in content if isinstance(content, list) else [content]:
            if isinstance(s := doc.get(c), Stream):
                try:
                    parts.append(doc.stream(s))
                except ValueError:
                    continue
        self.run(b"\n".join(parts), doc.get(info, "Resources") or {}, IDENTITY, 0)

    def run(self, content: bytes, resources, matrix: tuple, depth: int) -> None:
        get, p = self.doc.get, Parser(content)
        state = {"m": matrix, "font": None, "size": 0.0, "char": 0.0, "word": 0.0, "wide": 1.0, "lead": 0.0, "rise": 0.0}
        saved, held, tm, line = [], [], IDENTITY, IDENTITY
        while True:
            try:
                x = p.next(refs=False)
            except EOFError:
                return
            if not isinstance(x, Operator):
                held.append(x)
                continue
            num = [float(v) for v in held if isinstance(v, (int, float)) and not isinstance(v, bool)]
            if x == "q":
                saved.append(dict(state))
            elif x == "Q":
                state = saved.pop() if saved else state
            elif x == "cm" and len(num) == 6:
                state["m"] = times(tuple(num), state["m"])
            elif x == "BT":
                tm = line = IDENTITY
            elif x == "Tf" and held and num:
                state["font"], state["size"] = self._font(resources, held[0]), num[-1]
            elif x in ("Tc", "Tw", "TL", "Ts", "Tz") and num:
                state[{"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise", "Tz": "wide"}[x]] = num[0] / (100 if x == "Tz" else 1)
            elif x in ("Td", "TD") and len(num) == 2:
                state["lead"] = -num[1] if x == "TD" else state["lead"]
                tm = line = times((1, 0, 0, 1, *num), line)
            elif x == "Tm" and len(num) == 6:
                tm = line = tuple(num)
            elif x in ("T*", "'", '"', "Tj", "TJ"):
                if x in ("T*", "'", '"'):
                    tm = line = times((1, 0, 0, 1, 0, -state["lead"]), line)
                if x == '"' and len(num) == 2:
                    state["word"], state["char"] = num
                for part in held[-1] if x == "TJ" and held and isinstance(held[-1], list) else held[-1:] if x != "T*" else []:
                    if isinstance(part, bytes):
                        tm = self._show(part, state, tm)
                    elif isinstance(part, (int, float)):
                        tm = times((1, 0, 0, 1, -part / 1000 * state["size"] * state["wide"], 0), tm)
            elif x == "Do" and held:
                self._object(get(resources, "XObject", str(held[-1])), resources, state["m"], depth)
            elif x == "ID":
                end = content.find(b"EI", p.at)
                while end >= 0 and not (content[end - 1 : end] in b"\n\r\t " and content[end + 2 : end + 3] in b"\n\r\t "):
                    end = content.find(b"EI", end + 2)
                p.at = end + 2 if end >= 0 else len(content)
            held = []

    def _font(self, resources, name) -> Font | None:
        info = self.doc.get(resources, "Font", str(name))
        if not isinstance(info, dict):
            return None
        if id(info) not in self.fonts:
            self.fonts[id(info)] = Font(self.doc, info)
        return self.fonts[id(info)]

    def _show(self, raw: bytes, state: dict, tm: tuple) -> tuple:
        if state["font"] is None:
            return tm
        codes = state["font"].codes(raw)
        far = sum((w * state["size"] + state["char"] + (state["word"] if blank else 0)) * state["wide"] for _, w, blank in codes)
        text = "".join(t for t, _, _ in codes)
        if text:
            on = times(tm, state["m"])
            a = times((state["size"] * state["wide"], 0, 0, state["size"], 0, state["rise"]), on)
            self.items.append(Item(text, a[4], a[5], abs(far) * math.hypot(on[0], on[1]), abs(a[3]) or math.hypot(a[2], a[3])))
        return times((1, 0, 0, 1, far, 0), tm)

    def _object(self, x, resources, matrix: tuple, depth: int) -> None:
        get = self.doc.get
        if not isinstance(x, Stream):
            return
        if get(x, "Subtype") == "Image":
            if not any(x is y for y in self.images):
                self.images.append(x)
        elif get(x, "Subtype") == "Form" and depth < DEEPEST:
            own = [float(get(v) or 0) for v in get(x, "Matrix") or IDENTITY]
            try:
                self.run(self.doc.stream(x), get(x, "Resources") or resources, times(tuple(own), matrix) if len(own) == 6 else matrix, depth + 1)
            except ValueError:
                return


def picture(doc: Document, x: Stream, scan: bool = False) -> tuple[bytes, str] | None:
    """A picture's bytes and extension; None for masks (but of a scan), small ones and unknown encodings.  A JPEG stays as it is."""
    get = doc.get
    width, height, bits = (get(x, k) or 0 for k in ("Width", "Height", "BitsPerComponent"))
    if width < LEAST_SIDE or height < LEAST_SIDE:
        return None
    filters = [f for f, _ in doc.filters(x)]
    try:
        if filters and filters[-1] in ("DCTDecode", "DCT"):
            return doc.stream(x, ("DCTDecode", "DCT")), "jpg"
        data = doc.stream(x)
    except ValueError:
        return None
    space = get(x, "ColorSpace")
    kind = str(get(space[0]) if isinstance(space, list) and space else space)
    if get(x, "ImageMask") or (bits == 1 and kind in ("DeviceGray", "CalGray")):
        if not scan:
            return None
        decode = get(x, "Decode")
        if isinstance(decode, list) and decode and get(decode[0]) == 1:
            data = bytes(b ^ 255 for b in data)
        png = bilevel(width, height, data)
        return (png, "png") if png else None
    palette = None
    if kind == "Indexed":
        base, raw = get(space[1]), get(space[3])
        raw = doc.stream(raw) if isinstance(raw, Stream) else raw or b""
        n = _channels(doc, base)
        palette = np.frombuffer(raw[: len(raw) // n * n], np.uint8).reshape(-1, n)
    n = 1 if palette is not None else _channels(doc, space)
    if not n or bits not in (1, 2, 4, 8) or bits != 8 and n != 1:
        return None
    stride = (width * n * bits + 7) // 8
    if len(data) < stride * height:
        return None
    rows = np.frombuffer(data, np.uint8, stride * height).reshape(height, stride)
    if bits < 8:
        rows = np.stack([(rows >> (8 - bits * (k + 1))) & ((1 << bits) - 1) for k in range(8 // bits)], axis=2).reshape(height, -1)[:, :width]
        rows = rows if palette is not None else (rows * (255 // ((1 << bits) - 1))).astype(np.uint8)
    pixels = rows[:, : width * n].reshape(height, width, n)
    if palette is not None:
        pixels = palette[np.minimum(pixels[:, :, 0], len(palette) - 1)] if len(palette) else np.zeros((height, width, 3), np.uint8)
        n = pixels.shape[2]
    if n == 4:
        pixels = ((255 - pixels[:, :, :3].astype(np.uint16)) * (255 - pixels[:, :, 3:].astype(np.uint16)) // 255).astype(np.uint8)
    return encode_png(width, height, with_alpha(pixels[:, :, 0] if n == 1 else pixels)), "png"


def _channels(doc: Document, space) -> int:
    kind = str(doc.get(space[0]) if isinstance(space, list) and space else space)
    if kind == "ICCBased":
        return doc.get(space[1], "N") or 0
    return {"DeviceGray": 1, "CalGray": 1, "G": 1, "DeviceRGB": 3, "CalRGB": 3, "Lab": 3, "RGB": 3, "DeviceCMYK": 4, "CMYK": 4}.get(kind, 0)


def page_items(data: bytes) -> list[list[Item]]:
    """The positioned items of every page."""
    doc, fonts = Document(data), {}
    return [Page(doc, info, fonts).items for info in doc.pages()]


def scanned(doc: Document, page: Page, engine: Engine | None) -> Recognition | None:
    """What an engine reads in a page's pictures, the largest first; None without pictures or where it fails."""
    found = [(doc.get(x, "Width") * doc.get(x, "Height"), p) for x in page.images if (p := picture(doc, x, scan=True))]
    found.sort(key=lambda f: -f[0])
    try:
        read = [recognise(p[0], engine) for area, p in found if area >= found[0][0] * LEAST_SHARE]
    except Exception:  # one unreadable page does not cost the others; it is reported as empty
        return None
    return Recognition([t for r in read for t in r.paragraphs], min(r.confidence for r in read), sum(r.discarded for r in read)) if read else None


def list_pages(pages: list[int]) -> str:
    return ("page " if len(pages) == 1 else "pages ") + ", ".join(map(str, pages[:LISTED])) + (", …" if len(pages) > LISTED else "")


def read_pdf(data: bytes, save=lambda data, ext: None, engine: Engine | None = None) -> dict:
    doc, fonts = Document(data), {}
    rows, embeds, read, skipped = [], [], {}, 0
    for k, info in enumerate(doc.pages()):
        page = Page(doc, info, fonts)
        rows.append(layout.rows(page.items))
        embeds.append([])
        if not page.items:
            found = scanned(doc, page, engine)
            if found:
                read[k] = found
            continue
        for x in page.images:
            p = picture(doc, x)
            embed = save(*p) if p else None
            skipped += embed is None
            embeds[-1] += [embed] if embed else []
    running = layout.running(rows)
    pages = [layout.reading_order(layout.without(r, running)) for r in rows]
    every = [x for p in pages for x in p]
    if not every and not read:
        raise ValueError("this PDF has no text: neither a text layer nor a page that OCR could read")
    body, width = layout.body_size(every), layout.median_width(every)
    out: list[str] = []
    for k, page in enumerate(pages):
        out += [x for t in (read[k].paragraphs if k in read else []) for x in ("", escape_inline(t), "")]
        out += layout.render(page, body, width)
        out += [x for e in embeds[k] for x in ("", e, "")]
    with_text = {k for k, r in read.items() if r.paragraphs}
    front = [("pages_converted", f"{sum(bool(p) or k in with_text for k, p in enumerate(pages))}/{len(pages)}")]
    front += [("pages_read_by_ocr", str(len(with_text)))] if read else []
    return {"markdown": join_blocks(out), "warnings": _warnings(pages, read, with_text, skipped), "frontmatter": front}


def _warnings(pages: list, read: dict[int, Recognition], with_text: set[int], skipped: int) -> list[str]:
    said = ["Vector graphics and charts drawn as lines are not extracted."]
    if skipped:
        said.append(f"{skipped} image{'' if skipped == 1 else 's'} skipped (too small, or of an unsupported kind).")
    if with_text:
        lowest = int(min(read[k].confidence for k in with_text) + 0.5)
        said.append(f"No text layer, read by OCR: {list_pages([k + 1 for k in sorted(with_text)])}; lowest confidence {lowest}%.")
        lost = sum(read[k].discarded for k in with_text)
        said += [f"{lost} region{'' if lost == 1 else 's'} on those pages too unclear to read."] if lost else []
    blank = [k + 1 for k, p in enumerate(pages) if not p and k not in with_text]
    if blank:
        said.append(f"{len(blank)} of {len(pages)} pages gave nothing ({list_pages(blank)}).")
    return said
