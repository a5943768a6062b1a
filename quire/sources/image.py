"""Images: the picture itself and what an OCR engine reads in it."""

from __future__ import annotations

from .lines import escape_inline, join_blocks
from .recognition import Engine, recognise

#: First bytes of the formats, and further ones at an offset.
SIGNATURES = (("jpg", b"\xff\xd8\xff", b"", 0), ("png", b"\x89PNG\r\n\x1a\n", b"", 0), ("gif", b"GIF", b"", 0), ("bmp", b"BM", b"", 0), ("webp", b"RIFF", b"WEBP", 8), ("tiff", b"II*\x00", b"", 0), ("tiff", b"MM\x00*", b"", 0))


def image_format(data: bytes) -> str | None:
    """By its first bytes; None under 12 bytes or if unknown."""
    return next((k for k, a, b, at in SIGNATURES if data.startswith(a) and data[at : at + len(b)] == b), None) if len(data) >= 12 else None


def read_image(data: bytes, save=lambda data, ext: None, engine: Engine | None = None) -> dict:
    kind = image_format(data)
    if kind is None:
        raise ValueError("not a readable image (unrecognised file signature)")
    embed = save(data, kind)
    found = recognise(data, engine)
    said = []
    if not found.paragraphs:
        said.append("OCR found no text in this image.")
    elif found.confidence < 70:
        said.append(f"OCR confidence was low ({int(found.confidence + 0.5)}%).")
    if found.discarded:
        said.append(f"{found.discarded} unreadable region{'' if found.discarded == 1 else 's'} dropped.")
    if not embed:
        said.append("The image itself was not kept.")
    lines = ([embed, ""] if embed else []) + [x for p in found.paragraphs for x in (escape_inline(p), "")]
    return {"markdown": join_blocks(lines), "warnings": said, "frontmatter": []}
