"""Eight-bit truecolour PNG files with alpha, the same bytes for the same pixels."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def crc32(data: bytes) -> int:
    return zlib.crc32(data)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", crc32(kind + data))


def encode_png(width: int, height: int, rgba: bytes) -> bytes:
    """Rows without filter, not interlaced; ``rgba`` may be longer than needed, not shorter."""
    if len(rgba) < 4 * width * height:
        raise ValueError("fewer pixels than width and height say")
    rows = np.frombuffer(rgba, np.uint8, 4 * width * height).reshape(height, 4 * width)
    raw = np.concatenate((np.zeros((height, 1), np.uint8), rows), axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b"")


def with_alpha(pixels: np.ndarray) -> bytes:
    """RGBA bytes of an array of grey (h, w) or colour (h, w, 3) pixels."""
    if pixels.ndim == 2:
        pixels = np.repeat(pixels[:, :, None], 3, axis=2)
    return np.concatenate((pixels, np.full((*pixels.shape[:2], 1), 255, np.uint8)), axis=2).tobytes()


def bilevel(width: int, height: int, data: bytes) -> bytes | None:
    """A PNG of one-bit rows padded to whole bytes, a set bit being white; None if rows are missing."""
    stride = (width + 7) // 8
    if len(data) < stride * height:
        return None
    bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * height).reshape(height, stride), axis=1)[:, :width]
    return encode_png(width, height, with_alpha(bits * np.uint8(255)))
