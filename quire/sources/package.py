"""Zip packages of XML parts: parts, relationships, and elements by local name."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree


#: Bytes that one part may inflate to.
LARGEST = 1 << 28


def tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def attr(e, name: str, default: str | None = None) -> str | None:
    """An attribute by local name."""
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), default)


def kids(e, *names: str) -> list:
    return [c for c in e if tag(c) in names] if e is not None else []


def kid(e, *path: str):
    for name in path:
        e = next(iter(kids(e, name)), None)
    return e


def every(e, *names: str) -> Iterator:
    return (c for c in e.iter() if tag(c) in names) if e is not None else iter(())


class Package:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = {n.lstrip("/"): n for n in self.zip.namelist()}

    def read(self, path: str | None) -> bytes | None:
        if path not in self.names:
            return None
        if self.zip.getinfo(self.names[path]).file_size > LARGEST:
            raise ValueError(f"{path} is too large")
        return self.zip.read(self.names[path])

    def xml(self, path: str | None):
        """The part's root element; None if it is absent or broken."""
        data = self.read(path)
        try:
            return ElementTree.fromstring(data) if data is not None else None
        except ElementTree.ParseError:
            return None

    def rels(self, part: str) -> dict[str, tuple[str, str]]:
        """id to (type's last word, target: a part's path, or an address if external)."""
        folder, name = posixpath.split(part)
        out = {}
        for r in kids(self.xml(posixpath.join(folder, "_rels", name + ".rels")), "Relationship"):
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = resolve(part, target)
            out[r.get("Id", "")] = (r.get("Type", "").rsplit("/", 1)[-1], target)
        return out


def resolve(part: str, target: str) -> str:
    """The path of a target that ``part`` names."""
    return posixpath.normpath(posixpath.join("/", posixpath.dirname(part), unquote(target))).lstrip("/")


def image(package: Package, path: str | None, save) -> str | None:
    """The embed of an image part; None for absent parts and other types."""
    ext = (path or "").rsplit(".", 1)[-1].lower()
    data = package.read(path)
    if data is None or ext not in {"png", "jpg", "jpeg", "gif", "webp", "bmp", "tif", "tiff", "svg", "avif"}:
        return None
    return save(data, {"jpeg": "jpg", "tif": "tiff"}.get(ext, ext))
