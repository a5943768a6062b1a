"""Character references and charsets of text formats."""

from __future__ import annotations

import re

#: Named references.
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "ndash": "–", "mdash": "—", "hellip": "…",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•", "middot": "·", "copy": "©", "reg": "®", "trade": "™",
    "deg": "°", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß",
    "pound": "£", "euro": "€", "laquo": "«", "raquo": "»",
}
_REFERENCE = re.compile(r"&(?:#([0-9]+)|#[xX]([0-9a-fA-F]+)|([a-zA-Z][a-zA-Z0-9]*));")


def decode_entities(text: str) -> str:
    """Numeric references and the named ones above (by lower case if need be); others stay as written."""

    def resolved(m: re.Match) -> str:
        if m[3]:
            return NAMED.get(m[3], NAMED.get(m[3].lower(), m[0]))
        code = int(m[1]) if m[1] else int(m[2], 16)
        return chr(code) if 0 < code <= 0x10FFFF else m[0]

    return _REFERENCE.sub(resolved, text) if "&" in text else text


_CP1252 = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)}
_LATIN = re.compile(r"(x-)?(windows|cp|ansi)[-_]?1252|iso[-_]?8859[-_]?1|latin1|us[-_]?ascii|ascii", re.I)
_LABELS = {"gb2312": "gbk", "shift_jis": "cp932", "sjis": "cp932", "euc-kr": "cp949", "ks_c_5601-1987": "cp949", "unicode": "utf-16-le", "utf-16": "utf-16-le", "iso-8859-9": "cp1254"}


def decode_text(data: bytes, declared: str | None = None) -> str:
    """By byte order mark, else declared charset, else UTF-8 if valid, else windows-1252 with its five gaps kept."""
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(codec, "replace")
    label = (declared or "").strip()
    if label and not _LATIN.fullmatch(label):
        try:
            return data.decode(_LABELS.get(label.lower(), label), "replace")
        except LookupError:
            label = ""
    if not label:
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1").translate(_CP1252)
