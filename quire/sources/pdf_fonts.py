"""Fonts of PDF files: codes of a shown string to text and widths."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from .pdf_objects import Document, Name, Operator, Parser, Stream

#: Widths of Helvetica and Times-Roman for the codes 32 to 126, where a file gives none.
HELVETICA = [278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278] + [556] * 10 + [278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584]
TIMES = [250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278] + [500] * 10 + [278, 278, 564, 564, 564, 444, 921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500, 333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541]
#: Glyph names that no rule below gives, by character.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©", "ordfeminine": "ª",
    "guillemotleft": "«", "logicalnot": "¬", "registered": "®", "macron": "¯", "degree": "°", "plusminus": "±", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·",
    "cedilla": "¸", "ordmasculine": "º", "guillemotright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "questiondown": "¿", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ",
    "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "germandbls": "ß", "multiply": "×", "divide": "÷", "dotlessi": "ı", "Lslash": "Ł", "lslash": "ł", "florin": "ƒ",
    "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚", "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "guilsinglleft": "‹", "guilsinglright": "›",
    "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "dagger": "†", "daggerdbl": "‡", "perthousand": "‰", "fraction": "⁄", "trademark": "™", "Euro": "€", "minus": "−",
    "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "circumflex": "ˆ", "tilde": "˜", "breve": "˘", "dotaccent": "˙", "ring": "˚", "hungarumlaut": "˝", "ogonek": "˛", "caron": "ˇ",
}
ACCENTS = {"grave": "GRAVE", "acute": "ACUTE", "circumflex": "CIRCUMFLEX", "tilde": "TILDE", "dieresis": "DIAERESIS", "ring": "RING ABOVE", "cedilla": "CEDILLA", "caron": "CARON", "breve": "BREVE", "macron": "MACRON", "ogonek": "OGONEK", "slash": "STROKE", "dotaccent": "DOT ABOVE", "hungarumlaut": "DOUBLE ACUTE"}
#: The standard encoding beyond ASCII, by code; in ASCII it differs in the two quotes only.
STANDARD = {0xA1: "¡", 0xA2: "¢", 0xA3: "£", 0xA4: "⁄", 0xA5: "¥", 0xA6: "ƒ", 0xA7: "§", 0xA8: "¤", 0xA9: "'", 0xAA: "“", 0xAB: "«", 0xAC: "‹", 0xAD: "›", 0xAE: "fi", 0xAF: "fl", 0xB1: "–", 0xB2: "†", 0xB3: "‡", 0xB4: "·", 0xB6: "¶", 0xB7: "•", 0xB8: "‚", 0xB9: "„", 0xBA: "”", 0xBB: "»", 0xBC: "…", 0xBD: "‰", 0xBF: "¿", 0xD0: "—", 0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ", 0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß", 0x27: "’", 0x60: "‘"}


@lru_cache(4096)
def glyph_text(name: str) -> str:
    """The text of a glyph name: listed, a letter with an accent, or written as code points; else empty."""
    name = name.split(".")[0]
    if "_" in name:
        return "".join(map(glyph_text, name.split("_")))
    if name in GLYPHS or len(name) == 1:
        return GLYPHS.get(name, name)
    if name[0].isalpha() and name[1:] in ACCENTS:
        case = "CAPITAL" if name[0].isupper() else "SMALL"
        try:
            return unicodedata.lookup(f"LATIN {case} LETTER {name[0].upper()} WITH {ACCENTS[name[1:]]}")
        except KeyError:
            return ""
    digits = name[3:] if name.startswith("uni") else name[1:] if name.startswith("u") else ""
    try:
        if name.startswith("uni") and len(digits) % 4 == 0 and digits:
            return bytes.fromhex(digits).decode("utf-16-be")
        return chr(int(digits, 16)) if 4 <= len(digits) <= 6 else ""
    except (ValueError, OverflowError):
        return ""


def to_unicode(data: bytes) -> dict[bytes, str]:
    """Codes to text, of a character map's ``bfchar`` and ``bfrange`` sections."""
    out: dict[bytes, str] = {}
    text = lambda b: b.decode("utf-16-be", "ignore") if isinstance(b, bytes) else glyph_text(b) if isinstance(b, Name) else ""
    p, held = Parser(data), []
    while True:
        try:
            x = p.next(refs=False)
        except EOFError:
            return out
        if not isinstance(x, Operator):
            held.append(x)
            continue
        if x == "endbfchar":
            out.update({a: text(b) for a, b in zip(held[0::2], held[1::2], strict=False) if isinstance(a, bytes)})
        elif x == "endbfrange":
            for a, b, to in zip(held[0::3], held[1::3], held[2::3], strict=False):
                if not (isinstance(a, bytes) and isinstance(b, bytes)):
                    continue
                low, high = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                for k in range(min(high - low + 1, 65536)):
                    code = (low + k).to_bytes(len(a), "big")
                    if isinstance(to, list):
                        out[code] = text(to[k]) if k < len(to) else ""
                    elif isinstance(to, bytes) and to:
                        last = int.from_bytes(to[-2:], "big") + k
                        out[code] = text(to[:-2] + (last & 0xFFFF).to_bytes(min(2, len(to)), "big"))
        held = []


class Font:
    """``codes(bytes)`` gives (text, width in text space, whether it is the one-byte code 32) of each code."""

    def __init__(self, doc: Document, info: dict):
        self.doc, self.info = doc, info
        self.composite = doc.get(info, "Subtype") == "Type0"
        self.scale = 0.001
        if doc.get(info, "Subtype") == "Type3" and isinstance(m := doc.get(info, "FontMatrix"), list) and m:
            self.scale = abs(float(doc.get(m[0]) or 0.001))
        self.mapped: dict[bytes, str] = {}
        if isinstance(x := doc.get(info, "ToUnicode"), Stream):
            try:
                self.mapped = to_unicode(doc.stream(x))
            except ValueError:
                pass
        self.widths: dict[int, float] = {}
        if self.composite:
            self._composite()
        else:
            self._simple()

    def _simple(self) -> None:
        get = self.doc.get
        how = get(self.info, "Encoding")
        base = (how if isinstance(how, Name) else get(how, "BaseEncoding") if isinstance(how, dict) else None) or ("WinAnsiEncoding" if get(self.info, "Subtype") == "TrueType" else "StandardEncoding")
        codec = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}.get(base, "latin1")
        self.chars = [bytes([k]).decode(codec, "ignore") for k in range(256)]
        if base not in ("WinAnsiEncoding", "MacRomanEncoding"):
            self.chars[127:] = [""] * 129
            for k, c in STANDARD.items():
                self.chars[k] = c
        at = 0
        for x in (get(how, "Differences") or []) if isinstance(how, dict) else []:
            x = get(x)
            if isinstance(x, Name):
                self.chars[at & 255] = glyph_text(x)
                at += 1
            elif isinstance(x, int):
                at = x
        widths, first = get(self.info, "Widths"), get(self.info, "FirstChar") or 0
        name = str(get(self.info, "BaseFont") or "")
        self.missing = get(self.info, "FontDescriptor", "MissingWidth") or 0
        if isinstance(widths, list):
            self.widths = {first + k: float(v) for k, w in enumerate(widths) if isinstance(v := get(w), (int, float))}
        else:
            self.missing = 600 if "Courier" in name else 500
            table = TIMES if "Times" in name else None if "Courier" in name else HELVETICA
            self.widths = {32 + k: float(w) for k, w in enumerate(table or [])}

    def _composite(self) -> None:
        get = self.doc.get
        inner = get((get(self.info, "DescendantFonts") or [None])[0])
        self.missing = get(inner, "DW")
        self.missing = 1000 if self.missing is None else self.missing
        w, at = get(inner, "W") or [], 0
        while at + 1 < len(w):
            first, then = get(w[at]), get(w[at + 1])
            if isinstance(then, list):
                self.widths.update({first + k: float(get(x) or 0) for k, x in enumerate(then)})
                at += 2
            elif at + 2 < len(w):
                width = float(get(w[at + 2]) or 0)
                self.widths.update(dict.fromkeys(range(first, min(then, first + 65535) + 1), width))
                at += 3
            else:
                break

    def codes(self, raw: bytes) -> list[tuple[str, float, bool]]:
        if self.composite:
            parts = [raw[k : k + 2] for k in range(0, len(raw) - 1, 2)]
            return [(self.mapped.get(c, ""), self.widths.get(int.from_bytes(c, "big"), self.missing) * self.scale, False) for c in parts]
        return [(self.mapped.get(bytes([b]), self.chars[b]), self.widths.get(b, self.missing) * self.scale, b == 32) for b in raw]
