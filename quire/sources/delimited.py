"""Delimited text: sniffing, lenient parsing, notes."""

from __future__ import annotations

import re
from collections import Counter

from ..functions.entities import decode_text
from .lines import WS, join_blocks, table

#: Candidates in order of preference with their names, and the sample that decides.
CANDIDATES = {",": "comma", ";": "semicolon", "\t": "tab", "|": "pipe"}
SAMPLE_CHARS, SAMPLE_ROWS = 65_536, 50


def parse(text: str, delimiter: str) -> list[list[str]]:
    """Rows of fields.  A quote opens a field only where nothing but blanks precede it; text after a closing quote is kept."""
    rows, row, field, k, n = [], [], [], 0, len(text)
    quoted = False  # this field has been quoted already

    def end_row() -> None:
        nonlocal row, field, quoted
        row.append("".join(field))
        if row != [""]:
            rows.append(row)
        row, field, quoted = [], [], False

    plain = re.compile(f"[^{re.escape(delimiter)}\"\r\n]+")
    while k < n:
        c = text[k]
        if c == '"' and not quoted and not "".join(field).strip(" \t"):
            field, quoted, k = [], True, k + 1
            while k < n:
                stop = text.find('"', k)
                if stop < 0:
                    field.append(text[k:])
                    k = n
                    break
                field.append(text[k:stop])
                k = stop + 1
                if text[k : k + 1] != '"':
                    break
                field.append('"')
                k += 1
            continue
        if c == delimiter:
            row.append("".join(field))
            field, quoted = [], False
        elif c in "\r\n":
            end_row()
            if c == "\r" and text[k + 1 : k + 2] == "\n":
                k += 1
        else:
            m = plain.match(text, k)
            field.append(m[0] if m else c)
            k += len(m[0]) if m else 1
            continue
        k += 1
    if field or row or quoted:
        end_row()
    return rows


def sniff(text: str) -> str:
    """The candidate whose sample rows agree best: rows * 100 + fields of the modal width, 0 for one field."""
    best, chosen = -1, ","
    for d in CANDIDATES:
        widths = Counter(len(r) for r in parse(text[:SAMPLE_CHARS], d)[:SAMPLE_ROWS])
        width, n = max(widths.items(), key=lambda x: (x[1], x[0]), default=(0, 0))
        score = n * 100 + width if width > 1 else 0
        if score > best:
            best, chosen = score, d
    return chosen


def looks_like_data(row: list[str]) -> bool:
    return all(re.fullmatch(r"-?[0-9.,%$€£\s]+", c.strip(WS)) or re.match(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", c.strip(WS)) for c in row if c.strip(WS))


def read_delimited(data: bytes, forced: str | None = None) -> dict:
    text, warnings = decode_text(data), []
    m = re.match(r"sep=(.)(?:\r\n|\r|\n|$)", text, re.I)
    if m:
        text = text[m.end() :]
        warnings.append("The file names its delimiter in a first line, which was left out")
    if not text.strip(WS):
        raise ValueError("the file holds no rows")
    delimiter = forced or (m[1] if m else sniff(text))
    rows = parse(text, delimiter)
    width = max(map(len, rows))
    ragged = [k + 1 for k, r in enumerate(rows) if len(r) != width]
    if ragged:
        warnings.append(f"Rows with fewer than {width} fields: " + ", ".join(map(str, ragged[:10])) + ("…" if len(ragged) > 10 else ""))
    if len(rows) > 1 and looks_like_data(rows[0]):
        warnings.append("The first row looks like data; it became the header")
    return {"markdown": join_blocks(table(rows)), "warnings": warnings, "frontmatter": [("rows", str(len(rows))), ("columns", str(width)), ("delimiter", CANDIDATES.get(delimiter, delimiter))]}
