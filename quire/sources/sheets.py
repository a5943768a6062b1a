"""Workbooks to Markdown: a heading and a table a sheet, values as the workbook shows them."""

from __future__ import annotations

import datetime
import math
import re
from decimal import ROUND_HALF_UP, Decimal

from .lines import WS, escape_inline, join_blocks, table
from .package import Package, attr, every, image, kid, kids, tag

MAIN = "xl/workbook.xml"
#: Decimals of the built-in number formats; 9 and 10 are percentages; 14-22 and 45-47 are dates.
DECIMALS = {1: 0, 2: 2, 3: 0, 4: 2, 7: 2, 8: 2, 9: 0, 10: 2, 39: 2, 40: 2, 43: 2, 44: 2}
DATES = {*range(14, 23), *range(45, 48)}
GENERAL = ("number", None)
_REFERENCE = re.compile(r"'((?:[^']|'')+)'!|([\w.:]+)!")


def read_xlsx(data: bytes, save=lambda data, ext: None, hidden: bool = False) -> dict:
    """``hidden``: convert hidden sheets too; those that visible ones read are converted anyway."""
    package = Package(data)
    book, rels = package.xml(MAIN), package.rels(MAIN)
    if book is None:
        raise ValueError("no workbook part")
    sheets = []
    for s in kids(kid(book, "sheets"), "sheet"):
        link = next((v for k, v in s.attrib.items() if k.endswith("}id")), "")
        sheets.append((s.get("name", ""), s.get("state", "visible") != "visible", rels.get(link, ("", None))[1]))
    shared = [_text(e) for e in kids(package.xml("xl/sharedStrings.xml"), "si")]
    formats = cell_formats(package.xml("xl/styles.xml"))
    needed = set() if hidden else _sources(package, book, sheets)
    out, gaps, done = [], {k: [] for k in ("skipped", "empty", "missing", "needed", "hidden")}, 0
    for name, is_hidden, path in sheets:
        if is_hidden and not hidden and _key(name) not in needed:
            gaps["skipped"].append(name)
            continue
        root = package.xml(path)
        if root is None:
            gaps["missing"].append(name)
            continue
        rows, embeds = sheet_rows(root, shared, formats), _images(package, path, save)
        if not rows and not embeds:
            gaps["empty"].append(name)
            continue
        done += 1
        if is_hidden:
            gaps["hidden" if hidden else "needed"].append(name)
        out.extend([f"## {name}", "", *table([[escape_inline(c) for c in r] for r in rows]), "", *(x for e in embeds for x in (e, ""))])
    said = {"skipped": "Hidden sheets left out", "empty": "Empty sheets", "missing": "Sheets without a part", "needed": "Hidden sheets kept, as visible ones read them", "hidden": "Hidden sheets kept"}
    warnings = [f"{said[k]}: " + ", ".join(map(escape_inline, names)) for k, names in gaps.items() if names]
    return {"markdown": join_blocks(out), "warnings": [*warnings, "Formulas are exported as their last values"], "frontmatter": [("sheets_converted", f"{done}/{len(sheets)}")]}


def _key(name: str) -> str:
    return name.strip(WS).lower()


def _text(e) -> str:
    """The ``t`` runs without phonetic ones."""
    if tag(e) == "t":
        return e.text or ""
    return "".join(_text(c) for c in e if tag(c) not in ("rPh", "phoneticPr"))


def references(formula: str) -> set[str]:
    """Keys of the sheets that a formula names; a range of sheets gives both ends."""
    return {_key(part) for m in _REFERENCE.finditer(formula) for part in (m[1].replace("''", "'") if m[1] else m[2]).split(":")}


def _sources(package: Package, book, sheets: list) -> set[str]:
    """Sheets that visible formulas, charts and pivot tables read, one step far, by name or through workbook names and tables."""
    named: dict[str, set[str]] = {}
    for d in kids(kid(book, "definedNames"), "definedName"):
        if not d.get("name", "").startswith("_xlnm") and d.get("localSheetId") is None:
            named[d.get("name", "").lower()] = references(d.text or "")
    formulas, found = [], set()
    for name, is_hidden, path in sheets:
        for kind, part in package.rels(path).values() if path else ():
            if kind == "table" and (t := package.xml(part)) is not None:
                named[(t.get("displayName") or t.get("name") or "").lower()] = {_key(name)}
        if not is_hidden:
            formulas.extend(f.text or "" for f in every(package.xml(path), "f"))
    for part in package.names:
        if re.match(r"xl/charts/[^/]*\.xml$", part):
            formulas.extend(f.text or "" for f in every(package.xml(part), "f"))
        elif re.match(r"xl/pivotCache/pivotCacheDefinition[^/]*\.xml$", part):
            for w in every(package.xml(part), "worksheetSource"):
                found |= {_key(w.get("sheet"))} if w.get("sheet") else set()
                formulas.append(w.get("name", ""))
    for f in formulas:
        found |= references(f)
        for word in re.findall(r"[^\W\d][\w.]*", f) if named else ():
            found |= named.get(word.lower(), set())
    return found


def _images(package: Package, path: str, save) -> list[str]:
    drawings = [p for kind, p in package.rels(path).values() if kind == "drawing"]
    return [m for d in drawings for b in every(package.xml(d), "blip") if (m := image(package, package.rels(d).get(attr(b, "embed", ""), ("", ""))[1], save))]


def column_index(reference: str | None) -> int:
    n = 0
    for c in re.match(r"[A-Za-z]*", reference or "")[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(root, shared: list[str], formats: list) -> list[list[str]]:
    """Rows with content, cells placed by their letters, cut after the last used column."""
    rows = []
    for r in kids(kid(root, "sheetData"), "row"):
        cells: dict[int, str] = {}
        at = -1
        for c in kids(r, "c"):
            k = column_index(c.get("r"))
            at = k if k >= 0 else at + 1
            value = _value(c, shared, formats)
            if value.strip(WS):
                cells[at] = value
        if cells:
            rows.append(cells)
    width = 1 + max((max(r) for r in rows), default=-1)
    return [[r.get(k, "") for k in range(width)] for r in rows]


def _value(c, shared: list[str], formats: list) -> str:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return _text(kid(c, "is")) if kid(c, "is") is not None else ""
    v = kid(c, "v")
    raw = (v.text if v is not None else "") or ""
    if kind == "s":
        return shared[int(raw)] if raw.strip().isdigit() and int(raw) < len(shared) else ""
    if kind == "b":
        return "TRUE" if raw.strip() == "1" else "FALSE"
    style = c.get("s", "0")
    if kind in ("e", "str") or not raw:
        return raw
    try:
        number = float(raw)
    except ValueError:
        return raw
    if not math.isfinite(number):
        return raw
    form = formats[int(style)] if style.isdigit() and int(style) < len(formats) else GENERAL
    return (iso_date(number) or raw) if form[0] == "date" else format_number(number, form)


def cell_formats(styles) -> list[tuple[str, int | None]]:
    """(date, percent or number; decimals) by position in ``cellXfs``."""
    codes = {n.get("numFmtId"): n.get("formatCode", "") for n in kids(kid(styles, "numFmts"), "numFmt")}
    return [interpret(int(x.get("numFmtId", "0")), codes.get(x.get("numFmtId"))) for x in kids(kid(styles, "cellXfs"), "xf")]


def interpret(number: int, code: str | None) -> tuple[str, int | None]:
    if code is None:
        return ("date", None) if number in DATES else ("percent" if number in (9, 10) else "number", DECIMALS.get(number))
    section = re.sub(r'"[^"]*"|\\.|_.|\*.', "", code).split(";")[0]
    plain = re.sub(r"\[(?![ymdhs]+\])[^\]]*\]", "", section, flags=re.I)
    if re.search("[ymdhs]", plain, re.I) and not re.fullmatch("general", plain.strip(), re.I):
        return "date", None
    m = re.search(r"\.([0#?]+)", plain)
    decimals = len(m[1]) if m else 0 if re.search("[0#?]", plain) else None
    return "percent" if "%" in plain else "number", decimals


def _fixed(value: float, decimals: int) -> str:
    shown = str(Decimal(value).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP)) if abs(value) < 1e21 else repr(value)
    return shown.lstrip("-") if value == 0 else shown


def format_number(value: float, form: tuple[str, int | None]) -> str:
    """Ties away from zero at the format's decimals; otherwise eleven significant digits."""
    kind, decimals = form
    if kind == "percent":
        return _fixed(value * 100, decimals or 0) + "%"
    if decimals is not None:
        return _fixed(value, decimals)
    short = float(f"{value:.11g}")
    if short == 0:
        return "0"
    if 1e-6 <= abs(short) < 1e21:
        return format(Decimal(repr(short)), "f").removesuffix(".0")
    digits, _, power = repr(short).partition("e")
    return f"{digits.removesuffix('.0')}e{int(power):+d}"


def iso_date(serial: float) -> str | None:
    if not 0 < serial < 2958466:
        return None
    day, seconds = math.floor(serial), math.floor((serial % 1) * 86400 + 0.5)
    at = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=day, seconds=seconds)
    return at.strftime("%Y-%m-%d %H:%M:%S" if seconds else "%Y-%m-%d")
