"""Markdown scalars as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the formats' own scripts understand it.
WS = "\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+\\z", "")


def escape_inline(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_\[\]{}<>])", r"\\$1")


def escape_cell(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), "\r\n|\r|\n", "<br>")


def heading(level: Column, text: Column) -> Column:
    return F.concat(F.expr("repeat('#', 1)") if level is None else F.repeat(F.lit("#"), F.least(F.greatest(level, F.lit(1)), F.lit(6))), F.lit(" "), text)


def bullet(depth: Column, text: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), depth), F.lit("- "), text)


def numbered(depth: Column, text: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), depth), F.lit("1. "), text)


def squash_spaces(c: Column) -> Column:
    return trim(F.regexp_replace(c, "[ \\t\\u00a0]+", " "))


def page_title(html: Column) -> Column:
    """What stands in a page's first plain ``<title>``, without blanks at its ends; four references, if they end in a semicolon, are decoded once.  Empty without one."""
    title = F.regexp_extract(html, "<title>([^<]*)</title>", 1)
    for name, char in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        title = F.replace(title, F.lit(f"&{name};"), F.lit(char))
    return F.btrim(title, F.lit(BLANKS))


def yaml_value(c: Column) -> Column:
    v = trim(F.regexp_replace(c, "[\r\n]+", " "))
    bare = v.rlike(r"^[A-Za-z0-9][A-Za-z0-9 ._/@+()–—-]*[A-Za-z0-9._/@+()]\z") | v.rlike(r"^[A-Za-z0-9]\z")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(v == "", F.lit('""')).when(bare, v).otherwise(quoted)


def join_blocks(lines: Column) -> Column:
    """Lines joined by line feeds: runs of blank lines become one, those at the ends go."""
    blank = lambda x: trim(x) == ""
    kept = F.filter(lines, lambda x, i: ~blank(x) | ~blank(F.when(i > 0, lines[F.greatest(i - 1, F.lit(0))]).otherwise("")))
    shown = F.transform(kept, lambda x: F.when(blank(x), F.lit("")).otherwise(x))
    return F.regexp_replace(F.array_join(shown, "\n"), "\\A\n+|\n+\\z", "")


def table_lines(rows: Column) -> Column:
    """A grid (array of arrays of text, the first row its header) as Markdown table lines."""
    width = F.array_max(F.transform(rows, F.size))
    padded = F.transform(rows, lambda r: F.concat(F.transform(r, escape_cell), F.array_repeat(F.lit(""), width - F.size(r))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.concat(F.array(line(padded[0]), rule), F.transform(F.slice(padded, F.lit(2), F.size(padded)), line))


def clock(seconds: Column, with_hours: Column) -> Column:
    s = F.floor(seconds)
    short = F.format_string("%02d:%02d", F.floor(s / 60), s % 60)
    return F.when(with_hours | (s >= 3600), F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(short)


def column_index(reference: Column) -> Column:
    letters = F.upper(F.regexp_extract(reference, "^([A-Za-z]+)", 1))
    return F.when(letters == "", -1).otherwise(F.aggregate(F.split(letters, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64)) - 1)


def serial_date(serial: Column) -> Column:
    """A spreadsheet's day number as a date, with the time of day if it has one; null from 0 down."""
    seconds = F.round(serial * 86400).cast("long")
    at = F.timestamp_seconds(seconds - 25569 * 86400)
    return F.when(serial <= 0, None).when(seconds % 86400 == 0, F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))


def rels_path(part: Column) -> Column:
    return F.regexp_replace(part, r"^((?:.*/)?)([^/]+)$", "$1_rels/$2.rels")


def image_extension(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("", "emf", "wmf"), None).otherwise(ext)


def describe_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", n / (1024.0 * 1024)), F.lit(" MB")))


def image_format(data: Column) -> Column:
    """By its first bytes; null under 12 bytes or if unknown."""
    starts = lambda hexed, at=1: F.hex(F.substring(data, at, len(hexed) // 2)) == hexed
    found = F.when(starts("FFD8FF"), "jpg").when(starts("89504E470D0A1A0A"), "png").when(starts("474946"), "gif").when(starts("424D"), "bmp").when(starts("52494646") & starts("57454250", 9), "webp").when(starts("49492A00") | starts("4D4D002A"), "tiff")
    return F.when(F.length(data) >= 12, found)


def furniture_key(text: Column) -> Column:
    """Lower case without digits, words sorted: equal for a running title on every page."""
    words = F.split(F.regexp_replace(F.lower(text), "[0-9]+", ""), f"[{WS}]+")
    return F.array_join(F.array_sort(F.filter(words, lambda w: w != "")), " ")


def ends_sentence(text: Column) -> Column:
    return text.rlike("[.!?…][\"'”’)\\]]*\\s*\\z")


def longest_backticks(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length)), F.lit(0))
