"""Positioned text of a page to lines in reading order, and lines to Markdown blocks.

An item is (text, x, y, width, size), y growing upwards; a line is (text, size, top,
left, right).  What needs a whole document (running titles, body size, median width)
is in plans.layout as joins and aggregates; these functions see one page.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .lines import WS, escape_inline, heading, squash

#: Rows of one line, blanks between items, page edges, gutters, columns, headings, blocks and list markers.
SAME_ROW, BLANK = 0.5, 0.2
EDGE_ROWS = 2
SPAN_TOLERANCE, MIN_GUTTER, GUTTER_INK, MIN_LINES, MIN_COLUMN_LINES, MIN_COLUMN_WIDTH = 4, 8, 0.35, 12, 4, 60
HEADINGS, LONGEST_HEADING, LONGEST_RUN = ((1.8, 1), (1.45, 2), (1.2, 3)), 120, 2
FULL_LINE, INDENT = 0.85, 0.4
BULLET, NUMBER = re.compile(r"\s*[•·◦▪‣∙*+-]\s+"), re.compile(r"\s*\d{1,3}[.)]\s+")


class Item(NamedTuple):
    text: str
    x: float
    y: float
    width: float
    size: float


class Line(NamedTuple):
    text: str
    size: float
    top: float
    left: float
    right: float


def rows(items: list[Item]) -> list[list[Item]]:
    """Items by baseline, top first, each row from left to right; a row reaches half a glyph's height from its first item."""
    out: list[list[Item]] = []
    for i in sorted((i for i in items if i.text != ""), key=lambda i: (-i.y, i.x)):
        first = out[-1][0] if out else None
        if first is None or abs(i.y - first.y) > max(first.size, i.size) * SAME_ROW:
            out.append([])
        out[-1].append(i)
    return [sorted(r, key=lambda i: i.x) for r in out]


def line(row: list[Item]) -> Line | None:
    """The row as text, with a blank where the gap says so; None without visible text."""
    text, end = row[0].text, row[0].x + row[0].width
    for i in row[1:]:
        gap = i.x - end > i.size * BLANK and text[-1:] not in WS and i.text[:1] not in WS
        text, end = text + (" " if gap else "") + i.text, i.x + i.width
    if not text.strip(WS):
        return None
    return Line(text, max(i.size for i in row), row[0].y, row[0].x, max(i.x + i.width for i in row))


def lines(items: list[Item]) -> list[Line]:
    return [x for r in rows(items) if (x := line(r))]


def edges(page: list) -> list:
    """The first and last rows of a page, where running titles stand."""
    return page if len(page) <= 2 * EDGE_ROWS else page[:EDGE_ROWS] + page[-EDGE_ROWS:]


def furniture_key(text: str) -> str:
    """Lower case without digits, words in order of code points: equal for a running title whatever its number and side."""
    return " ".join(sorted(re.sub("[0-9]+", "", text.lower()).split()))


def without(page: list[list[Item]], repeated: set[str]) -> list[Item]:
    """The items of the rows but those at an edge whose text is running."""
    inner = range(EDGE_ROWS, len(page) - EDGE_ROWS)
    return [i for k, r in enumerate(page) if k in inner or not repeated or (x := line(r)) is None or furniture_key(x.text) not in repeated for i in r]


def column_of(item: Item, gutters: list[float]) -> int:
    middle = item.x + item.width / 2
    return next((k for k, g in enumerate(gutters) if middle < g), len(gutters))


def gutters(items: list[Item]) -> list[float]:
    """Middles of wide vertical strips that few lines cross, where each column they part holds lines."""
    if len(lines(items)) < MIN_LINES:
        return []
    left, right = min(i.x for i in items), max(i.x + i.width for i in items)
    n = -int(-(right - left) // 1)
    if n <= 0:
        return []
    step = [0] * (n + 1)  # ink begins and ends
    for i in items:
        a, b = max(0, int((i.x - left) // 1)), min(n, -int(-(i.x + i.width - left) // 1))
        if b > a:
            step[a] += 1
            step[b] -= 1
    ink, at = [], 0
    for s in step[:n]:
        at += s
        ink.append(at)
    most = max(ink)
    if not most:
        return []
    found, begin = [], None
    for k in range(n + 1):
        clear = k < n and ink[k] <= most * GUTTER_INK
        if clear and begin is None:
            begin = k
        elif not clear and begin is not None:
            if begin > 0 and k < n and k - begin >= MIN_GUTTER:  # strips at the page's sides are margins
                found.append(left + (begin + k) / 2)
            begin = None
    kept = wide_columns(found, left, right)
    return kept if kept and real_columns(items, kept) else []


def wide_columns(found: list[float], left: float, right: float) -> list[float]:
    """The gutters but those that would leave a column too narrow for text."""
    kept, edge = [], left
    for g in found:
        if g - edge >= MIN_COLUMN_WIDTH:
            kept.append(g)
            edge = g
    return kept[:-1] if kept and right - edge < MIN_COLUMN_WIDTH else kept


def real_columns(items: list[Item], at: list[float]) -> bool:
    return all(len(lines([i for i in items if column_of(i, at) == k])) >= MIN_COLUMN_LINES for k in range(len(at) + 1))


def is_banner(row: list[Item], at: list[float]) -> bool:
    """Whether a run of the row's items without a wide gap lies across a gutter."""
    runs = [[row[0].x, row[0].x + row[0].width]]
    for i in row[1:]:
        if i.x - runs[-1][1] >= MIN_GUTTER:
            runs.append([i.x, i.x + i.width])
            runs[-1][1] = max(runs[-2][1], runs[-1][1])
        else:
            runs[-1][1] = max(runs[-1][1], i.x + i.width)
    return any(a < g - SPAN_TOLERANCE and b > g + SPAN_TOLERANCE for a, b in runs for g in at)


def reading_order(items: list[Item]) -> list[Line]:
    """A page's lines: the columns from left to right between one banner and the next."""
    at = gutters(items) if items else []
    if not at:
        return lines(items)
    banners: list[Item] = []
    columns: list[list[Item]] = [[] for _ in range(len(at) + 1)]
    for r in rows(items):
        if is_banner(r, at):
            banners += r
        else:
            for i in r:
                columns[column_of(i, at)].append(i)
    waiting, out = [lines(c) for c in columns], []
    for banner in [*lines(banners), None]:
        for column in waiting:
            while column and (banner is None or column[0].top > banner.top):
                out.append(column.pop(0))
        out += [banner] if banner else []
    return out


def heading_levels(page: list[Line], body: float) -> list[int | None]:
    """By size against the body's; long lines are text, and so are more than two headings of one size in a row."""
    size_level = lambda x: next((k for least, k in HEADINGS if x.size / body >= least), None) if len(x.text) <= LONGEST_HEADING else None
    levels = [size_level(x) for x in page]
    begin = 0
    for k in range(1, len(page) + 1):
        if k == len(page) or levels[k] is None or levels[begin] is None or page[k].size != page[begin].size:
            if k - begin > LONGEST_RUN:
                levels[begin:k] = [None] * (k - begin)
            begin = k
    return levels


def joined(parts: list[str]) -> str:
    """Lines of one paragraph; a hyphen at a line's end goes."""
    out = ""
    for p in parts:
        p = p.strip(WS)
        out = p if not out else out[:-1] + p if out[-1] in "‐-" else f"{out} {p}"
    return out


def render(page: list[Line], body: float, width: float) -> list[str]:
    """Markdown lines of a page: headings by size, list items by their marker, paragraphs up to a line that stops short."""
    out: list[str] = []
    parts, is_item, left = [], False, 0.0

    def close() -> None:
        nonlocal parts
        text, parts = squash(escape_inline(joined(parts))), []
        if text:
            out.extend([f"- {text}"] if is_item else ["", text, ""])

    for x, level in zip(page, heading_levels(page, body), strict=True):
        if level:
            close()
            out += ["", heading(level, squash(escape_inline(x.text))), ""]
            continue
        mark = BULLET.match(x.text) or NUMBER.match(x.text)
        if mark or not parts or is_item and x.left <= left + body * INDENT:
            close()
            is_item, left = bool(mark), x.left
        parts.append(x.text[mark.end():] if mark else x.text)
        if x.right - x.left < width * FULL_LINE:
            close()
    close()
    return out


def body_size(page_lines: list[Line]) -> float:
    """The half-point size with most characters, the first seen of equals; 12 without lines."""
    weight: dict[float, int] = {}
    for x in page_lines:
        half = int(x.size * 2 + 0.5) / 2
        weight[half] = weight.get(half, 0) + len(x.text)
    return (max(weight, key=weight.__getitem__) if weight else 0) or 12


def median_width(page_lines: list[Line]) -> float:
    widths = sorted(x.right - x.left for x in page_lines)
    return widths[len(widths) // 2] if widths else 0


def running(pages: list[list[list[Item]]]) -> set[str]:
    """Keys at the edges of at least half of the pages, and of three."""
    times: dict[str, int] = {}
    for page in pages:
        for key in {furniture_key(x.text) for r in edges(page) if (x := line(r))} - {""}:
            times[key] = times.get(key, 0) + 1
    return {k for k, n in times.items() if n >= max(3, -(-len(pages) // 2))}
