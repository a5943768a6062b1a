"""``page_layout.reading_order`` of many pages at once, over arrays of their items.

Items are told apart by ``group`` (ascending integers): pages, or columns of pages.  What
goes on from item to item of a page goes on in all pages in step.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import page_layout as page
from .lines import WS

_WS = pa.array(list(WS))
#: Units of pages' widths that are looked at together; one wider page still counts.
CELLS = 4_000_000


class Items(NamedTuple):
    group: np.ndarray
    text: pa.StringArray
    x: np.ndarray
    y: np.ndarray
    width: np.ndarray
    size: np.ndarray

    def at(self, where: np.ndarray) -> Items:
        """The items by number, or those that a mask keeps."""
        if where.dtype == bool:
            return self if where.all() else self.at(np.flatnonzero(where))
        return Items(self.group[where], self.text.take(pa.array(where)), *(c[where] for c in self[2:]))


class Lines(NamedTuple):
    group: np.ndarray
    text: pa.StringArray
    size: np.ndarray
    top: np.ndarray
    left: np.ndarray
    right: np.ndarray


def _starts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, int)


def _ends(starts: np.ndarray, n: int) -> np.ndarray:
    return np.append(starts[1:], n) if n else starts


def _steps(starts: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The numbers of the second members of all runs, then of the third, and so on, each with the numbers of the runs."""
    lengths = _ends(starts, n) - starts
    longest = np.argsort(-lengths, kind="stable")
    begin, left = starts[longest], -lengths[longest]
    for j in range(1, int(-left[0]) if len(left) else 0):
        k = np.searchsorted(left, -j, "left")
        yield begin[:k] + j, longest[:k]


def rows(items: Items) -> tuple[Items, np.ndarray]:
    """Items with text in order of rows, and where rows begin, as ``page_layout.rows``."""
    items = items.at(pc.not_equal(items.text, "").to_numpy(zero_copy_only=False))
    same = items.group[1:] == items.group[:-1]
    if (items.group[1:] < items.group[:-1]).any() or (same & ((items.y[1:] > items.y[:-1]) | (items.y[1:] == items.y[:-1]) & (items.x[1:] < items.x[:-1]))).any():
        items = items.at(np.lexsort((items.x, -items.y, items.group)))
    starts = _starts(items.group)
    y, size, new = items.y[starts], items.size[starts], np.zeros(len(items.group), bool)
    new[starts] = True
    for at, run in _steps(starts, len(new)):
        fresh = np.abs(items.y[at] - y[run]) > np.maximum(size[run], items.size[at]) * page.SAME_ROW
        new[at] = fresh
        y[run[fresh]], size[run[fresh]] = items.y[at[fresh]], items.size[at[fresh]]
    if (~new[1:] & (items.x[1:] < items.x[:-1])).any():
        items = items.at(np.lexsort((items.x, np.cumsum(new))))
    return items, np.flatnonzero(new)


def lines(items: Items, starts: np.ndarray) -> Lines:
    """Rows as lines, those without visible text left out, as ``page_layout.line``."""
    if not len(starts):
        return Lines(items.group, items.text, *[np.zeros(0)] * 4)
    text, end = items.text, items.x + items.width
    first = pc.is_in(pc.utf8_slice_codeunits(text, 0, 1), _WS).to_numpy(zero_copy_only=False)
    gap = np.append(False, items.x[1:] - end[:-1] > items.size[1:] * page.BLANK) & ~first
    gap[starts] = False
    at = np.flatnonzero(gap)
    gap[at] = ~pc.is_in(pc.utf8_slice_codeunits(text.take(pa.array(at - 1)), -1), _WS).to_numpy(zero_copy_only=False)
    said = pc.binary_join_element_wise(pa.array(["", " "]).take(pa.array(gap.astype(np.int8))), text, "") if gap.any() else text
    _, offsets, data = said.buffers()
    offsets = np.frombuffer(offsets, np.int32)[said.offset : said.offset + len(said) + 1]
    whole = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets[np.append(starts, len(said))]), data)
    blank = first.copy()
    at = np.flatnonzero(first)
    blank[at] = pc.equal(pc.utf8_trim(text.take(pa.array(at)), WS), "").to_numpy(zero_copy_only=False)
    out = Lines(items.group[starts], whole, np.maximum.reduceat(items.size, starts), items.y[starts], items.x[starts], np.maximum.reduceat(end, starts))
    return _where(out, ~np.logical_and.reduceat(blank, starts))


def _where(found: Lines, kept: np.ndarray) -> Lines:
    return found if kept.all() else Lines(found.group[kept], found.text.filter(pa.array(kept)), *(c[kept] for c in found[2:]))


def gutters(items: Items, wanted: np.ndarray) -> dict[int, list[float]]:
    """Gutters that leave no narrow column, by group, of the groups in ``wanted``; whether their columns hold lines is not seen."""
    items = items.at(wanted[items.group])
    starts = _starts(items.group)
    if not len(starts):
        return {}
    group, n_items = items.group[starts], _ends(starts, len(items.group)) - starts
    left, right = np.minimum.reduceat(items.x, starts), np.maximum.reduceat(items.x + items.width, starts)
    n = np.maximum(np.ceil(right - left), 0).astype(np.int64)
    found: dict[int, list[float]] = {}
    done, ahead = 0, np.cumsum(n + 1)
    while done < len(n):
        last = max(done + 1, int(np.searchsorted(ahead, (ahead[done - 1] if done else 0) + CELLS, "right")))
        part, one = slice(done, last), slice(starts[done], starts[last] if last < len(starts) else len(items.group))
        of = np.repeat(np.arange(last - done), n_items[part])
        wide, side = n[part], left[part]
        base = np.append(0, np.cumsum(wide + 1))
        a = np.maximum(0, np.floor(items.x[one] - side[of])).astype(np.int64)
        b = np.minimum(wide[of], np.ceil(items.x[one] + items.width[one] - side[of]).astype(np.int64))
        inked = b > a
        ink = np.cumsum(np.bincount(base[of[inked]] + a[inked], minlength=base[-1]) - np.bincount(base[of[inked]] + b[inked], minlength=base[-1]))
        most = np.maximum.reduceat(ink, base[:-1])
        clear = (ink <= np.repeat(most * page.GUTTER_INK, wide + 1)) & np.repeat(most > 0, wide + 1)
        clear[base[1:] - 1] = False  # the unit after a page's last
        turns = np.flatnonzero(np.append(clear[:1], clear[1:] != clear[:-1]))
        begin, end = turns[::2], turns[1::2]
        of = np.searchsorted(base, begin, "right") - 1
        begin, end = begin - base[of], end - base[of]
        kept = (begin > 0) & (end < wide[of]) & (end - begin >= page.MIN_GUTTER)
        for k, g in zip(of[kept].tolist(), (side[of] + (begin + end) / 2)[kept].tolist(), strict=True):
            found.setdefault(done + k, []).append(g)
        done = last
    wide_enough = ((k, page.wide_columns(at, float(left[k]), float(right[k]))) for k, at in found.items())
    return {int(group[k]): at for k, at in wide_enough if at}


def banners(items: Items, starts: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether a row's run without a wide gap lies across a gutter; ``at[place[group]]`` are its page's gutters, infinite beyond the last."""
    mine = at[place[items.group[starts]]]
    begin, end, across = items.x[starts], items.x[starts] + items.width[starts], np.zeros(len(starts), bool)
    lies = lambda r: ((begin[r, None] < mine[r] - page.SPAN_TOLERANCE) & (end[r, None] > mine[r] + page.SPAN_TOLERANCE)).any(1)
    for i, run in _steps(starts, len(items.group)):
        over = items.x[i] - end[run] >= page.MIN_GUTTER
        parted = run[over]
        across[parted] |= lies(parted)
        begin[parted] = items.x[i[over]]
        end[run] = np.maximum(end[run], items.x[i] + items.width[i])
    return across | lies(np.arange(len(starts)))


def reading_order(items: Items, n_pages: int) -> Iterator[Lines]:
    """The lines of ``n_pages`` pages (groups from 0, ascending), each page's in reading order and in one of the results; pages with banners one by one."""
    placed, starts = rows(items)
    straight = lines(placed, starts)
    found = gutters(items, np.bincount(straight.group, minlength=n_pages) >= page.MIN_LINES)
    if not found:
        yield straight
        return
    pages, most = np.array(list(found)), max(map(len, found.values()))
    at, place = np.full((len(pages), most), np.inf), np.full(n_pages, -1)
    place[pages] = np.arange(len(pages))
    for k, g in enumerate(found.values()):
        at[k, : len(g)] = g
    mine = items.at(place[items.group] >= 0)
    column = ((mine.x + mine.width / 2)[:, None] >= at[place[mine.group]]).sum(1)
    columns = lines(*rows(mine._replace(group=mine.group * (most + 1) + column)))
    held = np.bincount(columns.group, minlength=n_pages * (most + 1)).reshape(n_pages, -1)[pages] >= page.MIN_COLUMN_LINES
    real = np.zeros(n_pages, bool)
    real[pages] = (held | np.column_stack([np.zeros(len(pages), bool), np.isinf(at)])).all(1)
    yield _where(straight, ~real[straight.group])
    row_page = placed.group[starts]
    inside = real[placed.group]
    part = placed.at(inside)
    number = np.cumsum(inside) - 1
    begin = number[starts[real[row_page]]]
    crossed = np.zeros(n_pages, bool)
    if len(begin):
        crossed[part.group[begin][banners(part, begin, at, place)]] = True
    columns = columns._replace(group=columns.group // (most + 1))
    yield _where(columns, (real & ~crossed)[columns.group])
    for k in np.flatnonzero(crossed).tolist():
        a, b = np.searchsorted(items.group, [k, k + 1])
        out = page.reading_order([page.Item(*i) for i in zip(items.text[a:b].to_pylist(), *(c[a:b].tolist() for c in items[2:]), strict=True)])
        if out:
            text, *rest = zip(*out, strict=True)
            yield Lines(np.full(len(out), k), pa.array(text, pa.string()), *(np.array(c) for c in rest))
