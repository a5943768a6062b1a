"""Page geometry as relational operators over positioned items and lines.

What needs a whole document (running titles, body size, median width) is a join or
an aggregate; what needs one page runs as a function of that page's row.  Relations:
items (doc_id, page, item_ord, text, x, y, width, size), lines (doc_id, page,
line_ord, text, size, top, left, right).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..sources import page_arrays
from ..sources import page_layout as page

EDGE_ROWS, LEAST_PAGES = page.EDGE_ROWS, 3
GAP_LINES = 1.5
#: Items of pages that are laid out together; one page with more still counts.
TOGETHER = 200_000
_LINE = "text string, size double, top double, left double, right double"
_ITEM = "struct<text:string,x:double,y:double,width:double,size:double>"


def _pages(items: DataFrame) -> DataFrame:
    """A row a page with its items in order."""
    row = F.struct("item_ord", "text", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "size")])
    return items.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(row)).alias("items")).select("doc_id", "page", F.transform("items", lambda i: i.dropFields("item_ord")).alias("items"))


def _each_page(pages: DataFrame, run: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
    """``run(items)`` gives rows (tuples) of a page; they follow doc_id and page."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc, n, items = (batch.column(c)[k].as_py() for c in range(3))
                rows = run([page.Item(**i) for i in items or []])
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
                head = [pa.array([v] * len(rows), batch.schema.field(c).type) for c, v in ((0, doc), (1, n))]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array(list(c), f.type) for c, f in zip(cols, arrow, strict=True))], ["doc_id", "page", *arrow.names])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("doc_id", "page", "items").mapInArrow(task, f"doc_id {kinds['doc_id']}, page {kinds['page']}, {schema}")


_ARROW_ITEMS = pa.list_(pa.struct([("text", pa.string()), *((c, pa.float64()) for c in ("x", "y", "width", "size"))]))
_ARROW_LINE = [("text", pa.string()), *((c, pa.float64()) for c in ("size", "top", "left", "right"))]


def page_rows(items: DataFrame) -> DataFrame:
    """Rows of items by baseline across the whole page: doc_id, page, row_ord (from 0), n_rows, a line's columns (null text without visible text) and the items."""

    def run(found: list) -> list[tuple]:
        rows = page.rows(found)
        return [(k, len(rows), *(page.line(r) or [None] * 5), [i._asdict() for i in r]) for k, r in enumerate(rows)]

    return _each_page(_pages(items), run, f"row_ord long, n_rows long, {_LINE}, items array<{_ITEM}>", pa.schema([("row_ord", pa.int64()), ("n_rows", pa.int64()), *_ARROW_LINE, ("items", _ARROW_ITEMS)]))


def item_lines(items: DataFrame) -> DataFrame:
    """Lines of a page read straight across: doc_id, page, line_ord and a line's columns."""
    rows = page_rows(items).where("text IS NOT NULL")
    return rows.withColumn("line_ord", F.col("row_ord")).select("doc_id", "page", "line_ord", "text", "size", "top", "left", "right")


def edge_rows(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("row_ord") < EDGE_ROWS) | (F.col("row_ord") >= F.col("n_rows") - EDGE_ROWS))


def repeated(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, key, times of edge texts on at least max(3, half) of a document's pages.  ``edges``: doc_id, page, text; ``pages``: doc_id, pages (all of them, empty ones too)."""
    keys = edges.select("doc_id", "page", md.furniture_key(F.col("text")).alias("key")).where("key <> ''").distinct()
    times = keys.groupBy("doc_id", "key").agg(F.count("*").alias("times")).join(pages, "doc_id")
    return times.where(F.col("times") >= F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("pages") / 2))).select("doc_id", "key", "times")


def furniture(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``repeated`` of lines (doc_id, page, line_ord, text); pages without lines count if ``pages`` (doc_id, pages) tells of them."""
    w = Window.partitionBy("doc_id", "page")
    rows = lines.withColumn("n_rows", F.count("*").over(w)).withColumn("row_ord", F.row_number().over(w.orderBy("line_ord")) - 1)
    return repeated(edge_rows(rows), lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages")) if pages is None else pages)


def without_furniture(rows: DataFrame, running: DataFrame) -> DataFrame:
    """``rows`` (of ``page_rows``) but the edge rows whose text runs: an anti join on the key."""
    at_edge = (F.col("row_ord") < EDGE_ROWS) | (F.col("row_ord") >= F.col("n_rows") - EDGE_ROWS)
    keyed = rows.withColumn("key", F.when(at_edge, md.furniture_key(F.coalesce("text", F.lit("")))))
    return keyed.join(running.select("doc_id", "key"), ["doc_id", "key"], "left_anti").drop("key")


def _together(pages: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Some pages at a time, with about ``TOGETHER`` items."""
    ahead = np.cumsum(pc.fill_null(pc.list_value_length(pages.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    k = 0
    while k < len(ahead):
        end = max(k + 1, int(np.searchsorted(ahead, (ahead[k - 1] if k else 0) + TOGETHER, "right")))
        yield pages.slice(k, end - k)
        k = end


def lines_in_order(pages: DataFrame) -> DataFrame:
    """Lines in reading order, columns between banners: doc_id, page, line_ord (from 0) and a line's columns, of a row a page with its items (an array of text, x, y, width and size)."""
    item = lambda i: F.struct(i["text"].alias("text"), *[i[c].cast("double").alias(c) for c in ("x", "y", "width", "size")])
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    if kinds["items"] != f"array<{_ITEM}>":
        pages = pages.withColumn("items", F.transform("items", item))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _together(batch):
                held = pc.fill_null(pc.list_value_length(some.column(2)), 0).to_numpy(zero_copy_only=False)
                text, *rest = some.column(2).flatten().flatten()
                items = page_arrays.Items(np.repeat(np.arange(len(held)), held), pc.fill_null(text.cast(pa.string()), ""), *(c.to_numpy(zero_copy_only=False) for c in rest))
                for found in page_arrays.reading_order(items, len(held)):
                    at, n = pa.array(found.group), np.bincount(found.group, minlength=len(held))
                    k = np.arange(len(found.group)) - np.repeat(np.cumsum(n) - n, n)
                    yield pa.RecordBatch.from_arrays([some.column(0).take(at), some.column(1).take(at), pa.array(k, pa.int64()), found.text, *(pa.array(c, pa.float64()) for c in found[2:])], ["doc_id", "page", "line_ord", *(c for c, _ in _ARROW_LINE)])

    return pages.select("doc_id", "page", "items").mapInArrow(task, f"doc_id {kinds['doc_id']}, page {kinds['page']}, line_ord long, {_LINE}")


def reading_order(rows: DataFrame) -> DataFrame:
    """``lines_in_order`` of rows with their items, what is left of ``page_rows``."""
    back = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("row_ord", "items"))).alias("rows"))
    return lines_in_order(back.select("doc_id", "page", F.flatten(F.transform("rows", lambda r: r["items"])).alias("items")))


def page_columns(items: DataFrame) -> DataFrame:
    """doc_id, page, gutter (x), ord (from 0) of the strips that part a page's columns."""
    return _each_page(_pages(items), lambda found: list(enumerate(page.gutters(found))) if found else [], "ord long, gutter double", pa.schema([("ord", pa.int64()), ("gutter", pa.float64())]))


def column_of(items: DataFrame, gutters: DataFrame) -> DataFrame:
    """``items`` with their column (from 0): how many gutters stand at or left of an item's middle, by a band join within its page."""
    middle = F.col("x") + F.col("width") / 2
    left = items.withColumn("middle", middle)
    hits = left.join(gutters.select("doc_id", "page", "gutter"), ["doc_id", "page"]).where("gutter <= middle").groupBy("doc_id", "page", "item_ord").agg(F.count("*").alias("column"))
    return items.join(hits, ["doc_id", "page", "item_ord"], "left").withColumn("column", F.coalesce("column", F.lit(0)))


def body_size(lines: DataFrame) -> DataFrame:
    """doc_id, body_size: the half-point size with most characters, the first seen of equals."""
    half = (F.floor(F.col("size") * 2 + 0.5) / 2).alias("half")
    g = lines.select("doc_id", half, F.length("text").alias("chars"), "page", "line_ord").groupBy("doc_id", "half").agg(F.sum("chars").alias("chars"), F.min(F.struct("page", "line_ord")).alias("first"))
    best = g.groupBy("doc_id").agg(F.max_by("half", F.struct("chars", (-F.col("first.page")).alias("p"), (-F.col("first.line_ord")).alias("l"))).alias("body_size"))
    return best.select("doc_id", F.when(F.col("body_size") == 0, 12.0).otherwise(F.col("body_size")).alias("body_size"))


def upper_median_width(lines: DataFrame) -> DataFrame:
    w = lines.withColumn("w", F.col("right") - F.col("left"))
    r, n = F.row_number().over(Window.partitionBy("doc_id").orderBy("w")), F.count("*").over(Window.partitionBy("doc_id"))
    return w.withColumn("r", r).withColumn("n", n).where("r = floor(n / 2) + 1").select("doc_id", F.col("w").alias("median_width"))


def gap_groups(lines: DataFrame) -> DataFrame:
    """``lines`` (doc_id, line_ord, y0, y1, lh) with unit: a new one after a gap of more than 1.5 line heights."""
    w = Window.partitionBy("doc_id").orderBy("line_ord")
    new = F.when(F.col("y0") - F.lag("y1").over(w) > GAP_LINES * F.col("lh"), 1).otherwise(0)
    return lines.withColumn("new", new).withColumn("unit", F.sum("new").over(w).cast("long")).drop("new")


def heading_levels(lines: DataFrame, body: DataFrame) -> DataFrame:
    """``lines`` with level by size against the body's: none over 120 characters, nor where more than two headings of one size follow one another."""
    j = lines.join(body, "doc_id")
    ratio, level = F.col("size") / F.col("body_size"), F.when(F.length("text") > page.LONGEST_HEADING, None)
    for least, k in page.HEADINGS:
        level = level.when(ratio >= least, k)
    j = j.withColumn("level", level.cast("int"))
    w = Window.partitionBy("doc_id", "page").orderBy("line_ord")
    same = F.col("level").isNotNull() & F.lag("level").over(w).isNotNull() & (F.lag("size").over(w) == F.col("size"))
    j = j.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    n = F.count("*").over(Window.partitionBy("doc_id", "page", "run"))
    return j.withColumn("n", n).select("doc_id", "page", "line_ord", "text", F.when(F.col("n") <= page.LONGEST_RUN, F.col("level")).alias("level"))


def page_blocks(lines: DataFrame, body: DataFrame, width: DataFrame) -> DataFrame:
    """doc_id, page, ord (from 0) and markdown of a page's headings, list items and paragraphs."""
    row = F.struct("line_ord", "text", "size", "top", "left", "right")
    pages = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(row)).alias("lines")).join(body, "doc_id").join(width, "doc_id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc, n, found, size, wide = (batch.column(c)[k].as_py() for c in range(5))
                out = [x for x in page.render([page.Line(*list(x.values())[1:]) for x in found], size, wide) if x]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(out), batch.schema.field(0).type), pa.array([n] * len(out), batch.schema.field(1).type), pa.array(range(len(out)), pa.int64()), pa.array(out, pa.string())], ["doc_id", "page", "ord", "markdown"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("doc_id", "page", "lines", "body_size", "median_width").mapInArrow(task, f"doc_id {kinds['doc_id']}, page {kinds['page']}, ord long, markdown string")


def documents(items: DataFrame) -> DataFrame:
    """doc_id, markdown of whole documents, of items alone: rows, running titles, columns, headings and paragraphs in turn."""
    rows = page_rows(items)
    pages = items.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    lines = reading_order(without_furniture(rows, repeated(edge_rows(rows).where("text IS NOT NULL"), pages)))
    blocks = page_blocks(lines, body_size(lines), upper_median_width(lines))
    # Items of a list stand on lines of their own; everything else is parted by a blank line.
    w = Window.partitionBy("doc_id").orderBy("page", "ord")
    lead = F.when(F.col("markdown").startswith("- ") & F.lag("markdown").over(w).startswith("- "), "\n").otherwise("\n\n")
    told = blocks.withColumn("lead", F.when(F.row_number().over(w) == 1, "").otherwise(lead))
    told = told.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "ord", F.concat("lead", "markdown").alias("said")))).alias("all"))
    return told.select("doc_id", F.array_join(F.transform("all", lambda x: x["said"]), "").alias("markdown"))
