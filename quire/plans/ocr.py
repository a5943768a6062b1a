"""Recognised lines to paragraphs, a page at a time.

Lines: doc_id, page, group_ord, line_ord, text, confidence, x0, y0, x1, y1, first_word_width.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import recognition

_COLUMNS = ("text", "confidence", "x0", "y0", "x1", "y1", "first_word_width")


def repair_strokes(text: Column) -> Column:
    """A lone bar or l before a lower-case word is the pronoun I; two lone bars or more are a table's."""
    bars = F.size(F.regexp_extract_all(text, F.lit(r"((?:^|(?<=\s))\|(?=\s|$))"), F.lit(1)))
    fixed = F.regexp_replace(text, r"(^|[\s(\"'“‘])[|l](?=(?:['’](?:m|ve|ll|d|re)\b)?\s+[a-z])", "$1I")
    return F.when(bars >= 2, text).otherwise(fixed)


def line_heights(lines: DataFrame) -> DataFrame:
    """doc_id, page, height: the median height of a page's lines, 1 if that is 0."""
    h = lines.groupBy("doc_id", "page").agg(F.median(F.col("y1") - F.col("y0")).alias("height"))
    return h.withColumn("height", F.when(F.col("height") == 0, 1.0).otherwise(F.col("height")))


def paragraphs(lines: DataFrame) -> DataFrame:
    """doc_id, page, paragraphs (array) and discarded: how many were too uncertain to keep.

    Each line of a unit is judged against the unit's first, so a page's lines go
    through one function, in the order of groups and lines.
    """
    row = F.struct("group_ord", "line_ord", *_COLUMNS)
    pages = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(row)).alias("lines"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                found = batch.column(2)[k].as_py()
                groups = [[recognition.Line(*(x[c] for c in _COLUMNS)) for x in g] for _, g in groupby(found, key=lambda x: x["group_ord"])]
                out.append(recognition.paragraphs_of(groups))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p for p, _ in out], pa.list_(pa.string())), pa.array([n for _, n in out], pa.int64())], ["doc_id", "page", "paragraphs", "discarded"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.mapInArrow(task, f"doc_id {kinds['doc_id']}, page {kinds['page']}, paragraphs array<string>, discarded long")
