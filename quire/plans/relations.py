"""Look-ups between the parts of documents, as joins over the intermediate relations.

rels (doc_id, part, rid, target, type, external), refs (doc_id, part, ord, rid, text),
parts (doc_id, path), sheets (doc_id, tab_ord, name, hidden, part_path), cell_refs
(doc_id, sheet, named), manifest (doc_id, id, href, media_type, properties), spine
(doc_id, ord, idref), rows (doc_id, row_ord, repeat, cells), mime_parts (doc_id,
part_id, parent_id, content_type).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown as md

#: Copies that one repeat count stands for at most, and forwarded messages that are followed.
MOST_REPEATS, DEEPEST = 4096, 4


def hyperlinks(refs: DataFrame, rels: DataFrame) -> DataFrame:
    """doc_id, part, ord and markdown: a left join, so that a reference without a target keeps its text."""
    found = refs.join(rels.select("doc_id", "part", "rid", "target"), ["doc_id", "part", "rid"], "left")
    link = F.concat(F.lit("["), "text", F.lit("]("), "target", F.lit(")"))
    return found.select("doc_id", "part", "ord", F.when(F.col("target").isNotNull() & (md.trim(F.col("text")) != ""), link).otherwise(F.col("text")).alias("markdown"))


def resolved(rels: DataFrame) -> DataFrame:
    """``rels`` with path: the part an internal target names, relative to its own part's folder; null if external."""
    folder = F.regexp_extract("part", r"^((?:.*/)?)[^/]*$", 1)
    joined = F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat(folder, "target"))
    step = lambda kept, s: F.when((s == "") | (s == "."), kept).when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s)))
    path = F.array_join(F.aggregate(F.split(joined, "/"), F.expr("cast(array() as array<string>)"), step), "/")
    return rels.withColumn("path", F.when(~F.coalesce("external", F.lit(False)), path))


def part_images(refs: DataFrame, rels: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, part, ord, path of the images that references name: reference to relationship to existing part, metafiles left out."""
    at = resolved(rels).select("doc_id", "part", "rid", "path").where("path IS NOT NULL")
    found = refs.join(at, ["doc_id", "part", "rid"]).join(parts.select("doc_id", "path"), ["doc_id", "path"], "left_semi")
    return found.where(md.image_extension(F.col("path")).isNotNull()).select("doc_id", "part", "ord", "path")


def sheet_key(name):
    return F.lower(md.trim(name))


def kept_sheets(sheets: DataFrame, cell_refs: DataFrame, hidden: bool = False) -> DataFrame:
    """``sheets`` that are converted: visible ones, and hidden ones that a visible sheet's formulas name (a semi join); all with ``hidden``."""
    if hidden:
        return sheets
    keyed = sheets.withColumn("key", sheet_key(F.col("name")))
    visible = sheets.where("NOT hidden").select("doc_id", F.col("name").alias("sheet"))
    named = cell_refs.join(visible, ["doc_id", "sheet"], "left_semi").select("doc_id", sheet_key(F.col("named")).alias("key"))
    used = keyed.where("hidden").join(named, ["doc_id", "key"], "left_semi")
    return keyed.where("NOT hidden").unionByName(used).drop("key")


def skipped_sheets(sheets: DataFrame, kept: DataFrame) -> DataFrame:
    """doc_id, names: the sheets left out, in tab order."""
    out = sheets.join(kept.select("doc_id", "tab_ord"), ["doc_id", "tab_ord"], "left_anti")
    names = F.array_sort(F.collect_list(F.struct("tab_ord", "name")))
    return out.groupBy("doc_id").agg(F.array_join(F.transform(names, lambda x: x["name"]), ", ").alias("names"))


def chapters(manifest: DataFrame, spine: DataFrame) -> DataFrame:
    """doc_id, ord, href of a book's chapters in reading order; entries that the manifest lacks are left out."""
    return spine.join(manifest.select("doc_id", F.col("id").alias("idref"), "href"), ["doc_id", "idref"]).select("doc_id", "ord", "href")


def unused_documents(manifest: DataFrame, spine: DataFrame) -> DataFrame:
    """doc_id, href of text documents outside the reading order, contents pages excepted: an anti join."""
    text = manifest.where(F.col("media_type").contains("html") & ~F.array_contains(F.split(F.coalesce("properties", F.lit("")), r"\s+"), "nav"))
    return text.join(spine.select("doc_id", F.col("idref").alias("id")), ["doc_id", "id"], "left_anti").select("doc_id", "href")


def expanded_rows(rows: DataFrame) -> DataFrame:
    """doc_id, row_ord (from 0), cells: every row as often as it repeats, without the empty rows at the end."""
    copies = F.least(F.greatest(F.coalesce("repeat", F.lit(1)), F.lit(1)), F.lit(MOST_REPEATS))
    empty = F.forall("cells", lambda c: md.trim(c) == "")
    last = rows.where(~empty).groupBy("doc_id").agg(F.max("row_ord").alias("last"))
    filled = rows.join(last, "doc_id").where("row_ord <= last")
    before = Window.partitionBy("doc_id").orderBy("row_ord").rowsBetween(Window.unboundedPreceding, -1)
    at = filled.withColumn("copies", copies).withColumn("before", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    return at.select("doc_id", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("copies") - 1)).alias("row_ord"), "cells")


def same_words(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct texts that two relations of one column share, and those of the first alone: (text, shared)."""
    both = a.intersect(b).withColumn("shared", F.lit(True))
    return both.unionByName(a.subtract(b).withColumn("shared", F.lit(False)))


def mime_depths(parts: DataFrame) -> DataFrame:
    """doc_id, part_id, depth: how many forwarded messages a part stands in, followed from parent to parent; deeper ones are left out."""
    known = parts.where("parent_id IS NULL").select("doc_id", "part_id", F.lit(0).alias("depth"))
    found, level = known, known
    step = parts.where("parent_id IS NOT NULL").select("doc_id", "part_id", "parent_id", F.when(F.col("content_type") == "message/rfc822", 1).otherwise(0).alias("more"))
    while True:
        level = step.join(level.select("doc_id", F.col("part_id").alias("parent_id"), "depth"), ["doc_id", "parent_id"])
        level = level.select("doc_id", "part_id", (F.col("depth") + F.col("more")).alias("depth")).where(F.col("depth") <= DEEPEST)
        if level.isEmpty():
            return found
        found = found.unionByName(level)
