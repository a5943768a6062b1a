"""Note assembly, naming and collisions as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..operators.options import Options, output_folder


def compose(notes: DataFrame, options: Options = Options(), converted: Column | None = None) -> DataFrame:
    """``notes`` with a column ``note``: front matter, body (or a placeholder) and a callout with the warnings.

    The source is linked by a column ``link`` (see ``source_links``) if there is one,
    else by its path; ``converted`` adds the time of conversion.
    """
    link = F.col("link") if "link" in notes.columns else F.col("path")
    head = [F.concat(F.lit("source: "), md.yaml_value(F.concat(F.lit("[["), link, F.lit("]]")))), F.concat(F.lit("source_format: "), F.col("ext"))]
    head += [F.concat(F.lit("converted: "), F.date_format(converted, "yyyy-MM-dd HH:mm"))] if converted is not None else []
    front = F.concat(F.array(*head), F.transform("frontmatter", lambda f: F.concat(f["key"], F.lit(": "), md.yaml_value(f["value"]))))
    body = F.when(md.trim(F.coalesce("markdown", F.lit(""))) == "", F.lit("*(no text content found)*")).otherwise(F.col("markdown"))
    said = F.when(F.size("warnings") > 0, F.concat(F.lit("> [!info]- Conversion notes\n"), F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("> - "), w)), "\n")))
    parts = ([F.concat(F.lit("---\n"), F.array_join(front, "\n"), F.lit("\n---"))] if options.add_frontmatter else []) + [body] + ([said] if options.add_conversion_notes else [])
    return notes.withColumn("note", F.when(F.col("error").isNull(), F.concat(F.concat_ws("\n\n", *parts), F.lit("\n"))))


def linked(notes: DataFrame) -> DataFrame:
    """``notes`` with the link of each source: a name that several files have is given with its path."""
    return notes.join(source_links(notes.select("path")), "path", "left")


def placed(notes: DataFrame, options: Options = Options()) -> DataFrame:
    """``notes`` with note_path: in the source's folder or the one that the options name, each path once."""
    folder = F.regexp_extract("path", r"^((?:.*/)?)[^/]+$", 1) if options.output_location == "sameFolder" else F.lit(output_folder(options, "") + "/")
    base = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    named = notes.withColumn("folder", folder).withColumn("base", base)
    k = F.row_number().over(Window.partitionBy("folder", "base").orderBy("path"))
    return named.withColumn("k", k).withColumn("note_path", F.concat("folder", "base", F.when(F.col("k") > 1, F.concat(F.lit(" "), F.col("k"))).otherwise(""), F.lit(".md"))).drop("folder", "base", "k")


def attachments(notes: DataFrame) -> DataFrame:
    """asset_path and data of every kept image: a folder beside the note, named after it."""
    folder = F.concat(F.regexp_replace("note_path", r"\.md$", ""), F.lit(" attachments/"))
    return notes.select(folder.alias("folder"), F.explode("assets").alias("a")).select(F.concat("folder", "a.name").alias("asset_path"), "a.data")


def source_links(files: DataFrame) -> DataFrame:
    """path and link: the bare file name, or the whole path where another file has that name."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    times = files.select("path", name.alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return files.select("path", name.alias("name")).join(times, "name").select("path", F.when(F.col("n") > 1, F.col("path")).otherwise(F.col("name")).alias("link"))


def note_paths(files: DataFrame) -> DataFrame:
    """path and note_path: folder and base name with .md; the second of a name gets " 2", the third " 3"."""
    parts = files.select("path", F.regexp_extract("path", r"^((?:.*/)?)[^/]+$", 1).alias("folder"), F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "").alias("base"))
    k = F.row_number().over(Window.partitionBy("folder", "base").orderBy("path"))
    return parts.withColumn("k", k).select("path", F.concat("folder", "base", F.when(F.col("k") > 1, F.concat(F.lit(" "), F.col("k"))).otherwise(""), F.lit(".md")).alias("note_path"))


def asset_names(images: DataFrame) -> DataFrame:
    """``images``: doc_id, ord, ext, data.  With name: number of the distinct bytes in order of first use, and their hash."""
    hashed = images.withColumn("sha1", F.sha1("data"))
    first = hashed.groupBy("doc_id", "sha1").agg(F.min("ord").alias("first"), F.min_by("ext", "ord").alias("kept_ext"))
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")))
    named = F.format_string("image-%d-%s.%s", "n", F.substring("sha1", 1, 8), "kept_ext")
    return hashed.drop("data").join(first, ["doc_id", "sha1"]).select("doc_id", "ord", "sha1", named.alias("name"))
