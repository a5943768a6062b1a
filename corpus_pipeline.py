"""Documents to packed training sequences in five stages.

Each stage reads what the one before has written.  All but the last return the
columns of ``documents``; extra columns of the input pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import contamination, jaccard, packing, pii, quality
from quire.llm.store import table, written
from quire.llm.tokens import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the threshold or above stay; null and empty texts are scored like any other."""
    names = tuple(fresh(docs, c) for c in ("score", "keep"))
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model, names=names).where(F.col(names[1]) == 1).drop(*names)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` lacks."""
    while name in docs.columns:
        name = "_" + name
    return name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays.

    Rows with one doc_id are parts of one document: all its different texts stay, equal
    rows once.  Rows with a null doc_id stay all, as they belong to no group.
    """
    found = written(jaccard.similar(docs).where("doc_id IS NOT NULL"), "near")
    keep = found.where("component_id = doc_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL")
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():
        named = named.dropDuplicates(["doc_id", "text"])
    return named.join(jaccard.small(keep), "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go; rows without a doc_id are told apart by their text."""
    key = fresh(docs, "key")
    keyed = docs.withColumn(key, F.when(F.col("doc_id").isNull(), F.sha2(F.coalesce("text", F.lit("")), 256)))
    found = contamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    hit = written(found.where("doc_id IS NOT NULL").select("doc_id").distinct(), "leaks")
    out = keyed.where("doc_id IS NOT NULL").join(jaccard.small(hit), "doc_id", "left_anti").select(docs.columns)
    nameless = keyed.where("doc_id IS NULL")
    if nameless.isEmpty():
        return out
    texts = written(nameless.groupBy(key).agg(F.min("text").alias("text")).withColumn("doc_id", F.monotonically_increasing_id()), "nameless")
    leaks = contamination.contaminated(texts, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    clean = texts.join(leaks, "doc_id", "left_anti").select(key)
    return out.unionByName(nameless.join(clean, key, "left_semi").select(docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets in texts are replaced by their kind; n_chars follows the new text, null texts stay null."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a power-of-two piece of a document, with its ids; null and empty texts hold the end id alone."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("packing", packed),
]

#: No SQL expresses the trained classifier, the tokenizer or the alignment; tests/llm/test_pipeline.py compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
