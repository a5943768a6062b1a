"""Labelled samples, the held-out rule, and hashed n-gram features shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import mix, range_hashes

#: Bounds of what a classifier is fitted on: labelled documents of each class and their characters (one document may
#: exceed them), and classes (the most frequent ones).
SAMPLE_A_CLASS, SAMPLE_CHARS, CLASSES = 2000, 12_000_000, 200


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, a_class: int = SAMPLE_A_CLASS) -> list[tuple[int, str, object]]:
    """Up to ``a_class`` documents of each label as (doc_id, text, label), none held out, by the hash of their ids.

    ``labels``: doc_id, label.  Rows with a null id, text or label are left out; of
    several labels of a document the largest counts, of several texts the least.  All
    labels are ranked in one pass: each task keeps the first of each label by hash.
    """
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    kinds = [r[0] for r in known.groupBy("label").count().orderBy(F.desc("count"), "label").limit(CLASSES).collect()]
    if not kinds:
        return []
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    first = known.where(F.col("label").isin(kinds)).withColumn("r", rank).where(F.col("r") <= a_class)
    sizes = docs.where("text IS NOT NULL").select("doc_id", F.length("text").alias("n")).join(F.broadcast(first), "doc_id").groupBy("doc_id", "label", "r").agg(F.max("n").alias("n"))
    before = Window.partitionBy("label").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ids = [tuple(r) for r in sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where((F.col("before") == 0) | (F.col("before") + F.col("n") <= SAMPLE_CHARS)).select("doc_id", "label").collect()]
    if not ids:
        return []
    chosen = docs.sparkSession.createDataFrame(ids, known.select("doc_id", "label").schema)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    return sorted((r.doc_id, r.text, r.label) for r in rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect())


def joined(texts: list[str | None], pad: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, each followed by ``pad`` line feeds, and where each begins and ends."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    begin = np.cumsum(sizes + pad) - sizes - pad
    return np.frombuffer((b"\n" * pad).join([*raw, b""]), np.uint8), begin, begin + sizes


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space; ``data`` must end with white space."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def char_ngrams(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A bucket for each position's next ``n`` bytes (up to 4); the last n - 1 positions have none."""
    packed = data[: len(data) - n + 1].astype(np.uint32)
    for k in range(1, n):
        packed |= data[k : len(data) - n + 1 + k].astype(np.uint32) << np.uint32(8 * k)
    return (packed * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)


def word_ngrams(data: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, a bucket for each word, and one for each word with the next; a word twice has a bucket of its own."""
    starts, ends = words(data)
    h = range_hashes(data, starts, ends)
    one = (h >> np.uint64(64 - bits)).astype(np.int64)
    after = np.roll(h, -1)
    two = (mix(h * np.uint64(3) + after) >> np.uint64(64 - bits)).astype(np.int64)
    two[h == after] = 0
    return starts, one, two


def segment_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of ``values[begin:end]`` along the first axis, 0 where empty."""
    out = np.zeros((len(begin), *values.shape[1:]), np.float64)
    full = np.flatnonzero(end > begin)
    if len(full):
        cuts = np.empty(2 * len(full), np.int64)
        cuts[0::2], cuts[1::2] = begin[full], end[full]
        if cuts[-1] == len(values):
            cuts = cuts[:-1]
        out[full] = np.add.reduceat(values, cuts, axis=0, dtype=np.float64)[0::2]
    return out


def adagrad_rows(features: list[tuple[np.ndarray, np.ndarray]], step, epochs: int, seed: int = 7):
    """Visits the documents in a seeded order, ``epochs`` times."""
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(features)):
            step(k)
