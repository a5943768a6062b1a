"""Quality by supervised subword embeddings.

Hashed word, word-pair and character n-gram vectors are averaged over a document
and go through a softmax layer; vectors and layer are learned by numpy stochastic
gradient descent.  Both are linear, so a trained model is kept as one number a
bucket: how much the bucket's vector moves the difference of the two classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .learning import adagrad_rows, char_ngrams, held_out, joined, labelled_sample, segment_sums, word_ngrams
from .store import arrow_map, table
from .tokens import slices

BITS, DIM, GRAMS, THRESHOLD = 17, 8, (3, 4), 0.7


def _parts(texts: list[str | None]):
    """(buckets, begin, end) of each kind of feature, with the ranges that hold each text's."""
    data, begin, end = joined(texts)
    starts, one, two = word_ngrams(data, BITS)
    a, b = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    yield one, a, b
    yield two, a, np.maximum(a, b - 1)
    for n in GRAMS:
        yield char_ngrams(data, n, BITS), begin, end


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([p[a[0] : b[0]].astype(np.int64) for p, a, b in _parts([text])])
    found, n = np.unique(ids, return_counts=True)
    return found, (n / max(1, len(ids))).astype(np.float32)


def train(sample: list[tuple[int, str, int]], epochs: int = 5, rate: float = 0.15) -> tuple[np.ndarray, float]:
    """A weight for each bucket and a bias; all zero if the sample lacks a class."""
    sample = [r for r in sample if r[2] in (0, 1)]
    if len({r[2] for r in sample}) < 2:
        return np.zeros(1 << BITS, np.float32), 0.0
    features, labels = [_counted(t) for _, t, _ in sample], np.array([y for _, _, y in sample])
    rng = np.random.default_rng(11)
    vectors = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.3, (2, DIM)).astype(np.float32), np.zeros(2, np.float32)
    seen, seen_layer, seen_bias = np.full(1 << BITS, 1e-10, np.float32), 1e-6, 1e-6
    share = np.bincount(labels, minlength=2) / len(labels)

    def step(k: int) -> None:
        nonlocal layer, bias, seen_layer, seen_bias
        ids, weight = features[k]
        rows = vectors[ids]
        hidden = weight @ rows
        z = layer @ hidden + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[labels[k]] -= 1
        g = (p * (0.5 / share[labels[k]])).astype(np.float32)
        back = g @ layer
        seen[ids] += weight**2 * float(back @ back)
        vectors[ids] = rows - rate * np.outer(weight / np.sqrt(seen[ids]), back)
        change = np.outer(g, hidden)
        seen_layer += float((change**2).sum())
        seen_bias += float(g @ g)
        layer = layer - rate * change / np.sqrt(seen_layer)
        bias = bias - rate * g / np.sqrt(seen_bias)

    adagrad_rows(features, step, epochs)
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def scores(texts: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    """The probability of class 1; a text without features has the bias alone."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for ids, begin, end in _parts(texts):
        total += segment_sums(weights[ids], begin, end)
        n += end - begin
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -30, 30)))


def classify(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with a score (0 to 1) and a prediction (1 if score >= threshold), under ``names``.

    Null and empty texts get the bias's score.  Other columns pass through; columns
    already named like that are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for part, texts in slices(batch):
                score = scores(texts, weights, bias)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*part.schema.names, *names])

    return arrow_map(kept, run, T.StructType([*kept.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]))


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    return train(labelled_sample(docs, labels.select("doc_id", F.col("quality").alias("label"))))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = classify(docs.select("doc_id", "text"), fitted(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op4_quality": op4_quality}
ORACLE_SQL: dict[str, str] = {}
