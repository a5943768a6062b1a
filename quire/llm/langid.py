"""Language identification by error-correcting output codes.

Every language has a codeword.  One binary classifier over hashed character
n-grams predicts each bit; decoding adds up each bit's logistic loss against a
codeword, weighted by how well that bit did in training, and takes the nearest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import adagrad_rows, char_ngrams, held_out, joined, labelled_sample, segment_sums
from .store import arrow_map, table
from .tokens import slices

BITS, GRAMS, UNKNOWN = 14, (1, 2, 3), "und"
#: Below this lead of the nearest codeword's probability over the next one's, a document is flagged as ambiguous.
LEAD = 0.2
_LETTER = re.compile(r"[^\W\d_]")


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """Rows of +1 and -1, one a class: every way to part the classes in two for up to 5 of them, else the best of seeded random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1 if (k >> c) & 1 else -1 for k in range(1, 1 << n) if not k & 1] for c in range(n)], float)[:, : (1 << (n - 1)) - 1]
    rng, width, best, far = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width))
        least = int(((width - code @ code.T) / 2 + width * np.eye(n)).min())
        if least > far and (abs(code.sum(0)) < n).all():
            best, far = code, least
    return best if best is not None else code


@dataclass
class Model:
    names: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray


def _buckets(data: np.ndarray) -> list[np.ndarray]:
    """The bytes' n-grams without letter case, one array an order."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    return [char_ngrams(low, n, BITS) for n in GRAMS]


def train(sample: list[tuple[int, str, str]], epochs: int = 3, rate: float = 0.3) -> Model:
    """Bit classifiers by logistic regression; an empty sample gives a model that knows no language."""
    names = sorted({r[2] for r in sample})
    code = codewords(len(names))
    width = code.shape[1] if len(names) else 1
    weights, bias = np.zeros((1 << BITS, width), np.float32), np.zeros(width)
    if len(names) < 2:
        return Model(names, code.reshape(len(names), width), weights, bias, np.full(width, 1 / width))
    features = []
    for _, text, _ in sample:
        data, begin, end = joined([text])
        ids = np.concatenate([b[begin[0] : end[0]].astype(np.int64) for b in _buckets(data)])
        found, n = np.unique(ids, return_counts=True)
        features.append((found, (n / max(1, len(ids))).astype(np.float32)))
    target = code[[names.index(r[2]) for r in sample]]
    seen, seen_bias = np.full(1 << BITS, 1e-10, np.float32), 1e-6

    def step(k: int) -> None:
        nonlocal bias, seen_bias
        ids, weight = features[k]
        rows = weights[ids]
        g = -target[k] / (1 + np.exp(np.clip(target[k] * (weight @ rows + bias), -30, 30)))
        seen[ids] += weight**2 * float(g @ g)
        weights[ids] = rows - rate * np.outer(weight / np.sqrt(seen[ids]), g)
        seen_bias += float(g @ g)
        bias = bias - rate * g / np.sqrt(seen_bias)

    adagrad_rows(features, step, epochs)
    margin = np.array([w @ weights[i] + bias for i, w in features])
    right = np.clip(((margin * target) > 0).mean(0), 0.5, 0.999)
    trust = np.log(right / (1 - right)) + 1e-3
    return Model(names, code, weights, bias, trust / trust.sum())


def decode(margin: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, its probability (softmax of the negative weighted losses, all bits counted) and the lead over the next."""
    loss = np.logaddexp(0, -margin[:, None, :] * model.code[None]) @ (model.trust * len(model.trust))
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    ranked = np.sort(p, 1)
    return p.argmax(1), ranked[:, -1], ranked[:, -1] - (ranked[:, -2] if p.shape[1] > 1 else 0)


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    data, begin, end = joined(texts)
    total, n = np.zeros((len(texts), len(model.bias))), np.zeros(len(texts))
    for ids in _buckets(data):
        total += segment_sums(model.weights[ids], begin, np.minimum(end, len(ids)))
        n += end - begin
    best, score, lead = decode(total / np.maximum(n, 1)[:, None] + model.bias, model) if model.names else (np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts)))
    blank = np.array([not model.names or not t or not _LETTER.search(t) for t in texts], bool)
    score, lead = np.where(blank, 0.0, score), np.where(blank, 0.0, lead)
    return [UNKNOWN if b else model.names[k] for b, k in zip(blank, best, strict=True)], score, lead < LEAD


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and ambiguous for every row of ``docs``.

    ``und`` with score 0, ambiguous, where the text is null or has no letter, or the
    model knows no language.  Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                lang, score, unsure = predict(texts, shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def fitted(docs: DataFrame) -> Model:
    return train(labelled_sample(docs, docs.select("doc_id", F.col("lang").alias("label")), a_class=800))


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fitted(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op5_language": op5_language}
ORACLE_SQL: dict[str, str] = {}
