"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary text and one
on the passages of toxic documents that ordinary text lacks, joined to samples long
enough for the trainer.  A window's gain is how many bytes shorter it becomes when the
toxic dictionary stands before the ordinary one.  A threshold on a document's gains,
calibrated on documents that neither dictionary has seen, makes the decision.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import held_out, joined, labelled_sample, segment_sums, words
from .store import arrow_map, table
from .tokens import in_slices, slices

#: Bytes of a window (it ends at the next white space, at twice this at most) and of the two dictionaries.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES, THRESHOLD = 64, 16_384, 2048, 0.3
#: A passage is learned as toxic if words with its first bytes, so many of them, are so many times as frequent in toxic
#: documents as in ordinary ones, where two more count as found; a word counts once for each word before it.
GRAM, TIMES, MORE = 5, 12, 2
#: Least bytes of a sample of passages, and the segments and grams (bytes) of the trainer that finds the frequent ones.
SAMPLE_BYTES, SEGMENT, TRAINED_GRAM = 64, 24, 6


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray


def windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes, starts and ends of windows of whole words, and the ranges of windows of each text."""
    data, begin, end = joined([(t or "").lower() for t in texts])
    starts, ends = words(data)
    first = np.searchsorted(starts, begin)
    last = np.searchsorted(starts, end)
    doc = np.repeat(np.arange(len(begin)), last - first)
    slot = (starts - begin[doc]) // WINDOW if len(starts) else starts
    new = np.ones(len(starts), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (slot[1:] != slot[:-1])
    at = np.flatnonzero(new)
    lo, hi = starts[at], ends[np.append(at[1:], len(starts)) - 1] if len(at) else ends
    if len(lo) and (hi - lo).max() > 4 * WINDOW:  # words far longer than a window are cut
        n = np.maximum(1, -(-(hi - lo) // (2 * WINDOW)))
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        top = np.repeat(hi, n)
        lo = np.repeat(lo, n) + step * 2 * WINDOW
        hi = np.minimum(lo + 2 * WINDOW, top)
    return data, lo, hi, np.searchsorted(lo, begin), np.searchsorted(lo, end)


class Gains:
    """Compressed lengths of windows with the ordinary dictionary alone and with the toxic one before it."""

    def __init__(self, model: Model):
        how = zstandard.ZstdCompressionParameters(compression_level=3, strategy=zstandard.STRATEGY_LAZY2, min_match=4, search_log=5, hash_log=15, chain_log=15, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.codecs = []
        for content in (model.ordinary, model.toxic + model.ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None
            if d:
                d.precompute_compress(compression_params=how)
            self.codecs.append(zstandard.ZstdCompressor(compression_params=how, **({"dict_data": d} if d else {})))

    def of(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if not len(lo):
            return np.zeros(0)
        spans = zstandard.BufferWithSegments(data.tobytes(), np.stack([lo, hi - lo], 1).astype("<u8").tobytes())
        out = []
        for c in self.codecs:
            done = c.multi_compress_to_buffer(spans, threads=1)
            out.append(np.fromiter((len(s) for s in done), np.int64, len(done)))
        return (out[0] - out[1]).astype(np.float64)


def _evidence(gain: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per text: a constant, the largest gain, the mean of large gains' excess, how many windows gain much, and the log of the windows."""
    n = b - a
    top = np.zeros(len(a))
    full = np.flatnonzero(n > 0)
    if len(full):
        top[full] = np.maximum.reduceat(gain, a[full])
    top = np.maximum(top, 0)
    over = np.stack([segment_sums((gain >= k).astype(np.float32), a, b) for k in (1, 2, 3)], 1)
    return np.column_stack([np.ones(len(a)), np.minimum(top, 8) / 4, np.log1p(over), np.log1p(n) / 4])


def _trained(samples: list[bytes], size: int, **how) -> bytes:
    """A zstandard dictionary of ``samples``; their own last bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def _spoken(text: str) -> list[bytes]:
    """A text's words in lower case, each with a space before it."""
    return [b" " + w for w in text.lower().encode("utf-8", "replace").split()]


def _pairs(texts: list[str]) -> set[tuple[bytes, bytes]]:
    """Distinct (word before, word) of all texts, so that copies of a text count once."""
    return {pair for t in texts for w in [_spoken(t)] for pair in zip([b"", *w], w, strict=False)}


def _beginnings(pairs: set[tuple[bytes, bytes]], k: int) -> Counter:
    return Counter(w[:k] for _, w in pairs if len(w) >= k)


def _passages(texts: list[str], odd: set[bytes]) -> list[bytes]:
    """Samples of the words that begin like one in ``odd``, one after another; texts with the same ones count once."""
    seen, samples, held = set(), [], b""
    for t in texts:
        found = b"".join(w for w in _spoken(t) if w[:GRAM] in odd)
        if not found or found in seen:
            continue
        seen.add(found)
        held += found
        if len(held) >= SAMPLE_BYTES:
            samples.append(held)
            held = b""
    return [*samples, held] if held else samples


def train(sample: list[tuple[int, str, int]], prior: float = 0.15) -> Model:
    """Dictionaries and calibration; without both classes the model has no dictionary and scores by the share of toxic labels.

    Every other document of each class teaches the dictionaries, the rest calibrate.
    """
    toxic, plain = [t for _, t, y in sample if y == 1], [t for _, t, y in sample if y == 0]
    if not toxic or not plain:
        return Model(b"", b"", np.array([3.0 if toxic else -3.0, 0, 0, 0, 0, 0]))
    heard, known = toxic[0::2], plain[0::2]
    data, lo, hi, _, _ = windows(known)
    buf = data.tobytes()
    ordinary = _trained([buf[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], ORDINARY_BYTES)
    often = _beginnings(_pairs(known), GRAM)
    rate = len(heard) / len(known)
    odd = {g for g, n in _beginnings(_pairs(heard), GRAM).items() if n > TIMES * rate * (often[g] + MORE)}
    model = Model(ordinary, _trained(_passages(heard, odd), TOXIC_BYTES, k=SEGMENT, d=TRAINED_GRAM, f=18, accel=1), np.zeros(6))
    rows, y = [], []
    gains = Gains(model)
    held = [(t, 1) for t in toxic[1::2] or toxic] + [(t, 0) for t in plain[1::2] or plain]
    for a, b in in_slices([len(t) for t, _ in held], 1 << 20):
        d, lo, hi, i, j = windows([t for t, _ in held[a:b]])
        rows.append(_evidence(gains.of(d, lo, hi), i, j))
        y += [v for _, v in held[a:b]]
    model.weights = _logistic(np.concatenate(rows), np.array(y, float), min(max(prior, 0.02), 0.98))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 0.02, steps: int = 40) -> np.ndarray:
    """Newton's method with class 1 weighing ``prior`` of the whole."""
    w = np.zeros(x.shape[1])
    share = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) / len(y) + ridge * w / 100
        h = (x * (share * p * (1 - p))[:, None]).T @ x / len(y) + np.eye(len(w)) * (ridge / 100 + 1e-9)
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    return w


def scores(texts: list[str | None], model: Model, gains: Gains) -> np.ndarray:
    data, lo, hi, a, b = windows(texts)
    return 1 / (1 + np.exp(-np.clip(_evidence(gains.of(data, lo, hi), a, b) @ model.weights, -30, 30)))


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= threshold) for every row; null and empty texts have no window and no gain."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        gains = Gains(model)
        for batch in batches:
            for part, texts in slices(batch):
                s = scores(texts, model, gains)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, predicted int")


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.select("doc_id", F.col("toxic").alias("label"))
    prior = known.where(~held_out()).agg(F.avg("label")).first()[0]
    return train(labelled_sample(docs, known), 0.15 if prior is None else prior)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fitted(docs, table(spark, sf_dir, "labels"))).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL: dict[str, str] = {}
