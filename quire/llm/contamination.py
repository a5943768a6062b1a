"""Benchmark decontamination: rare word n-grams as seeds, Smith-Waterman for the score.

The corpus is read twice.  The first pass counts in how many documents each of the
benchmark's word pairs occurs; an item leaves out frequent ones, but never so many
that a passage with the least score could do without its other ones, its seeds.  The
second pass aligns each item with the passages that hold enough of its seeds, word by
word, so that copies with replaced, added or dropped words score high as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix, range_hashes
from .learning import joined
from .store import arrow_map, table
from .tokens import slices

#: Words of the shortest item; an n-gram in at most this share of documents is rare; least alignment
#: score as a share of an exact copy's; benchmark items and characters a pass; (seed, item) pairs handled at once.
SHORTEST, RARE, SCORE, ITEMS, CHARS, PAIRS = 3, 1e-3, 0.6, 20_000, 8_000_000, 4_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_WORD = np.zeros(256, bool)
for _b in range(256):
    _WORD[_b] = chr(_b).isalnum() and _b < 128 or _b >= 128


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes) of every word, lower case, with first and last word of each text and where the text begins."""
    data, begin, end = joined([(t or "").lower() for t in texts])
    word = _WORD[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    return range_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, begin), np.searchsorted(starts, end), begin


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words (one for each word but the last ones)."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(3) + h[k : k + n])
    return out


def seeding(n_words: int, least: float) -> tuple[int, int]:
    """Words in a seed of an item, and at how many of the item's seeds any passage with the least score agrees.

    M agreeing words in r runs score 2 M - (r - 1) at most, as something costs between
    two runs, and hold M - r pairs: 2 least n - 1 - M or more, with M up to n.  Items so
    short that this may be none are seeded by single words: 2 M is at least 2 least n.
    """
    pairs = math.ceil((MATCH * least - 1) * n_words - 1 - 1e-9)
    return (2, pairs) if pairs >= 1 else (1, max(1, math.ceil(least * n_words - 1e-9)))


def chosen_seeds(g: np.ndarray, n_of: np.ndarray, rare: float, agree: int) -> tuple[np.ndarray, int]:
    """The seeds of an item (distinct) and how many of its places a passage must hold: frequent ones go while one must stay."""
    seeds, first, times = np.unique(g, return_index=True, return_counts=True)
    n_of = n_of[first]
    order = np.argsort(-n_of, kind="stable")
    lost = np.cumsum(times[order])
    out = int(((n_of[order] > rare) & (lost < agree)).sum())
    need = agree - (int(lost[out - 1]) if out else 0)
    kept = order[out:]
    kept = kept[n_of[kept] > 0]
    return seeds[kept], need


def _found(h: np.ndarray, first: np.ndarray, last: np.ndarray, keys: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, document and key of each place where one of the sorted keys stands, document after document."""
    out = []
    for size in sizes:
        s = grams(h, size)
        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == s)
        doc = np.searchsorted(first, hit, "right") - 1
        ok = hit + size <= last[doc]
        out.append((hit[ok], doc[ok], at[hit[ok]]))
    hit, doc, key = (np.concatenate(c) for c in zip(*out, strict=True))
    if len(sizes) > 1:
        order = np.argsort(hit, kind="stable")
        hit, doc, key = hit[order], doc[order], key[order]
    return hit, doc, key


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman score of two word sequences and the best alignment's range in ``b``."""
    top = np.zeros(len(b) + 1, np.int64)
    begin = np.arange(len(b) + 1)
    best, lo, hi = 0, 0, 0
    steps = np.arange(1, len(b) + 1) * GAP
    for w in a:
        diagonal = top[:-1] + np.where(b == w, MATCH, MISMATCH)
        up = top[1:] + GAP
        now = np.maximum(np.maximum(diagonal, up), 0)
        origin = np.where(now == 0, np.arange(1, len(b) + 1), np.where(diagonal >= up, begin[:-1], begin[1:]))
        # Gaps along b: the best cell to the left, less what the way costs.
        reach = now - steps
        from_ = np.maximum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == from_, np.arange(len(b)), 0))
        left = from_ + steps
        origin = np.where(left > now, origin[source], origin)
        now = np.maximum(now, left)
        top, begin = np.concatenate(([0], now)), np.concatenate(([0], origin))
        k = int(now.argmax()) if len(now) else 0
        if len(now) and now[k] > best:
            best, lo, hi = int(now[k]), int(origin[k]), k + 1
    return best, lo, hi


def _items(block: list[tuple[int, str]]) -> list[tuple[int, np.ndarray]]:
    out = []
    for i, text in block:
        h = word_hashes([text])[0]
        if len(h):
            out.append((i, h))
    return out


def _frequencies(docs: DataFrame, seeds: np.ndarray, sizes: list[int]) -> np.ndarray:
    """In how many documents each seed (sorted, bounded by ITEMS items) occurs, over the whole corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        total = np.zeros(len(seeds), np.int64)
        for batch in batches:
            for _, texts in slices(batch):
                h, _, _, first, last, _ = word_hashes(texts)
                _, doc, key = _found(h, first, last, seeds, sizes)
                seen = np.unique(key + doc * len(seeds))
                total += np.bincount(seen % len(seeds), minlength=len(seeds))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(total[found])], ["k", "n"])

    counts = arrow_map(docs.select("text"), run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    times = np.zeros(len(seeds), np.int64)
    for r in counts.collect():
        times[r["k"]] = r["n"]
    return times


def _candidates(hit: np.ndarray, doc: np.ndarray, key: np.ndarray, at: np.ndarray, owners: np.ndarray, need: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
    """Document, item and places (words) of each pair of which enough places are seeds; owners of key k stand at at[k] up to at[k + 1]."""
    n = at[key + 1] - at[key]
    upto = np.cumsum(n)
    begin = 0
    while begin < len(hit):
        end = max(begin + 1, int(np.searchsorted(upto, PAIRS + (upto[begin - 1] if begin else 0), "right")))
        end = int(np.searchsorted(doc, doc[end - 1], "right"))
        many = n[begin:end]
        row = np.repeat(np.arange(begin, end), many)
        item = owners[np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + at[key[row]]]
        pair = doc[row] * len(need) + item
        order = np.argsort(pair, kind="stable")
        edge = np.flatnonzero(np.diff(pair[order], prepend=-1, append=-1))
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            k = int(item[order[x]])
            if y - x >= need[k]:
                yield int(doc[row[order[x]]]), k, hit[row[order[x:y]]].tolist()
        begin = end


def _alignments(docs: DataFrame, items: list[tuple[int, np.ndarray]], chosen: list[tuple[np.ndarray, int]], whole: list[tuple[int, int, np.ndarray]], sizes: list[int], least: float) -> DataFrame:
    seeds = np.concatenate([s for s, _ in chosen])
    order = np.argsort(seeds, kind="stable")
    owners = np.repeat(np.arange(len(chosen)), [len(s) for s, _ in chosen])[order]
    keys, at = np.unique(seeds[order], return_index=True)
    shared = docs.sparkSession.sparkContext.broadcast((items, whole, keys, np.append(at, len(owners)), owners, np.array([n for _, n in chosen])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, whole, keys, at, owners, need = shared.value
        for batch in batches:
            for part, texts in slices(batch):
                h, starts, ends, first, last, begin = word_hashes(texts)
                ids, rows, here = part.column(0).to_pylist(), [], {size: grams(h, size) for size in sizes}
                for d, k, pos in _candidates(*_found(h, first, last, keys, sizes), at, owners, need):
                    item, words = items[k]
                    span, full = 2 * len(words), MATCH * len(words)
                    best, a = (0, 0, 0), 0
                    while a < len(pos) and best[0] < full:  # passages whose seeds lie within an item's length of one another
                        b = a
                        while b + 1 < len(pos) and pos[b + 1] - pos[b] <= span:
                            b += 1
                        if b - a + 1 < need[k]:
                            a = b + 1
                            continue
                        lo, stop = max(int(first[d]), pos[a] - span), min(int(last[d]), pos[b] + SHORTEST + span)
                        # An alignment costs far more than a count of all the item's n-grams, frequent ones too.
                        size, agree, own = whole[k]
                        near = here[size][lo : max(lo, stop - size + 1)]
                        if (own[np.minimum(np.searchsorted(own, near), len(own) - 1)] == near).sum() < agree:
                            a = b + 1
                            continue
                        # A passage of one window's seeds cannot score more than its words allow; long runs are cut with overlap.
                        while lo < stop:
                            hi = min(stop, lo + 64 * len(words) + 512)
                            score, x, y = align(words, h[lo:hi])
                            if score > best[0]:
                                best = score, lo + x, lo + y
                            if hi == stop:
                                break
                            lo = hi - 2 * span
                        a = b + 1
                    if best[0] >= least * full:
                        rows.append((ids[d], item, best[0] / full, int(starts[best[1]] - begin[d]), int(ends[best[2] - 1] - begin[d])))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()], strict=True)], ["doc_id", "item_id", "score", "start", "end"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, item_id long, score double, start long, end long")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SCORE) -> DataFrame:
    """doc_id, item_id, score (1 for an exact copy), start, end: each document with each item that it holds.

    Words are runs of ASCII letters, digits and bytes beyond ASCII, in lower case.
    start and end are byte offsets in the lower-case UTF-8 text.  Items of fewer than
    SHORTEST words, null items and null texts match nothing; a repeated row matches again;
    equal items are reported each.  The benchmark is taken in blocks of about ITEMS
    items or CHARS characters, which bounds what is broadcast; each block is compared with all documents.
    """
    n, chars = benchmark.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n_docs = docs.count()
    blocks = max(-(-n // ITEMS), -(-chars // CHARS))
    part = F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1)))
    found = None
    for b in range(blocks):
        rows = benchmark.where(part == b).where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").collect()
        items = [(i, w) for i, w in _items(sorted((r[0], r[1]) for r in rows)) if len(w) >= SHORTEST]
        if not items:
            continue
        sized = [seeding(len(w), least) for _, w in items]
        held = [grams(w, size) for (_, w), (size, _) in zip(items, sized, strict=True)]
        seeds, sizes = np.unique(np.concatenate(held)), sorted({size for size, _ in sized})
        times = _frequencies(docs, seeds, sizes)
        chosen = [chosen_seeds(g, times[np.searchsorted(seeds, g)], max(RARE * n_docs, 50), agree) for g, (_, agree) in zip(held, sized, strict=True)]
        if not any(len(s) for s, _ in chosen):
            continue
        whole = [(size, agree, np.unique(g)) for g, (size, agree) in zip(held, sized, strict=True)]
        one = _alignments(docs, items, chosen, whole, sizes, least)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, start long, end long")
    return found


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLE_SQL: dict[str, str] = {}
