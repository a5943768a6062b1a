"""Re-Pair grammar compression of token ids, shard by shard, with random access.

A shard is a run of whole documents.  Rounds of pair counting replace frequent
neighbouring symbols by nonterminals; a pair never crosses a document's end.  The
shard keeps every rule and the length that each symbol expands to, so a range of
one document is decoded without the rest of the shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import arrow_map, partitions, table, written
from .tokens import encoder, slices, vocabulary, with_end

MAGIC = b"RPG1"
_HEAD = struct.Struct("<4sIIIIII")


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(key)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[first], np.diff(np.append(first, len(ordered)))


def compress(ids: np.ndarray, doc_lengths: np.ndarray, base: int, least: int = 8, pays: float = 1 / 64, a_round: int = 6_000):
    """Symbols, symbols per document and rules (pairs; rule r is symbol ``base + r``) of one shard.

    A round replaces the ``a_round`` most frequent pairs among those that occur
    ``least`` times or more (a rule costs 8 bytes, an occurrence saves 2 or 4), the most
    frequent first where two share a slot; of overlapping occurrences the left one.
    Rounds go on until no such pair is left, no symbol of that width for a rule, or a
    round takes less than the share ``pays`` off the symbols.
    """
    max_rules = (1 << 16) - base if base < 1 << 16 else (1 << 31) - base
    symbol, key_type, half = (np.uint16, np.uint32, 16) if base < 1 << 16 else (np.uint32, np.uint64, 32)
    seq = ids.astype(symbol)
    ends = np.zeros(len(seq), bool)  # the last symbol of a document
    lengths = doc_lengths.astype(np.int64)
    ends[np.cumsum(lengths)[lengths > 0] - 1] = True
    rules: list[np.ndarray] = []
    n_rules, bits = 0, 17
    while len(seq) > 1 and n_rules < max_rules:
        before = len(seq)
        key = (seq[:-1].astype(key_type) << key_type(half)) | seq[1:]
        inner = ~ends[:-1]
        pairs, counts = _counted(key[inner])
        chosen = np.flatnonzero(counts >= least)
        if not len(chosen):
            break
        chosen = chosen[np.argsort(-counts[chosen], kind="stable")][: min(a_round, max_rules - n_rules)]
        pairs = pairs[chosen]
        slot = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        first.sort()
        pairs, slot = pairs[first], slot[first]
        held = np.full(1 << bits, -1, np.int32)
        held[slot] = np.arange(len(pairs), dtype=np.int32)
        at = held[((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)]
        hit = np.flatnonzero((at >= 0) & inner)
        hit = hit[pairs[at[hit]] == key[hit]]
        if not len(hit):
            break
        run = np.concatenate(([True], np.diff(hit) != 1))  # neighbouring hits overlap: every other one of a run is kept
        hit = hit[(np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))) % 2 == 0]
        seq[hit] = (base + n_rules + at[hit]).astype(symbol)
        ends[hit] = ends[hit + 1]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq, ends = seq[keep], ends[keep]
        rules.append(np.stack([(pairs >> key_type(half)), pairs & key_type((1 << half) - 1)], 1).astype(symbol))
        n_rules += len(pairs)
        if before - len(seq) < pays * before:
            break
    table_ = np.concatenate(rules) if rules else np.zeros((0, 2), symbol)
    per_doc = np.zeros(len(lengths), np.int64)
    per_doc[lengths > 0] = np.diff(np.concatenate(([0], np.flatnonzero(ends) + 1)))
    return seq, per_doc, table_


class Shard:
    """A shard's file form: header, document table, rules, expansion lengths, symbols; all little-endian.

    ``doc_id`` signed 64-bit, its null flag 8-bit, tokens and symbols a document
    unsigned 32-bit; rules as two symbols each and their expansion lengths
    unsigned 32-bit; symbols unsigned 16-bit if all fit, else 32-bit.
    """

    def __init__(self, payload: bytes):
        magic, n_docs, n_tokens, n_rules, n_symbols, self.base, width = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a Re-Pair shard")
        at = _HEAD.size
        symbol = "<u2" if width == 2 else "<u4"

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.doc_id, self.null = take("<i8", n_docs), take("u1", n_docs)
        self.n_tokens, self.n_symbols = take("<u4", n_docs).astype(np.int64), take("<u4", n_docs).astype(np.int64)
        self.rules, self.lengths = take(symbol, 2 * n_rules).reshape(-1, 2), take("<u4", n_rules).astype(np.int64)
        self.symbols = take(symbol, n_symbols)
        self.at = np.concatenate(([0], np.cumsum(self.n_symbols)))
        self._grammar: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @staticmethod
    def pack(doc_id: np.ndarray, null: np.ndarray, ids: np.ndarray, doc_lengths: np.ndarray, base: int, **how) -> bytes:
        symbols, per_doc, rules = compress(ids, doc_lengths, base, **how)
        lengths = np.ones(base + len(rules), np.int64)
        for r, (a, b) in enumerate(rules.tolist()):
            lengths[base + r] = lengths[a] + lengths[b]
        head = _HEAD.pack(MAGIC, len(doc_id), len(ids), len(rules), len(symbols), base, symbols.itemsize)
        return b"".join([head, doc_id.astype("<i8").tobytes(), null.astype("u1").tobytes(), doc_lengths.astype("<u4").tobytes(), per_doc.astype("<u4").tobytes(), rules.tobytes(), lengths[base:].astype("<u4").tobytes(), symbols.tobytes()])

    def _flat(self):
        """Expansions of all symbols one after another, with each symbol's offset and length."""
        if self._grammar is None:
            out, offset, n = [np.arange(self.base, dtype="<u4")], np.arange(self.base + len(self.rules), dtype=np.int64), self.base
            known: list[np.ndarray] = []
            get = lambda s: known[s - self.base] if s >= self.base else out[0][s : s + 1]
            for r, (a, b) in enumerate(self.rules.tolist()):
                known.append(np.concatenate((get(a), get(b))))
                offset[self.base + r] = n
                n += len(known[-1])
            self._grammar = np.concatenate(out + known), offset, np.concatenate((np.ones(self.base, np.int64), self.lengths))
        return self._grammar

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, offset, length = self._flat()
        s = symbols.astype(np.int64)
        n = length[s]
        ends = np.cumsum(n)
        return flat[np.repeat(offset[s] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.at[k] : self.at[k + 1]])

    def span(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start:stop`` of the shard's document ``k``, expanding only the symbols that hold them."""
        s = self.symbols[self.at[k] : self.at[k + 1]].astype(np.int64)
        ends = np.cumsum(self._lengths(s))
        start, stop = max(start, 0), min(stop, int(ends[-1]) if len(ends) else 0)
        if start >= stop:
            return np.zeros(0, "<u4")
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return self._walk(s[a:b].tolist(), skip, stop - start)

    def _lengths(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols - self.base
        return np.where(rule >= 0, self.lengths[np.maximum(rule, 0)] if len(self.lengths) else 1, 1)

    def _walk(self, symbols: list[int], skip: int, n: int) -> np.ndarray:
        """``n`` ids of the expansion after the first ``skip``: down the rules, past those that end before it."""
        out, todo = [], symbols[::-1]
        while todo and len(out) < n:
            s = todo.pop()
            size = int(self.lengths[s - self.base]) if s >= self.base else 1
            if size <= skip:
                skip -= size
            elif s >= self.base:
                a, b = self.rules[s - self.base].tolist()
                todo += [b, a]
            else:
                out.append(s)
        return np.array(out, "<u4")


def _shards(path: str, end_id: int, shard_tokens: int):
    schema = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("least_id", pa.int64()), ("most_id", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tok = TaskContext.get().partitionId(), encoder(path)
        shard = before = held = 0
        held_ids: list[int | None] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard, before, held
            lengths = np.concatenate([n for _, n in parts])
            null, known = np.array([d is None for d in held_ids]), [d for d in held_ids if d is not None]
            payload = Shard.pack(np.array([d or 0 for d in held_ids], np.int64), null, np.concatenate([x for x, _ in parts]), lengths, tok.vocab)
            out = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, shard, before, int(lengths.sum()), min(known, default=None), max(known, default=None), payload), schema.types, strict=True)], schema=schema)
            shard, before, held = shard + 1, before + int(lengths.sum()), 0
            held_ids.clear()
            parts.clear()
            return out

        for batch in batches:
            for part_of, texts in slices(batch):
                parts.append(with_end(*tok.encode(texts), end_id))
                held_ids += part_of.column(0).to_pylist()
                held += len(parts[-1][0])
                if held >= shard_tokens:
                    yield flush()
        if parts:
            yield flush()

    return run, "part long, shard long, before long, n_tokens long, least_id long, most_id long, payload binary"


def write_shards(docs: DataFrame, path: str, end_id: int = 0, shard_tokens: int = 1 << 19) -> DataFrame:
    """Token ids of every text in ascending doc_id order as a table of Re-Pair shards.

    Null texts are empty ones, so they hold ``end_id`` alone; equal doc_ids follow
    one another by text; null doc_ids come first; other columns are not read.  An
    empty input gives an empty table.  Shards of one part follow one another.
    """
    run, schema = _shards(path, end_id, shard_tokens)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", F.crc32(F.coalesce("text", F.lit("")))).sortWithinPartitions("doc_id", F.crc32(F.coalesce("text", F.lit(""))), "text")
    return written(arrow_map(rows, run, schema, holds="encoder"), "repair")


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document from the shards alone: doc_id, start, n_tokens and ids_crc32 of its decoded ids."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each writing task
    bases = totals.selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(payload.as_buffer())
                ids = np.ascontiguousarray(shard.expand(shard.symbols), "<u4")
                ends = np.cumsum(shard.n_tokens)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), shard.n_tokens.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_id, pa.int64(), mask=shard.null.astype(bool)), pa.array(first + ends - shard.n_tokens), pa.array(shard.n_tokens), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = shards.join(F.broadcast(bases), "part").select((F.col("base") + F.col("before")).alias("first"), "payload")
    return arrow_map(placed, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_of(shards: DataFrame, doc_id: int, start: int = 0, stop: int | None = None) -> list[np.ndarray]:
    """Ids ``start:stop`` of each document with that doc_id, from the shards whose range of ids holds it; the rest is not read."""
    found = shards.where((F.col("least_id") <= doc_id) & (F.col("most_id") >= doc_id)).orderBy("part", "shard").select("payload")
    out = []
    for r in found.toLocalIterator():
        shard = Shard(bytes(r.payload))
        for k in np.flatnonzero((shard.doc_id == doc_id) & (shard.null == 0)).tolist():
            out.append(shard.span(k, start, int(shard.n_tokens[k]) if stop is None else stop))
    return out


def op1_token_ids(spark, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(table(spark, sf_dir, "documents"), vocabulary()))


QUERIES = {"op1_token_ids": op1_token_ids}
ORACLE_SQL: dict[str, str] = {}
