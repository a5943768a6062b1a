"""Packing by power-of-two decomposition: pieces of equal binary lengths, none across documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import arrow_map, table
from .tokens import encoder, slices, vocabulary, with_end

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def pieces(n: int, longest: int) -> list[int]:
    """Lengths that make up ``n``: as many of ``longest`` as fit, then its remainder's binary digits, largest first."""
    return [longest] * (n // longest) + [1 << k for k in reversed(range(longest.bit_length() - 1)) if n % longest >> k & 1]


def pack(docs: DataFrame, path: str, end_id: int = 1, longest: int = 2048) -> DataFrame:
    """One row a sequence: a power-of-two piece of one document with its ids (little-endian unsigned 32-bit).

    A sequence holds exactly one piece, so its offset is 0, it needs no padding and
    its bucket is its length; ``write_buckets`` keeps the buckets apart in files.  Null and empty texts hold ``end_id`` alone; a
    repeated row is packed again; other columns are not read.  Sequence ids are
    unique and depend only on how the input is partitioned, so a rerun task gives
    the same ones.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, n = encoder(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, texts in slices(batch):
                out: list[tuple] = []
                ids, counts = with_end(*tok.encode(texts), end_id)
                for d, total in zip(part.column(0).to_pylist(), counts.tolist(), strict=True):
                    start = 0
                    for k in pieces(total, longest):
                        out.append((d, start, k, total, n, 0, k))
                        start, n = start + k, n + 1
                cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                # The pieces follow one another in ids, so their ends are the column's offsets.
                ends = np.append(0, 4 * np.cumsum(cols[2].to_numpy())).astype(np.int32)
                cols.insert(3, pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(ends), pa.py_buffer(ids)]))
                yield pa.RecordBatch.from_arrays(cols, NAMES)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA, holds="encoder")


def write_buckets(packed: DataFrame, path: str) -> None:
    """A folder for each bucket, so that a reader's batch holds sequences of one length and needs no padding."""
    packed.write.partitionBy("bucket").parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents"), vocabulary()))


QUERIES = {"op6_packing": op6_packing}
ORACLE_SQL: dict[str, str] = {}
