"""Nearest neighbours through randomly rotated one-bit codes.

Every vector is centred, rotated and kept as its signs (packed bits) with two
scalars: its norm and its inner product with its own code.  From these a query's
distance to every row is estimated with an error bound; rows whose lower bound
does not exceed the best distances found so far are reranked on the original
vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import arrow_map, table, written

#: Widths of the error bound; at 4 a true neighbour's lower bound is too high about once in 10,000 times.
EPSILON, QUERY_BLOCK = 4.0, 4096


def rotation(dim: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and embedding (array of double) of the vectors that take part.

    Left out: null ids and vectors, zero vectors, null or non-finite components.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    return rows.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where(F.exists("embedding", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length, without nulls, as rows."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def build_index(rows: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """A written table (vec_id, code, norm, own, embedding) of every row, with the centre and the rotation.

    The centre is the mean of all rows.
    """
    found = rows.select(F.posexplode("embedding").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("x")).orderBy("k").collect()
    centre = np.array([r["x"] for r in found])
    turn = rotation(max(1, len(centre)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            o = (x - centre) @ turn
            norm = np.sqrt((o**2).sum(1))
            own = np.abs(o).sum(1) / np.maximum(norm, 1e-300) / np.sqrt(o.shape[1])
            code = np.packbits(o > 0, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(own), batch.column(1)], ["vec_id", "code", "norm", "own", "embedding"])

    index = arrow_map(rows, run, "vec_id long, code binary, norm double, own double, embedding array<double>")
    return written(index, "codes"), centre, turn


def _best(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, dist))[:k]


def _search(index: DataFrame, ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int) -> DataFrame:
    """The ``k`` best of each task for each query of one block."""
    shared = index.sparkSession.sparkContext.broadcast((ids, queries, centre, turn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, centre, turn = shared.value
        dim = q.shape[1]
        rotated = (q - centre) @ turn
        reach = np.sqrt((rotated**2).sum(1))
        held_d, held_i = np.full((len(qid), k), np.inf), np.full((len(qid), k), np.iinfo(np.int64).max)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                vid = part.column(0).to_numpy()
                bits = np.unpackbits(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(vid), -1), axis=1)[:, :dim]
                norm, own = part.column(2).to_numpy(), np.maximum(part.column(3).to_numpy(), 1e-9)
                x = _matrix(part.column(4))
                signs = (2.0 * bits - 1) / np.sqrt(dim)
                for a in range(0, len(qid), 512):
                    inner = norm[:, None] / own[:, None] * (signs @ rotated[a : a + 512].T)
                    slack = EPSILON * (norm * np.sqrt(np.maximum(0, 1 - own**2)) / own)[:, None] * reach[None, a : a + 512] / np.sqrt(max(1, dim - 1))
                    square = norm[:, None] ** 2 + reach[None, a : a + 512] ** 2 - 2 * inner
                    low = square - 2 * slack
                    for c in range(low.shape[1]):
                        j = a + c
                        first = np.argpartition(square[:, c], min(k, len(vid) - 1))[: k + 1]
                        for pick in (first, None):
                            if pick is None:
                                limit = held_d[j, -1]
                                pick = np.flatnonzero(low[:, c] <= limit**2 * (1 + 1e-9) + 1e-9) if np.isfinite(limit) else np.arange(len(vid))
                                pick = np.setdiff1d(pick, first, assume_unique=True)
                            pick = pick[vid[pick] != qid[j]]
                            if not len(pick):
                                continue
                            dist = np.sqrt(((x[pick] - q[j]) ** 2).sum(1))
                            d, i = np.concatenate((held_d[j], dist)), np.concatenate((held_i[j], vid[pick]))
                            keep = _best(d, i, k)
                            held_d[j], held_i[j] = d[keep], i[keep]
        full = np.isfinite(held_d)
        row, _ = np.nonzero(full)
        yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(held_i[full]), pa.array(held_d[full])], ["query_id", "vec_id", "score"])

    return arrow_map(index, run, "query_id long, vec_id long, score double")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest other rows of each query row by Euclidean distance.

    ``rows`` and ``queries``: vec_id, embedding as ``usable`` gives them; a query is
    never its own neighbour (nor any row with its id).  Queries are taken in blocks
    of about ``QUERY_BLOCK``, each against every row.  Equal distances rank by vec_id;
    with fewer than ``k`` candidates all are returned; repeated ids stay apart rows.
    Vectors are compared with those of their own length, each length on its own.
    """
    size = F.size("embedding")
    sizes = sorted(r[0] for r in rows.select(size.alias("n")).distinct().collect())
    if len(sizes) > 1:
        parts = [nearest(rows.where(size == n), queries.where(size == n), k) for n in sizes]
        return reduce(DataFrame.unionByName, parts)
    index, centre, turn = build_index(rows)
    blocks = -(-queries.count() // QUERY_BLOCK)
    part = F.pmod(F.xxhash64("vec_id"), F.lit(max(blocks, 1)))
    found = None
    for b in range(blocks):
        block = sorted((r["vec_id"], r["embedding"]) for r in queries.where(part == b).collect())
        if block:
            one = _search(index, np.array([i for i, _ in block], np.int64), np.array([v for _, v in block], float), centre, turn, k)
            one = written(one, "near") if blocks > 1 else one
            found = one if found is None else found.unionByName(one)
    if found is None:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0))


QUERIES = {"op9_neighbours": op9_neighbours}
ORACLE_SQL: dict[str, str] = {}
