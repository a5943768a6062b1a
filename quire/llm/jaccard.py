"""Exact n-gram Jaccard join through a token-group matrix.

Equal sets form one class.  Classes that agree on a minimum hash and are verified
as similar form groups; classes of which many share a minimum hash form one group,
linked or not.  The matrix holds each group's union of prefix tokens, in cells of
bounded size: under one order of all tokens, two similar sets share so many of
their first tokens.  A class is a query against the matrix; a cell is opened, its
members compared on whole sets, only if the overlap found reaches that bound.  A
task takes one cell and one block of its queries and gives a spanning forest of the
links it finds, never a row a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import mix, range_hashes
from .learning import joined, words
from .store import arrow_map, partitions, table, written
from .tokens import slices

#: Minimum hashes that propose groups, and tokens beyond the prefix that sharpen the bound.
ROUNDS, EXTRA = 5, 3
#: Classes that share a minimum hash from which they are one group; members and tokens of one cell; queries of one block.
CROWD, MEMBERS, CELL_TOKENS, BLOCK = 32, 1024, 2_000_000, 2048
#: Classes that share a token for it to come last in the order, how many such tokens are told to the tasks (the order is a
#: matter of speed: any is exact), and classes from which a token's rows are not brought into one task.
COMMON, TOLD, HOT = 12, 250_000, 4096
#: Ids (8 bytes each) up to which a side is broadcast, by count.
SMALL = 1_000_000


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``size`` words; of all its words if it has fewer; empty without words."""
    data, begin, end = joined(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends = words(data)
    h = range_hashes(data, starts, ends)
    n = max(0, len(h) - size + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(size):
        runs = mix(runs * np.uint64(3) + h[k : k + n])
    out = []
    for a, b in zip(np.searchsorted(starts, begin).tolist(), np.searchsorted(starts, end).tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(mix(np.array([int.from_bytes(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), "little")], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bounds(n: int, percent: int) -> tuple[int, int]:
    """How many first tokens of a set of ``n`` go into the matrix, and how many of them beyond the plain prefix."""
    need = -(-percent * n // 100)
    extra = min(EXTRA, need - 1)
    return n - need + 1 + extra, extra


def small(ids: DataFrame) -> DataFrame:
    """``ids`` as a written table, broadcast if it has few rows, by count; else left to a shuffled join."""
    ids = written(ids, "ids")
    return F.broadcast(ids) if ids.count() <= SMALL else ids


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, sig (128 bits of the sorted set) and m0.. (minimum hashes) of every row."""
    schema = "doc_id long, n long, sig binary, " + ", ".join(f"m{r} long" for r in range(ROUNDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                rows = []
                for d, s in zip(part.column(0).to_pylist(), shingle_sets(texts, size), strict=True):
                    least = [int(mix(s ^ np.uint64(0x9E3779B97F4A7C15 * (r + 1) & (2**64 - 1))).min().view(np.int64)) if len(s) else 0 for r in range(ROUNDS)]
                    rows.append((d, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), *least))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * ROUNDS]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return written(arrow_map(docs, run, schema), "sets")


class Forest:
    """Disjoint sets of labels."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        at = x
        while (to := self.up.get(at, at)) != at:
            at = to
        while x != at:
            self.up[x], x = at, self.up.get(x, x)
        return at

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _links(texts: DataFrame, asked: DataFrame, member: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: labels (comp) of which a query (rep, comp, cell) and a member (rep, comp, cell) of one cell are similar.

    A task takes one cell and one block of its queries at a time and gives a spanning
    forest of the links between labels, so it writes fewer rows than it reads.
    """
    blocks = written(asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "blocks")
    held = member.join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "rep", "comp")
    query = asked.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), F.lit(1).alias("kind"), "rep", "comp")
    rows = written(held.unionByName(query), "cells")
    needed = texts.join(small(rows.select("rep").distinct()), "rep", "left_semi")
    rows = rows.join(needed, "rep").select("cell", "block", "kind", "comp", "text")
    rows = rows.repartition(partitions(texts.sparkSession), "cell", "block").sortWithinPartitions("cell", "block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, comps, index, forest = None, [], [], None, Forest()
        for batch in batches:
            for part, said in slices(batch):
                left, right = [], []
                cols = [part.column(c).to_pylist() for c in range(4)]
                for cell, block, kind, comp, s in zip(*cols, shingle_sets(said, size), strict=True):
                    if (cell, block) != at:
                        at, held, comps, index, forest = (cell, block), [], [], None, Forest()
                    if kind == 0:
                        held.append(s)
                        comps.append(comp)
                        continue
                    if index is None:
                        index = _index(held, comps)
                        held = []
                    for other in _near(s, comp, index, forest, percent):
                        if forest.join(comp, other):
                            left.append(comp)
                            right.append(other)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return written(arrow_map(rows, run, "a long, b long").distinct(), "links")


def _index(sets: list[np.ndarray], comps: list[int]):
    sizes = np.array([len(x) for x in sets], np.int64)
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(tokens, kind="stable")
    return tokens[order], np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[order], sizes, np.array(comps, np.int64)


def _near(s: np.ndarray, comp: int, index, forest: Forest, percent: int) -> list[int]:
    """Labels, apart from ``comp``, of the members similar to ``s``."""
    tokens, owner, sizes, comps = index
    if not len(s) or not len(sizes):
        return []
    fits = (sizes * 100 >= len(s) * percent) & (len(s) * 100 >= sizes * percent) & (comps != comp)
    if not fits.any():
        return []
    lo = np.searchsorted(tokens, s)
    n = np.searchsorted(tokens, s, "right") - lo
    spots = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    both = np.bincount(owner[spots], minlength=len(sizes))
    return np.unique(comps[fits & (100 * both >= percent * (len(s) + sizes - both))]).tolist()


def components(links: DataFrame) -> DataFrame:
    """node, root (its component's least node) of all nodes in ``links`` (a, b): least labels of neighbours, then of labels, until none changes."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    label = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "labels")
    while True:
        near = edges.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        best = label.join(near, "node").select("node", F.least("root", "seen").alias("mid"), F.col("root").alias("was"))
        best = written(best, "labels")
        up = best.select(F.col("node").alias("mid"), F.col("mid").alias("up"))
        label = written(best.join(up, "mid").select("node", F.least("mid", "up").alias("root"), "was"), "labels")
        if label.where("root <> was").isEmpty():
            return label.select("node", "root")


def _relabelled(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` with the least label of those that ``links`` join as comp."""
    root = components(links).withColumnsRenamed({"node": "comp"})
    return written(known.join(root, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root"), "groups")


def _buckets(known: DataFrame) -> DataFrame:
    return known.select("rep", "comp", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.col(f"m{r}").alias("m")) for r in range(ROUNDS)])).alias("at")).select("rep", "comp", "n", "at.r", "at.m")


def _fits(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _led(texts: DataFrame, known: DataFrame, size: int, percent: int) -> DataFrame:
    """``known`` with the classes that are similar to a leader of one of their buckets under its label; leaders are the least by hash, so few differ.

    Classes under one label as a document's parts stay so.
    """
    order = F.struct(F.xxhash64("rep").alias("o"), F.col("rep").alias("cell"), F.col("comp").alias("over"), F.col("n").alias("of"))
    lead = written(_buckets(known).groupBy("r", "m").agg(F.min(order).alias("lead"), F.count("*").alias("many")).where("many > 1").select("r", "m", "lead.*").drop("o"), "leaders")
    pairs = _buckets(known).join(lead, ["r", "m"]).where("comp <> over").where(_fits(F.col("n"), F.col("of"), percent))
    asked = written(pairs.select("rep", "comp", "cell", "over").distinct(), "pairs")
    leaders = asked.select(F.col("cell").alias("rep"), F.col("over").alias("comp"), "cell").distinct()
    return _relabelled(known, _links(texts, asked.drop("over"), leaders, size, percent))


def _common_tokens(classes: DataFrame, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in the prefixes of more than COMMON classes (of too many the most frequent ones, by doubling COMMON), and those of HOT or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch):
                low = [s[: bounds(len(s), percent)[0]] for s in shingle_sets(texts, size) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *low]).view(np.int64))], ["token"])

    counts = written(arrow_map(classes.select("text"), run, "token long").groupBy("token").count().where(F.col("count") > COMMON), "common")
    least, n = COMMON, counts.count()
    while n > TOLD:
        least *= 2
        n = counts.where(F.col("count") > least).count()
    told = counts.where(F.col("count") > least).select("token", (F.col("count") >= HOT).alias("hot")).toArrow()
    token, hot = told.column(0).to_numpy().view(np.uint64), told.column(1).to_numpy().astype(bool)
    return np.sort(token), np.sort(token[hot])


def _isin(s: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, s), len(ordered) - 1)] == s if len(ordered) else np.zeros(len(s), bool)


def _prefix_rows(classes: DataFrame, common: np.ndarray, hot: np.ndarray, size: int, percent: int) -> DataFrame:
    """token, rep and whether the token is hot, of every class's first tokens: rare ones first, by hash."""
    shared = classes.sparkSession.sparkContext.broadcast((common, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, hot = shared.value
        for batch in batches:
            for part, texts in slices(batch):
                tokens, counts = [np.zeros(0, np.uint64)], []
                for s in shingle_sets(texts, size):
                    if len(s):
                        k, last = bounds(len(s), percent)[0], _isin(s, common)
                        s = np.concatenate((s[~last][:k], s[last][: max(0, k - int((~last).sum()))]))
                    tokens.append(s)
                    counts.append(len(s))
                token = np.concatenate(tokens)
                rep = np.repeat(part.column(0).to_numpy(), counts)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(rep), pa.array(_isin(token, hot))], ["token", "rep", "hot"])

    return arrow_map(classes.select("rep", "text"), run, "token long, rep long, hot boolean")


def _shared_tokens(rows: DataFrame) -> DataFrame:
    """token, rep of the rows whose token occurs more than once.

    Rows of hot tokens are dealt out by class and stay all; of the others a task holds one token's at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 2

        def told(cols: list[np.ndarray]) -> pa.RecordBatch:
            token = cols[0]
            keep = np.zeros(0, bool)
            if len(token):
                first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
                several = np.diff(np.append(first, len(token))) > 1
                keep = np.repeat(several, np.diff(np.append(first, len(token))))
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in cols], ["token", "rep"])

        for batch in batches:
            cols, hot = [batch.column(c).to_numpy() for c in range(2)], batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if hot.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[hot]) for c in cols], ["token", "rep"])
            held = [np.concatenate((h, c[~hot])) for h, c in zip(held, cols, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            yield told([h[:cut] for h in held])
            held = [h[cut:] for h in held]
        yield told(held)

    dealt = rows.repartition(partitions(rows.sparkSession), F.when(F.col("hot"), F.xxhash64("rep")).otherwise(F.col("token"))).sortWithinPartitions("hot", "token")
    return written(arrow_map(dealt, run, "token long, rep long"), "shared")


def _crowds(known: DataFrame) -> DataFrame:
    """rep, grp of the classes that share a minimum hash with CROWD classes or more: the largest such bucket."""
    every = _buckets(known)
    large = written(every.groupBy("r", "m").count().where(F.col("count") >= CROWD), "crowds")
    return every.join(large, ["r", "m"]).groupBy("rep").agg(F.max(F.struct("count", "r", "m")).alias("best")).select("rep", F.xxhash64("best.r", "best.m").alias("grp"))


def _opened(known: DataFrame, classes: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rep, comp, cell) of the queries whose overlap with a cell reaches the bound, and of the cells' members."""
    grouped = known.join(_crowds(known), "rep", "left").withColumn("grp", F.coalesce("grp", "comp"))
    grouped = written(grouped.select("rep", "comp", "n", "n_least", "grp"), "grouped")
    shards = grouped.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / CELL_TOKENS)).alias("shards")).where("shards > 1")
    member = grouped.join(written(shards, "shards"), "grp", "left").withColumn("cell", F.xxhash64("grp", F.pmod(F.xxhash64("rep"), F.coalesce("shards", F.lit(1)))))
    member = written(member.select("rep", "n", "n_least", "comp", "cell", F.least(F.lit(EXTRA), F.ceil(F.col("n_least") * percent / 100) - 1).alias("extra")), "members")
    tokens = _shared_tokens(_prefix_rows(classes, *_common_tokens(classes, size, percent), size, percent))
    tokens = written(tokens.join(member, "rep"), "tokens")
    matrix = tokens.groupBy("token", "cell").agg(F.min("extra").alias("g_extra"), F.min("n_least").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("least"))
    asked = tokens.select("token", F.col("rep").alias("q"), F.col("comp").alias("own"), F.col("n").alias("nq"), F.col("n_least").alias("nq_least"), "extra")
    # Of two components the one with the larger label asks.
    meets = asked.join(matrix, "token").where("own > least").where((F.col("nq") * 100 >= F.col("lo") * percent) & (F.col("hi") * 100 >= F.col("nq_least") * percent))
    found = meets.groupBy("q", "cell").agg(F.count("*").alias("hits"), F.min("extra").alias("e"), F.min("g_extra").alias("ge"), F.first("own").alias("comp"))
    opened = found.where(F.col("hits") >= 1 + F.least("e", "ge")).select(F.col("q").alias("rep"), "comp", "cell")
    return written(opened, "opened"), member.select("rep", "comp", "cell")


def similar(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Sets of ``size``-word shingles link where 100 * intersection >= ``percent`` *
    union; a component's id is its least doc_id.  Documents without words link with
    nothing; equal sets link whatever their texts; rows with one doc_id are parts of
    one document; a null doc_id has no component.  An empty table gives none.  Other
    columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = _signatures(docs, size)
    whole = sets.where("n > 0 AND doc_id IS NOT NULL")
    equal = written(whole.groupBy("n", "sig").agg(F.min("doc_id").alias("rep"), *[F.first(f"m{r}").alias(f"m{r}") for r in range(ROUNDS)]), "classes")
    known = equal.groupBy("rep").agg(F.max("n").alias("n"), F.min("n").alias("n_least"), *[F.min(f"m{r}").alias(f"m{r}") for r in range(ROUNDS)])
    texts = docs.select(F.col("doc_id").alias("rep"), "text")
    if not whole.groupBy("doc_id").count().where("count > 1").isEmpty():  # equal rows count once
        texts = texts.distinct()
    known = _led(texts, written(known.withColumn("comp", F.col("rep")), "groups"), size, percent)
    classes = texts.join(small(known.select("rep")), "rep", "left_semi")
    if known.count() > SMALL:  # a shuffled join is made once
        classes = written(classes, "class-texts")
    known = _relabelled(known, _links(classes, *_opened(known, classes, size, percent), size, percent))
    own = whole.select("doc_id", "n", "sig").distinct().join(equal.select("n", "sig", "rep"), ["n", "sig"]).join(known.select("rep", "comp"), "rep")
    own = own.groupBy("doc_id").agg(F.min("comp").alias("root"))
    return sets.select("doc_id", "n").join(own, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"), size=4, percent=85)


QUERIES = {"op8_jaccard": op8_jaccard}
ORACLE_SQL = {
    "op8_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) END AS sh FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
      FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS at FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.at = e.a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(r.at) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, s.sh
"""
}
