"""Reply trees to chat-formatted conversations, with DataFrame operations only.

Self-joins that double their reach find each node's depth and path score; the best
leaves of a tree are kept; the same jumps then enumerate the nodes on their paths,
and each path becomes one text with a loss mask over its assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pii import let, running
from .store import Parts, table, written

HEAD, COLON, TAIL = "### ", ": ", "</turn>"


def escaped(text: Column) -> Column:
    """The text with no HEAD and no TAIL in it; ``unescaped`` gives it back."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit(TAIL), F.lit("<\\/turn>")), F.lit(HEAD), F.lit("##\\# "))


def unescaped(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("##\\# "), F.lit(HEAD)), F.lit("<\\/turn>"), F.lit(TAIL))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _header(role: Column) -> Column:
    return F.concat(F.lit(HEAD), F.replace(escaped(role), F.lit(COLON), F.lit(":\\s")), F.lit(COLON))


def _role(written_role: Column) -> Column:
    return unescaped(F.replace(written_role, F.lit(":\\s"), F.lit(COLON)))


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join whose sides are never broadcast: small tables of rounds compress well, and the driver would hold each in full."""
    return left.join(right.hint("merge"), on, how)


def _paths(nodes: DataFrame) -> tuple[Parts, int]:
    """A part a round of pointer doubling (tree_id, node_id, jump, depth, total, round), and the number of rounds that have jumps.

    Round k holds the nodes with an ancestor 2^k up (``jump``), and those whose root
    was reached in it (no jump, depth and path score in full); the latter are not joined
    again, so the rows of a round fall with the trees' depth.  No path has more jumps than
    there are replies: rows without a root by then are on a cycle of replies, or lead into one.
    """
    columns = ["tree_id", "node_id", "jump", "depth", "total", "round"]
    first = nodes.select("tree_id", "node_id", F.col("parent_id").alias("jump"), F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total"), F.lit(0).alias("round"))
    states = Parts(nodes.sparkSession, "paths", first.schema)
    states.add(first)
    replies, k = states.rows(0).where("jump IS NOT NULL").count(), 0
    while 1 << k <= replies and not (live := states.rows(k).where("jump IS NOT NULL")).isEmpty():
        up = states.rows().where(f"jump IS NULL OR round = {k}").select("tree_id", F.col("node_id").alias("jump"), F.col("jump").alias("next"), F.col("depth").alias("more"), F.col("total").alias("plus"))
        on = _joined(live, up, ["tree_id", "jump"])
        states.add(on.select("tree_id", "node_id", F.col("next").alias("jump"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("plus")).alias("total"), F.lit(k + 1).alias("round")).select(columns))
        k += 1
    return states, k


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with tree_id in a struct, which is not null where the id is, so that joins and groups keep that tree."""
    return rows.withColumn("tree_id", F.struct(F.col("tree_id").alias("id")))


def _unkeyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tree_id", F.col("tree_id.id"))


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """tree_id, leaf_id, branch (1 is best), pos (1 is the root) and node_id of the ``top`` best root-to-leaf paths of each tree.

    ``nodes``: tree_id, node_id, parent_id, score; node_id is unique in its tree and
    not null, a parent_id that no node has makes a root, a null score counts 0.
    Branches rank by mean score, then by smaller leaf_id.  Nodes on a cycle have no
    path.  Nodes with a null tree_id are one tree, whose id is null.  An empty input
    gives no rows.
    """
    nodes = _keyed(nodes)
    known = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    nodes = _joined(nodes, known, ["tree_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("known"), F.col("parent_id")))
    nodes = written(nodes.select("tree_id", "node_id", "parent_id", "score"), "nodes")
    states, rounds = _paths(nodes)
    rooted = states.rows().where("jump IS NULL")
    replied = nodes.where("parent_id IS NOT NULL").select("tree_id", F.col("parent_id").alias("node_id")).distinct()
    leaves = _joined(rooted, replied, ["tree_id", "node_id"], "left_anti")
    leaves = leaves.withColumn("mean", F.col("total") / F.col("depth"))
    order = [F.desc("mean"), "node_id"]
    part = F.pmod(F.xxhash64("node_id"), F.lit(64))  # a tree's leaves are ranked in parts first
    leaves = leaves.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("tree_id", "part").orderBy(*order))).where(F.col("r") <= top)
    leaves = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree_id").orderBy(*order))).where(F.col("branch") <= top)
    leaves = leaves.select("tree_id", F.col("node_id").alias("leaf_id"), "branch", "depth", "node_id", F.lit(0).cast("long").alias("up"))
    members = Parts(nodes.sparkSession, "members", leaves.schema)
    members.add(leaves)
    for k in reversed(range(rounds)):  # a distance is a sum of powers of two, the largest first: a jump starts from the few nodes found so far
        jumps = states.rows(k).where("jump IS NOT NULL").select("tree_id", "node_id", "jump")
        members.add(_joined(members.rows(), jumps, ["tree_id", "node_id"]).select("tree_id", "leaf_id", "branch", "depth", F.col("jump").alias("node_id"), (F.col("up") + (1 << k)).alias("up")))
    members = members.rows()
    return _unkeyed(members.select("tree_id", "leaf_id", "branch", (F.col("depth") - F.col("up")).alias("pos"), "node_id"))


def format_paths(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a path: tree_id, leaf_id, branch, formatted, loss (code-point spans of assistant texts: start, end exclusive).

    ``nodes``: tree_id, node_id, role, text; null roles and texts count as empty.
    """
    turns = _joined(_keyed(paths), _keyed(nodes.select("tree_id", "node_id", "role", "text")), ["tree_id", "node_id"])
    turn = F.struct("pos", _header(F.col("role")).alias("head"), escaped(F.col("text")).alias("body"), (F.coalesce("role", F.lit("")) == "assistant").alias("learn"))
    out = turns.groupBy("tree_id", "leaf_id", "branch").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    size = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(TAIL) + 1
    placed = lambda t, at: F.struct((at + F.length(t["head"])).cast("int").alias("start"), (at + F.length(t["head"]) + F.length(t["body"])).cast("int").alias("end"), t["learn"].alias("learn"))
    ends = let(running(F.transform("turns", lambda t: size(t).cast("long"))), lambda at: F.transform("turns", lambda t, i: placed(t, at[i])))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(TAIL + "\n"))), "")
    return _unkeyed(out).select("tree_id", "leaf_id", "branch", text.alias("formatted"), F.transform(F.filter(ends, lambda s: s["learn"]), lambda s: F.struct(s["start"], s["end"])).alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds, as they were before."""
    parts = F.split(formatted, F.lit(TAIL.replace(".", "\\.") + "\n"))
    parts = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        at = F.locate(COLON, F.substr(p, F.lit(len(HEAD) + 1)))
        return F.struct(_role(F.substr(p, F.lit(len(HEAD) + 1), at - 1)).alias("role"), unescaped(F.substr(p, F.lit(len(HEAD) + 1) + at + len(COLON) - 1)).alias("text"))

    return F.transform(parts, turn)


def learned(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, one assistant text after another."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def threads(conversations: DataFrame) -> DataFrame:
    """Nodes of conversations that are chains: the rows by turn, role and text, each a reply to the one before; score 0."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node_id", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").alias("tree_id"), "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def op3_chat(spark, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    nodes = written(threads(told.unionByName(extra)), "threads")
    out = format_paths(best_paths(nodes), nodes)
    turns = parse(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.select(F.col("tree_id").alias("conv_id"), "formatted", turns.alias("turns"), learned(F.col("formatted"), F.col("loss")).alias("kept"))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("kept").cast("long").alias("loss_chars"), F.sha2("kept", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


QUERIES = {"op3_chat": op3_chat}
ORACLE_SQL = {
    "op3_chat": r"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok'),
shown AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# ') AS body,
         replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# '), ': ', ':\s') AS head FROM told)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(head) + 2 + length(body) + 8)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""
}
