"""Queries of page layout and recognition over the reference tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import _KEY, _t, query
from .plans import layout, ocr

# Every document as pages of positioned words: eight in a row, fifty rows a page.
_WORDS = r"""w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS k FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
  i AS (SELECT doc_id, k // 400 AS page, (k // 8) % 50 AS r, k % 8 AS c, word FROM w)"""
_JOINED = r"""string_agg(CASE WHEN c > 0 AND 60 - 5 * prev > 2 THEN ' ' ELSE '' END || word, '' ORDER BY c)"""
_ROWS = "WITH " + _WORDS + ", j AS (SELECT *, lag(length(word)) OVER (PARTITION BY doc_id, page, r ORDER BY c) AS prev FROM i) SELECT doc_id, page, r AS line_ord, " + _JOINED + ' AS text, max(72.0 + 60 * c + 5 * length(word))::DOUBLE AS "right" FROM j GROUP BY doc_id, page, r'

_WORD = r"([^\x20\x09-\x0D]+)"


def _words(spark, d) -> DataFrame:
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_WORD), F.lit(1))
    return _t(spark, d, "documents").select("doc_id", F.posexplode(words).alias("k", "word"))


def _placed(words: DataFrame) -> DataFrame:
    k = F.col("k")
    r, c = F.floor(k / 8) % 50, k % 8
    size = F.length("word")
    return words.select("doc_id", F.floor(k / 400).alias("page"), (F.lit(400) - k % 400).alias("item_ord"), F.col("word").alias("text"), (72.0 + 60 * c).alias("x"), (760.0 - 14 * r + c % 3).alias("y"), (5.0 * size).alias("width"), F.lit(10.0).alias("size"))


@query("pdf_rows", _ROWS)
def _(spark, d):
    return layout.item_lines(_placed(_words(spark, d))).select("doc_id", "page", "line_ord", "text", "right")


# The words as lines of two columns of forty, given row by row; with few on the right the page reads straight across.
@query("pdf_columns", "WITH " + _WORDS.split(",\n")[0] + """, i AS (SELECT doc_id, k // 80 AS page, k % 80 AS pos, word, count(*) OVER (PARTITION BY doc_id, k // 80) AS n FROM w)
  SELECT doc_id, page, pos AS line_ord, word AS text FROM i WHERE n > 54
  UNION ALL SELECT doc_id, page, pos % 40, string_agg(word, ' ' ORDER BY pos) FROM i WHERE n <= 54 GROUP BY doc_id, page, pos % 40""")
def _(spark, d):
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_WORD), F.lit(1))
    docs = _t(spark, d, "documents").select("doc_id", words.alias("words"))
    # A page is cut from its document's row; the outer form keeps Spark from finding the words once more to look for empty documents.
    first = F.sequence(F.lit(0), F.floor(F.greatest(F.size("words") - 1, F.lit(0)) / 80).cast("int"))
    pages = docs.select("doc_id", F.posexplode_outer(F.transform(first, lambda p: F.slice("words", p * 80 + 1, 80))).alias("page", "words"))
    item = lambda word, at: F.struct(word.alias("text"), F.when(at < 40, 72.0).otherwise(330.0).alias("x"), (760.0 - 14 * (at % 40)).alias("y"), F.lit(200.0).alias("width"), F.lit(10.0).alias("size"))
    return layout.lines_in_order(pages.select("doc_id", F.col("page").cast("long").alias("page"), F.transform("words", item).alias("items"))).select("doc_id", "page", "line_ord", "text")


@query("pdf_item_columns", 'SELECT user_id AS doc_id, event_id AS item_ord, CASE WHEN event_id % 450 + 5 < 150 THEN 0 WHEN event_id % 450 + 5 < 300.5 THEN 1 ELSE 2 END::BIGINT AS "column" FROM events')
def _(spark, d):
    items = _t(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.lit(0).alias("page"), F.col("event_id").alias("item_ord"), (F.col("event_id") % 450).alias("x"), F.lit(10.0).alias("width"))
    at = items.select("doc_id", "page").distinct().select("*", F.explode(F.array(F.lit(150.0), F.lit(300.5))).alias("gutter"))
    return layout.column_of(items, at).select("doc_id", "item_ord", F.col("column").cast("long").alias("column"))


# Rows of words with a running title above and a page number below each page.
_BODY = "WITH " + _WORDS + """, b AS (SELECT doc_id, page, r + 1 AS r, string_agg(word, ' ' ORDER BY c) AS text FROM i GROUP BY doc_id, page, r),
  a AS (SELECT * FROM b UNION ALL SELECT DISTINCT doc_id, page, 0, 'Report ' || doc_id || ' volume' FROM b UNION ALL SELECT DISTINCT doc_id, page, 60, 'page ' || page FROM b),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY doc_id, page) AS n FROM a),
  e AS (SELECT *, k < 2 OR k >= n - 2 AS edge, """ + _KEY.format("text") + """ AS key FROM n),
  t AS (SELECT doc_id, key, count(DISTINCT page) AS times FROM e WHERE edge AND key <> '' GROUP BY 1, 2),
  p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM e GROUP BY 1),
  f AS (SELECT doc_id, key, times FROM t JOIN p USING (doc_id) WHERE times >= greatest(3, ceil(pages / 2.0)))"""


def _titled(spark, d) -> DataFrame:
    k = F.col("k")
    r = F.floor(k / 8) % 50
    body = _words(spark, d).groupBy("doc_id", F.floor(k / 400).alias("page"), (r + 1).alias("r")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("text"))
    pages = body.select("doc_id", "page").distinct()
    said = body.unionByName(pages.select("*", F.lit(0).cast("long").alias("r"), F.concat(F.lit("Report "), F.col("doc_id").cast("string"), F.lit(" volume")).alias("text"))).unionByName(pages.select("*", F.lit(60).cast("long").alias("r"), F.concat(F.lit("page "), F.col("page").cast("string")).alias("text")))
    return said.select("doc_id", "page", F.col("r").alias("item_ord"), "text", F.lit(72.0).alias("x"), (800.0 - 12 * F.col("r")).alias("y"), (5.0 * F.length("text")).alias("width"), F.lit(10.0).alias("size"))


def _running(spark, d):
    rows = layout.page_rows(_titled(spark, d))
    pages = rows.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    return rows, layout.repeated(layout.edge_rows(rows), pages)


@query("pdf_furniture", _BODY + " SELECT doc_id, key, times FROM f")
def _(spark, d):
    return _running(spark, d)[1]


@query("pdf_without_furniture", _BODY + " SELECT doc_id, page, k AS row_ord, text FROM e WHERE NOT edge OR NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = e.doc_id AND f.key = e.key)")
def _(spark, d):
    rows, running = _running(spark, d)
    return layout.without_furniture(rows, running).select("doc_id", "page", "row_ord", "text")


def _order():
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


_SIZED = """l AS (SELECT l_orderkey % 50 AS doc_id, l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_ord, repeat(l_returnflag, (l_partkey % 140)::INT + 1) AS text, 8 + floor(l_quantity / 7) AS size FROM lineitem),
  h AS (SELECT doc_id, floor(size * 2 + 0.5) / 2 AS half, sum(length(text)) AS chars, min((page, line_ord)) AS first FROM l GROUP BY 1, 2),
  b AS (SELECT doc_id, half AS body_size FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, first) = 1)"""


def _sized(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.pmod("l_orderkey", F.lit(50)).alias("doc_id"), F.col("l_orderkey").alias("page"), F.row_number().over(_order()).cast("long").alias("line_ord"), F.expr("repeat(l_returnflag, cast(l_partkey % 140 as int) + 1)").alias("text"), (8 + F.floor(F.col("l_quantity") / 7)).cast("double").alias("size"))


@query("pdf_body_size", "WITH " + _SIZED + " SELECT doc_id, body_size FROM b")
def _(spark, d):
    return layout.body_size(_sized(spark, d))


@query("pdf_headings", "WITH " + _SIZED + """, v AS (SELECT l.*, CASE WHEN length(text) > 120 OR size / body_size < 1.2 THEN NULL WHEN size / body_size >= 1.8 THEN 1 WHEN size / body_size >= 1.45 THEN 2 ELSE 3 END AS lv FROM l JOIN b USING (doc_id)),
  g AS (SELECT *, CASE WHEN lv IS NOT NULL AND lag(lv) OVER w IS NOT NULL AND lag(size) OVER w = size THEN 0 ELSE 1 END AS new FROM v WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_ord)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY line_ord) AS run FROM g)
  SELECT doc_id, page, line_ord, (CASE WHEN count(*) OVER (PARTITION BY doc_id, page, run) <= 2 THEN lv END)::BIGINT AS level FROM s""")
def _(spark, d):
    lines = _sized(spark, d)
    return layout.heading_levels(lines, layout.body_size(lines)).select("doc_id", "page", "line_ord", F.col("level").cast("long").alias("level"))


# Rows of ten words as lines; a line short of the median's share ends its block, and so do list items.
@query("pdf_paragraphs", r"WITH " + _WORDS.split(",\n")[0] + r""", l AS (SELECT doc_id, k // 300 AS page, (k // 10) % 30 AS n, string_agg(word, ' ' ORDER BY k) AS text FROM w GROUP BY 1, 2, 3),
  m AS (SELECT doc_id, 5.0 * length(text) AS wide FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(text)) = count(*) OVER (PARTITION BY doc_id) // 2 + 1),
  q AS (SELECT l.*, 5.0 * length(text) < wide * 0.85 AS short, regexp_matches(text, '^([•·◦▪‣∙*+-]|[0-9]{1,3}[.)]) ') AS item FROM l JOIN m USING (doc_id)),
  g AS (SELECT *, CASE WHEN item OR lag(short OR item) OVER w OR lag(n) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM q WINDOW w AS (PARTITION BY doc_id, page ORDER BY n)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY n) AS block FROM g),
  t AS (SELECT *, regexp_replace(text, '^([•·◦▪‣∙*+-]|[0-9]{1,3}[.)]) ', '') AS said, lead(n) OVER (PARTITION BY doc_id, page, block ORDER BY n) IS NULL AS last FROM s),
  o AS (SELECT doc_id, page, block, bool_or(item) AS item, string_agg(CASE WHEN last THEN said WHEN regexp_matches(said, '[‐-]$') THEN left(said, length(said) - 1) ELSE said || ' ' END, '' ORDER BY n) AS said FROM t GROUP BY 1, 2, 3)
  SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY block) - 1 AS ord, CASE WHEN item THEN '- ' ELSE '' END || regexp_replace(said, '([\\`*_\[\]{}<>])', '\\\1', 'g') AS markdown FROM o WHERE said <> ''""")
def _(spark, d):
    k = F.col("k")
    lines = _words(spark, d).groupBy("doc_id", F.floor(k / 300).alias("page"), (F.floor(k / 10) % 30).alias("line_ord")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("text"))
    lines = lines.select("*", F.lit(10.0).alias("size"), (700.0 - 12 * F.col("line_ord")).alias("top"), F.lit(72.0).alias("left"), (72.0 + 5 * F.length("text")).alias("right"))
    return layout.page_blocks(lines, layout.body_size(lines), layout.upper_median_width(lines))


# Made sentences with bars and strokes; every line of an order as a recognised line, each a group of its own.
@query("ocr_strokes", r"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND doc_id % 3 = 0 THEN t ELSE regexp_replace(regexp_replace(t, '^[|l]( [a-z]|[''’]ve [a-z])', 'I\1'), '\(l am', '(I am') END AS text
  FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '| ' ELSE 'l''ve ' END || source || CASE WHEN doc_id % 5 = 0 THEN ' | End' ELSE ' (l am)' END AS t FROM documents)""")
def _(spark, d):
    i = F.col("doc_id")
    text = F.concat(F.when(i % 3 == 0, "| ").otherwise("l've "), "source", F.when(i % 5 == 0, " | End").otherwise(" (l am)"))
    return _t(spark, d, "documents").select("doc_id", ocr.repair_strokes(text).alias("text"))


@query("ocr_paragraphs", """WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, l_returnflag || l_linenumber AS text, l_quantity AS conf, 100 + l_quantity * 4 AS x1 FROM lineitem),
  m AS (SELECT doc_id, max(x1) AS margin FROM l GROUP BY 1),
  c AS (SELECT l.*, CASE WHEN (lag(x1) OVER w - 10) / (margin - 10) >= 0.6 AND lag(x1) OVER w + 4 + 30 > margin THEN 0 ELSE 1 END AS new FROM l JOIN m USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS unit FROM c),
  p AS (SELECT doc_id, unit, string_agg(text, ' ' ORDER BY k) AS text, avg(conf * 2) AS conf FROM s GROUP BY 1, 2)
  SELECT doc_id, coalesce(string_agg(text, chr(10) ORDER BY unit) FILTER (conf >= 60), '') AS text, count(*) FILTER (conf < 60) AS discarded FROM p GROUP BY 1""")
def _(spark, d):
    at = F.row_number().over(_order())
    e = _t(spark, d, "lineitem").withColumn("at", at).withColumn("text", F.concat("l_returnflag", F.col("l_linenumber").cast("string")))
    lines = e.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.col("at").alias("group_ord"), F.lit(0).alias("line_ord"), "text", (F.col("l_quantity") * 2).alias("confidence"), F.lit(10.0).alias("x0"), (20.0 * F.col("at")).alias("y0"), (100 + F.col("l_quantity") * 4).alias("x1"), (20.0 * F.col("at") + 16).alias("y1"), F.lit(30.0).alias("first_word_width"))
    return ocr.paragraphs(lines).select("doc_id", F.array_join("paragraphs", "\n").alias("text"), "discarded")
