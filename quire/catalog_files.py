"""Queries that build files of each format from the reference tables and convert them, with the notes that SQL expects."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import _t, query
from .operators.readers import read_files
from .plans import relations

_NS = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:draw="urn:oasis:names:tc:opendocument:xmlns:drawing:1.0" xmlns:presentation="urn:oasis:names:tc:opendocument:xmlns:presentation:1.0" xmlns:style="urn:oasis:names:tc:opendocument:xmlns:style:1.0" xmlns:fo="urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0"'


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _built(rows: DataFrame, build: Callable[[list], bytes]) -> DataFrame:
    """path, content of ``rows`` (path, rows: array of arrays of text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [build(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["path", "content"])

    return rows.select("path", "rows").mapInArrow(run, "path string, content binary")


def _grouped(rows: DataFrame, key: Column, order: list[str], cells: list[Column], ext: str) -> DataFrame:
    """A file for each key: its rows in order, each an array of text."""
    row = F.struct(*order, F.array(*[c.cast("string") for c in cells]).alias("cells"))
    got = rows.groupBy(key.cast("string").alias("k")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return got.select(F.concat("k", F.lit(ext)).alias("path"), F.transform("rows", lambda r: r["cells"]).alias("rows"))


def _esc(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _customers(spark, d, ext: str) -> DataFrame:
    return _grouped(_t(spark, d, "customer"), F.pmod("c_custkey", F.lit(20)), ["c_custkey"], [F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")], ext)


_CUSTOMERS = "SELECT c_custkey % 20 || '{0}' AS path, {1} AS markdown FROM customer GROUP BY c_custkey % 20"
_TABLE = "'| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' |', chr(10) ORDER BY c_custkey"
_NAME = r"regexp_replace(c_name, '([\\`*_\[\]{}<>])', '\\\1', 'g')"


def _word(rows: list) -> bytes:
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>{_esc(k)}</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>{_esc(name)}</w:t></w:r><w:r><w:t xml:space="preserve">  in   {_esc(seg)}</w:t></w:r></w:p>' for k, name, seg in rows)
    return _zipped({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'})


@query("docx_notes", _CUSTOMERS.format(".docx", f"string_agg('## ' || c_custkey || chr(10) || chr(10) || '**' || {_NAME} || '** in ' || c_mktsegment, chr(10) || chr(10) ORDER BY c_custkey)"))
def _(spark, d):
    return read_files(_built(_customers(spark, d, ".docx"), _word)).select("path", "markdown")


def _deck(rows: list) -> bytes:
    parts = {"ppt/presentation.xml": '<p:p xmlns:p="p" xmlns:r="r"><p:sldIdLst>' + "".join(f'<p:sldId id="{k}" r:id="r{k}"/>' for k in range(len(rows))) + "</p:sldIdLst></p:p>"}
    parts["ppt/_rels/presentation.xml.rels"] = "<R>" + "".join(f'<Relationship Id="r{k}" Type="x/slide" Target="slides/slide{len(rows) - k}.xml"/>' for k in range(len(rows))) + "</R>"
    for k, (key, name, seg) in enumerate(rows):
        shapes = f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:rPr b="1"/><a:t>{_esc(key)}</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:txBody><a:p><a:r><a:t>{_esc(name)}</a:t></a:r></a:p><a:p><a:pPr lvl="1"/><a:r><a:t>{_esc(seg)}</a:t></a:r></a:p></p:txBody></p:sp>'
        parts[f"ppt/slides/slide{len(rows) - k}.xml"] = f'<p:s xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:s>'
    return _zipped(parts)


@query("pptx_notes", _CUSTOMERS.format(".pptx", f"string_agg('## Slide ' || n || ': ' || c_custkey || chr(10) || chr(10) || '- ' || {_NAME} || chr(10) || '  - ' || c_mktsegment, chr(10) || chr(10) ORDER BY c_custkey)").replace("FROM customer", "FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey % 20 ORDER BY c_custkey) AS n FROM customer)"))
def _(spark, d):
    return read_files(_built(_customers(spark, d, ".pptx"), _deck)).select("path", "markdown")


def _workbook(rows: list) -> bytes:
    """Numbers without a style, dates by one, shared strings, and a hidden sheet that a formula reads."""
    cells = "".join(f'<row><c r="A{k}"><v>{key}</v></c><c r="B{k}" t="s"><v>{k - 1}</v></c><c r="D{k}" s="1"><v>{day}</v></c><c r="E{k}" s="2"><f>Aux!A1</f><v>{price}</v></c></row>' for k, (key, _, day, price) in enumerate(rows, 1))
    return _zipped({
        "xl/workbook.xml": '<w xmlns:r="r"><sheets><sheet name="Orders" r:id="a"/><sheet name="Aux" state="hidden" r:id="b"/><sheet name="Empty" r:id="c"/></sheets></w>',
        "xl/_rels/workbook.xml.rels": "<R>" + "".join(f'<Relationship Id="{k}" Type="x/worksheet" Target="worksheets/{k}.xml"/>' for k in "abc") + "</R>",
        "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>{_esc(text)}</t></si>" for _, text, _, _ in rows) + "</sst>",
        "xl/styles.xml": '<s><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="2"/></cellXfs></s>',
        "xl/worksheets/a.xml": f"<w><sheetData>{cells}</sheetData></w>",
        "xl/worksheets/b.xml": '<w><sheetData><row><c r="A1"><v>0.30000000000000004</v></c></row></sheetData></w>',
        "xl/worksheets/c.xml": "<w><sheetData/></w>",
    })


@query("xlsx_notes", """WITH o AS (SELECT *, '| ' || o_orderkey || ' | ' || o_orderpriority || ' |  | ' || strftime(o_orderdate, '%Y-%m-%d') || ' | ' || printf('%.2f', floor(o_totalprice)) || ' |' AS line, row_number() OVER (PARTITION BY o_orderkey % 40 ORDER BY o_orderkey) AS n FROM orders)
  SELECT o_orderkey % 40 || '.xlsx' AS path, '## Orders' || chr(10) || chr(10) || string_agg(line || CASE WHEN n = 1 THEN chr(10) || '| --- | --- | --- | --- | --- |' ELSE '' END, chr(10) ORDER BY n) || chr(10) || chr(10) || '## Aux' || chr(10) || chr(10) || '| 0.3 |' || chr(10) || '| --- |' AS markdown, '2/3' AS converted FROM o GROUP BY 1""")
def _(spark, d):
    serial = F.datediff(F.col("o_orderdate"), F.lit("1899-12-30").cast("date"))
    rows = _grouped(_t(spark, d, "orders"), F.pmod("o_orderkey", F.lit(40)), ["o_orderkey"], [F.col("o_orderkey"), F.col("o_orderpriority"), serial, F.floor("o_totalprice")], ".xlsx")
    front = F.element_at(F.filter("frontmatter", lambda f: f["key"] == "sheets_converted"), 1)["value"]
    return read_files(_built(rows, _workbook)).select("path", "markdown", front.alias("converted"))


def _text_document(rows: list) -> bytes:
    items = "".join(f'<text:list-item><text:p>{_esc(name)}</text:p><text:list><text:list-item><text:p>{_esc(seg)}</text:p></text:list-item></text:list></text:list-item>' for _, name, seg in rows)
    body = f'<text:h text:outline-level="2">{len(rows)} of them</text:h><text:p>A <text:span text:style-name="T1">bold</text:span> word<text:s text:c="2"/>and<text:note><text:note-body><text:p>the note</text:p></text:note-body></text:note></text:p><text:list text:style-name="L1">{items}</text:list>'
    styles = '<style:style style:name="T1" style:family="text"><style:text-properties fo:font-weight="bold"/></style:style><text:list-style style:name="L1"><text:list-level-style-number text:level="1"/><text:list-level-style-bullet text:level="2"/></text:list-style>'
    return _zipped({"content.xml": f"<office:document-content {_NS}><office:automatic-styles>{styles}</office:automatic-styles><office:body><office:text>{body}</office:text></office:body></office:document-content>"})


@query("odt_notes", _CUSTOMERS.format(".odt", f"'## ' || count(*) || ' of them' || chr(10) || chr(10) || 'A **bold** word  and[^1]' || chr(10) || chr(10) || string_agg('1. ' || {_NAME} || chr(10) || '  - ' || c_mktsegment, chr(10) ORDER BY c_custkey) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '[^1]: the note'"))
def _(spark, d):
    return read_files(_built(_customers(spark, d, ".odt"), _text_document)).select("path", "markdown")


def _open_sheet(rows: list) -> bytes:
    lines = "".join(f'<table:table-row><table:table-cell office:value="{key}"/><table:table-cell><text:p>{_esc(name)}</text:p></table:table-cell><table:table-cell table:number-columns-repeated="2"><text:p>{_esc(seg)}</text:p></table:table-cell><table:table-cell table:number-columns-repeated="1000"/></table:table-row>' for key, name, seg in rows)
    body = f'<table:table table:name="First">{lines}<table:table-row table:number-rows-repeated="5000"><table:table-cell/></table:table-row></table:table><table:table table:name="Void"/>'
    return _zipped({"content.xml": f"<office:document-content {_NS}><office:body><office:spreadsheet>{body}</office:spreadsheet></office:body></office:document-content>"})


@query("ods_notes", _CUSTOMERS.format(".ods", f"'## First' || chr(10) || chr(10) || string_agg('| ' || c_custkey || ' | ' || {_NAME} || ' | ' || c_mktsegment || ' | ' || c_mktsegment || ' |' || CASE WHEN n = 1 THEN chr(10) || '| --- | --- | --- | --- |' ELSE '' END, chr(10) ORDER BY c_custkey) || chr(10) || chr(10) || '## Void' || chr(10) || chr(10) || '*(empty sheet)*'").replace("FROM customer", "FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey % 20 ORDER BY c_custkey) AS n FROM customer)"))
def _(spark, d):
    return read_files(_built(_customers(spark, d, ".ods"), _open_sheet)).select("path", "markdown")


def _open_deck(rows: list) -> bytes:
    pages = "".join(f'<draw:page><draw:frame presentation:class="title"><draw:text-box><text:p>{_esc(key)}</text:p></draw:text-box></draw:frame><draw:frame><draw:text-box><text:p>{_esc(name)}</text:p></draw:text-box></draw:frame><presentation:notes><draw:frame><draw:text-box><text:p>{_esc(seg)}</text:p></draw:text-box></draw:frame></presentation:notes></draw:page>' for key, name, seg in rows)
    return _zipped({"content.xml": f"<office:document-content {_NS}><office:body><office:presentation>{pages}</office:presentation></office:body></office:document-content>"})


@query("odp_notes", _CUSTOMERS.format(".odp", f"string_agg('## ' || c_custkey || chr(10) || chr(10) || {_NAME} || chr(10) || chr(10) || '> [!note]- Speaker notes' || chr(10) || '> ' || c_mktsegment, chr(10) || chr(10) ORDER BY c_custkey)"))
def _(spark, d):
    return read_files(_built(_customers(spark, d, ".odp"), _open_deck)).select("path", "markdown")


def _book(rows: list) -> bytes:
    """Chapters whose file names are in another order than the spine, one left out of it."""
    ids = [f"c{len(rows) - k}" for k in range(len(rows))]
    parts = {"META-INF/container.xml": '<c><rootfiles><rootfile full-path="in/b.opf"/></rootfiles></c>'}
    items = "".join(f'<item id="{i}" href="{i}.xhtml" media-type="application/xhtml+xml"/>' for i in [*ids, "extra"])
    parts["in/b.opf"] = f'<p xmlns:dc="d"><metadata><dc:title>Book</dc:title></metadata><manifest>{items}</manifest><spine>' + "".join(f'<itemref idref="{i}"/>' for i in ids) + "</spine></p>"
    for i, (key, name, seg) in zip(ids, rows, strict=True):
        parts[f"in/{i}.xhtml"] = f"<html><body><h1>{_esc(key)}</h1><p>{_esc(name)} <b>{_esc(seg)}</b></p></body></html>"
    return _zipped(parts | {"in/extra.xhtml": "<html><body><p>x</p></body></html>"})


@query("epub_notes", _CUSTOMERS.format(".epub", f"string_agg('# ' || c_custkey || chr(10) || chr(10) || {_NAME} || ' **' || c_mktsegment || '**', chr(10) || chr(10) ORDER BY c_custkey)"))
def _(spark, d):
    return read_files(_built(_customers(spark, d, ".epub"), _book)).select("path", "markdown")


@query("tsv_notes", "SELECT n_regionkey || '.tsv' AS path, '| nation | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey")
def _(spark, d):
    rows = _grouped(_t(spark, d, "nation"), F.col("n_regionkey"), ["n_nationkey"], [F.col("n_name"), F.col("n_nationkey")], ".tsv")
    return read_files(_built(rows, lambda rows: "\r\n".join(["nation\tkey", *('"' + a + '"\t' + b for a, b in rows)]).encode("utf-8-sig"))).select("path", "markdown")


def _track(rows: list) -> bytes:
    """A cue a turn, ten seconds apart, the speaker by voice tag."""
    at = lambda s: f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}.000"
    return ("WEBVTT - Talk\n\nNOTE made\n\n" + "\n\n".join(f"{at(10 * k)} --> {at(10 * k + 4)}\n<v {role}>turn {turn}" for k, (turn, role) in enumerate(rows)) + "\n\nbroken --> line\nx\n").encode()


@query("vtt_notes", """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS k FROM conversations WHERE conv_id IS NOT NULL)
  SELECT conv_id || '.vtt' AS path, '# Talk' || chr(10) || chr(10) || string_agg('**' || printf('%02d:%02d', (10 * k) // 60, (10 * k) % 60) || ' ' || role || ':** turn ' || turn, chr(10) || chr(10) ORDER BY k) AS markdown, count(*) || '/' || (count(*) + 1) AS converted FROM c GROUP BY conv_id""")
def _(spark, d):
    rows = _grouped(_t(spark, d, "conversations").where("conv_id IS NOT NULL"), F.col("conv_id"), ["turn", "role"], [F.col("turn"), F.col("role")], ".vtt")
    front = F.element_at(F.filter("frontmatter", lambda f: f["key"] == "cues_converted"), 1)["value"]
    return read_files(_built(rows, _track)).select("path", "markdown", front.alias("converted"))


def _message(rows: list) -> bytes:
    name, segment = rows[0][1], rows[0][2]
    forwarded = f"From: a@b.c\r\nSubject: old\r\nContent-Type: text/plain\r\n\r\n> {segment}"
    return f"From: {name} <x@y.z>\r\nSubject: =?UTF-8?Q?caf=C3=A9?=\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\nHello=20{segment}=\r\n!\r\n--q\r\nContent-Type: message/rfc822\r\n\r\n{forwarded}\r\n--q--\r\n".encode()


@query("eml_notes", "SELECT c_custkey || '.eml' AS path, '# café' || chr(10) || chr(10) || 'Hello ' || c_mktsegment || '!' || chr(10) || chr(10) || '## Forwarded message: old' || chr(10) || chr(10) || '**From:** a@b.c' || chr(10) || chr(10) || '> ' || c_mktsegment AS markdown FROM customer")
def _(spark, d):
    rows = _grouped(_t(spark, d, "customer"), F.col("c_custkey"), ["c_custkey"], [F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")], ".eml")
    return read_files(_built(rows, _message)).select("path", "markdown")


@query("ipynb_notes", r"""SELECT event_id || '.ipynb' AS path, '# ' || event_type || chr(10) || chr(10) || '```python' || chr(10) || 'x = ' || event_id || chr(10) || '```' || chr(10) || chr(10) || '```' || chr(10) || props || chr(10) || '```' AS markdown FROM events WHERE props <> ''""")
def _(spark, d):
    js = F.to_json(F.struct(
        F.struct(F.struct(F.lit("python").alias("name")).alias("language_info")).alias("metadata"),
        F.array(F.to_json(F.struct(F.lit("markdown").alias("cell_type"), F.concat(F.lit("# "), "event_type").alias("source"))), F.to_json(F.struct(F.lit("code").alias("cell_type"), F.concat(F.lit("x = "), F.col("event_id").cast("string")).alias("source"), F.array(F.struct(F.lit("stream").alias("output_type"), F.concat(F.lit("\u001b[31m"), "props", F.lit("\u001b[0m\n")).alias("text"))).alias("outputs")))).alias("cells"),
    ))
    book = F.regexp_replace(F.get_json_object(js, "$.metadata"), "^", "")
    cells = F.array_join(F.from_json(F.get_json_object(js, "$.cells"), "array<string>"), ",")
    whole = F.concat(F.lit('{"metadata":'), book, F.lit(',"cells":['), cells, F.lit("]}"))
    files = _t(spark, d, "events").where("props <> ''").select(F.concat(F.col("event_id").cast("string"), F.lit(".ipynb")).alias("path"), F.encode(whole, "UTF-8").alias("content"))
    return read_files(files).select("path", "markdown")


def _pdf(rows: list) -> bytes:
    """A page a row: a title by size, items and a line between them, and a footer that runs."""
    esc = lambda s: s.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{4 + 2 * k} 0 R' for k in range(len(rows)))}] /Count {len(rows)} >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for k, (key, name, segment) in enumerate(rows):
        told = key.translate(str.maketrans("0123456789", "abcdefghij"))
        body = f"BT /F1 24 Tf 72 720 Td ({told}) Tj ET BT /F1 10 Tf 72 690 Td (- ref {told}) Tj 0 -30 Td ({esc(name)} and what it is about, in a line of) Tj 300 0 Td (length) Tj -300 -40 Td (- in ) Tj 30 0 Td ({esc(segment)} ) Tj 80 0 Td ({told}) Tj ET BT /F1 8 Tf 72 40 Td (Running foot {k + 1}) Tj ET"
        objects += [f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * k} 0 R >>", f"<< /Length {len(body)} >>\nstream\n{body}\nendstream"]
    text = "%PDF-1.4\n" + "".join(f"{n} 0 obj\n{o}\nendobj\n" for n, o in enumerate(objects, 1)) + "trailer << /Root 1 0 R >>\n%%EOF"
    return text.encode("latin1")


@query("pdf_notes", "WITH c AS (SELECT *, translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij') AS told FROM customer) " + _CUSTOMERS.format(".pdf", f"string_agg('# ' || told || chr(10) || chr(10) || '- ref ' || told || chr(10) || chr(10) || {_NAME} || ' and what it is about, in a line of length' || chr(10) || chr(10) || '- in ' || c_mktsegment || ' ' || told, chr(10) || chr(10) ORDER BY c_custkey)").replace("FROM customer", "FROM c"))
def _(spark, d):
    return read_files(_built(_customers(spark, d, ".pdf"), _pdf)).select("path", "markdown")


# Look-ups between parts, on relations made of orders and their lines.
def _refs(spark, d):
    lines = _t(spark, d, "lineitem")
    refs = lines.select((F.col("l_orderkey") % 100).alias("doc_id"), F.concat(F.lit("xl/d/p"), (F.col("l_orderkey") % 7).cast("string")).alias("part"), (F.col("l_orderkey") * 100000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("r"), (F.col("l_partkey") % 60).cast("string")).alias("rid"), F.col("l_returnflag").alias("text")).distinct()
    rels = refs.select("doc_id", "part", "rid").distinct().where("int(substring(rid, 2)) % 3 <> 0").select("*", F.concat(F.lit("../media/"), "rid", F.when(F.substring("rid", -1, 1) == "4", ".emf").otherwise(".png")).alias("target"), F.lit("image").alias("type"), F.lit(False).alias("external"))
    return refs, rels


_REFS = """refs AS (SELECT DISTINCT l_orderkey % 100 AS doc_id, 'xl/d/p' || l_orderkey % 7 AS part, l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS ord, 'r' || l_partkey % 60 AS rid, l_returnflag AS text FROM lineitem),
  rels AS (SELECT DISTINCT doc_id, part, rid, rid || CASE WHEN right(rid, 1) = '4' THEN '.emf' ELSE '.png' END AS file FROM refs WHERE substr(rid, 2)::INT % 3 <> 0)"""


@query("hyperlinks", "WITH " + _REFS + " SELECT doc_id, part, ord, CASE WHEN file IS NULL THEN text ELSE '[' || text || '](../media/' || file || ')' END AS markdown FROM refs LEFT JOIN rels USING (doc_id, part, rid)")
def _(spark, d):
    return relations.hyperlinks(*_refs(spark, d))


@query("part_images", "WITH " + _REFS + " SELECT doc_id, part, ord, 'xl/media/' || file AS path FROM refs JOIN rels USING (doc_id, part, rid) WHERE file NOT LIKE '%.emf' AND doc_id % 5 <> 0")
def _(spark, d):
    refs, rels = _refs(spark, d)
    parts = relations.resolved(rels).where("doc_id % 5 <> 0").select("doc_id", "path").distinct()
    return relations.part_images(refs, rels, parts)


_SHEETS = "s AS (SELECT o_orderkey % 50 AS doc_id, o_orderkey AS tab_ord, ' Tab ' || o_orderkey || ' ' AS name, o_orderpriority LIKE '5%' OR o_orderpriority LIKE '4%' AS hidden FROM orders), r AS (SELECT DISTINCT l_orderkey % 50 AS doc_id, ' Tab ' || l_orderkey || ' ' AS sheet, 'TAB ' || (l_orderkey + 50) AS named FROM lineitem)"


def _sheets(spark, d):
    key = lambda c: F.concat(F.lit(" Tab "), c.cast("string"), F.lit(" "))
    hidden = F.col("o_orderpriority").startswith("5") | F.col("o_orderpriority").startswith("4")
    sheets = _t(spark, d, "orders").select((F.col("o_orderkey") % 50).alias("doc_id"), F.col("o_orderkey").alias("tab_ord"), key(F.col("o_orderkey")).alias("name"), hidden.alias("hidden"))
    named = _t(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("doc_id"), key(F.col("l_orderkey")).alias("sheet"), F.concat(F.lit("TAB "), (F.col("l_orderkey") + 50).cast("string")).alias("named")).distinct()
    return sheets, named


_KEPT = "k AS (SELECT * FROM s WHERE NOT hidden OR EXISTS (SELECT 1 FROM r JOIN s v ON v.doc_id = r.doc_id AND v.name = r.sheet AND NOT v.hidden WHERE r.doc_id = s.doc_id AND lower(trim(r.named)) = lower(trim(s.name))))"


@query("kept_sheets", f"WITH {_SHEETS}, {_KEPT} SELECT * FROM k")
def _(spark, d):
    return relations.kept_sheets(*_sheets(spark, d))


@query("skipped_sheets", f"WITH {_SHEETS}, {_KEPT} SELECT doc_id, string_agg(name, ', ' ORDER BY tab_ord) AS names FROM s ANTI JOIN k USING (doc_id, tab_ord) GROUP BY doc_id")
def _(spark, d):
    sheets, named = _sheets(spark, d)
    return relations.skipped_sheets(sheets, relations.kept_sheets(sheets, named))


def _manifest(spark, d):
    p = _t(spark, d, "part")
    manifest = p.select((F.col("p_partkey") % 30).alias("doc_id"), F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("href"), F.when(F.col("p_size") % 2 == 0, "application/xhtml+xml").otherwise("image/png").alias("media_type"), F.when(F.col("p_size") % 10 == 0, "scripted nav").alias("properties"))
    spine = p.where("p_size > 20").select((F.col("p_partkey") % 30).alias("doc_id"), F.col("p_partkey").alias("ord"), (F.col("p_partkey") + F.when(F.col("p_size") > 45, 1_000_000).otherwise(0)).cast("string").alias("idref"))
    return manifest, spine


@query("book_chapters", "SELECT p_partkey % 30 AS doc_id, p_partkey AS ord, 'c' || p_partkey AS href FROM part WHERE p_size > 20 AND p_size <= 45")
def _(spark, d):
    return relations.chapters(*_manifest(spark, d))


@query("unused_documents", "SELECT p_partkey % 30 AS doc_id, 'c' || p_partkey AS href FROM part WHERE p_size % 2 = 0 AND p_size % 10 <> 0 AND NOT (p_size > 20 AND p_size <= 45)")
def _(spark, d):
    return relations.unused_documents(*_manifest(spark, d))


@query("expanded_rows", """WITH r AS (SELECT o_orderkey % 60 AS doc_id, o_orderkey AS row_ord, o_orderkey % 4 AS rep, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS cell FROM orders),
  f AS (SELECT * FROM r JOIN (SELECT doc_id, max(row_ord) AS last FROM r WHERE trim(cell) <> '' GROUP BY 1) USING (doc_id) WHERE row_ord <= last)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY row_ord, c) - 1 AS row_ord, cell FROM f, unnest(range(greatest(rep, 1))) AS u(c)""")
def _(spark, d):
    o = F.col("o_orderkey")
    rows = _t(spark, d, "orders").select((o % 60).alias("doc_id"), o.alias("row_ord"), (o % 4).alias("repeat"), F.array(F.when(o % 3 == 0, " ").otherwise(F.col("o_orderpriority"))).alias("cells"))
    return relations.expanded_rows(rows).select("doc_id", "row_ord", F.trim(F.col("cells")[0]).alias("cell"))


@query("shared_segments", "SELECT text, bool_or(shared) AS shared FROM (SELECT DISTINCT o_orderpriority AS text, false AS shared FROM orders UNION ALL SELECT o_orderpriority, true FROM (SELECT o_orderpriority FROM orders INTERSECT SELECT o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority < '4')) GROUP BY text")
def _(spark, d):
    o = _t(spark, d, "orders")
    return relations.same_words(o.select(F.col("o_orderpriority").alias("text")), o.where("o_orderkey % 2 = 0 AND o_orderpriority < '4'").select(F.col("o_orderpriority").alias("text")))


@query("mime_depths", """WITH RECURSIVE p AS (SELECT c_custkey % 10 AS doc_id, c_custkey AS part_id, CASE WHEN c_custkey >= 10 THEN (c_custkey // 20) * 10 + c_custkey % 10 END AS parent_id, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS more FROM customer UNION ALL SELECT i, i, NULL, 0 FROM range(0, 1) AS u(i)),
  r AS (SELECT doc_id, part_id, 0 AS depth FROM p WHERE parent_id IS NULL UNION ALL SELECT p.doc_id, p.part_id, r.depth + p.more FROM p JOIN r ON p.doc_id = r.doc_id AND p.parent_id = r.part_id WHERE r.depth + p.more <= 4) SELECT doc_id, part_id, depth::INT AS depth FROM r""")
def _(spark, d):
    k = F.col("c_custkey")
    parts = _t(spark, d, "customer").select((k % 10).alias("doc_id"), k.alias("part_id"), F.when(k >= 10, F.floor(k / 20) * 10 + k % 10).alias("parent_id"), F.when(k % 3 == 0, "message/rfc822").otherwise("text/plain").alias("content_type"))
    return relations.mime_depths(parts.unionByName(spark.range(1).select(F.col("id").alias("doc_id"), F.col("id").alias("part_id"), F.lit(None).cast("long").alias("parent_id"), F.lit("text/plain").alias("content_type"))))
