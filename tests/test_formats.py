import json

import pytest

from quire.operators.options import Options, load_options, output_folder
from quire.operators.readers import pattern, read_files, scan
from quire.plans.notes import attachments, compose, linked, placed
from quire.sources import delimited, notebook, opendocument, recognition, sheets, subtitles
from tests.test_packages import packed

NS = 'xmlns:office="urn:o:office:1.0" xmlns:text="urn:o:text:1.0" xmlns:table="urn:o:table:1.0" xmlns:draw="urn:o:drawing:1.0" xmlns:style="urn:o:style:1.0" xmlns:fo="urn:o:fo:1.0" xmlns:xlink="urn:x" xmlns:svg="urn:s" xmlns:dc="d" xmlns:meta="m"'


def odf(body: str, styles: str = "", **parts) -> bytes:
    return packed({"content.xml": f"<office:document-content {NS}><office:automatic-styles>{styles}</office:automatic-styles><office:body>{body}</office:body></office:document-content>", **parts})


def test_open_text():
    body = '<office:text><text:tracked-changes><text:p>old</text:p></text:tracked-changes><text:table-of-content text:name="Contents"><text:p>x 1</text:p></text:table-of-content><text:p>a <text:span text:style-name="B">b <text:span text:style-name="I">c</text:span></text:span><text:a xlink:href="http://e">l</text:a><text:tab/><text:line-break/>z</text:p><draw:frame><draw:image xlink:href="./Pictures/i.png"/><svg:title>T  x</svg:title></draw:frame><draw:frame><draw:image xlink:href="m.wmf"/></draw:frame><table:table><table:table-row><table:table-cell><text:p>h</text:p></table:table-cell><table:covered-table-cell/><table:table-cell><text:p>k</text:p><text:p>m</text:p></table:table-cell></table:table-row></table:table></office:text>'
    styles = '<style:style style:name="B" style:family="text"><style:text-properties fo:font-weight="bold"/></style:style><style:style style:name="I" style:family="text"><style:text-properties fo:font-style="italic"/></style:style>'
    got = opendocument.read_opendocument(odf(body, styles, **{"Pictures/i.png": "png", "meta.xml": f"<m {NS}><dc:title> A  b </dc:title><dc:creator>C</dc:creator></m>"}), lambda d, e: f"![[{e}]]")
    assert got["markdown"] == "a **b** ***c***[l](http://e) \nz\n\n![[png]]\n*T x*\n\n| h |  | k<br>m |\n| --- | --- | --- |"
    assert got["frontmatter"] == [("title", "A b"), ("author", "C")] and len(got["warnings"]) == 2 and "Contents" in got["warnings"][1]


def test_open_sheets_leave_hidden_ones_out():
    body = '<office:spreadsheet><table:table table:name="A" table:style-name="v"><table:table-row table:number-rows-repeated="2"><table:table-cell office:value="1.5"/></table:table-row></table:table><table:table table:name="B" table:style-name="h"/></office:spreadsheet>'
    styles = '<style:style style:name="h" style:family="table"><style:table-properties table:display="false"/></style:style>'
    got = opendocument.read_opendocument(odf(body, styles), hidden=False)
    assert got["markdown"] == "## A\n\n| 1.5 |\n| --- |\n| 1.5 |" and got["frontmatter"] == [("sheets_converted", "1/2")] and "B" in got["warnings"][0]
    with pytest.raises(ValueError):
        opendocument.read_opendocument(packed({"x": "y"}))


def test_numbers_without_a_style():
    parts = {"xl/workbook.xml": '<w xmlns:r="r"><sheets><sheet name="A" r:id="1"/><sheet name="E" r:id="2"/></sheets></w>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="1" Type="x/worksheet" Target="a.xml"/><Relationship Id="2" Type="x/worksheet" Target="b.xml"/></R>', "xl/a.xml": "<w><sheetData><row><c><v>0.30000000000000004</v></c></row></sheetData></w>", "xl/b.xml": "<w><sheetData/></w>"}
    got = sheets.read_xlsx(packed(parts))
    assert "| 0.3 |" in got["markdown"] and got["frontmatter"] == [("sheets_converted", "1/2")]


def test_captions_count_broken_cues():
    got = subtitles.read_subtitles(b"WEBVTT\n\n00:01.000 --> 00:02.000\nx\n\nbad --> time\ny\n")
    assert got["frontmatter"][0] == ("cues_converted", "1/2") and got["markdown"] == "**00:01** x"
    assert subtitles.read_subtitles(b"WEBVTT\n\nbad --> time\ny\n")["markdown"] == ""
    got = subtitles.read_subtitles(b"WEBVTT\nKind: chapters\n\n00:01.000 --> 00:02.000\nStart\n")
    assert got["markdown"] == "## 00:01 Start"
    with pytest.raises(ValueError):
        subtitles.read_subtitles(b"WEBVTT\n")


def test_notebooks_fall_through_and_need_cells():
    out = {"output_type": "display_data", "data": {"image/png": "", "text/markdown": " ", "text/plain": "p"}}
    book = {"cells": [{"cell_type": "code", "source": "", "outputs": [out]}]}
    assert notebook.read_notebook(json.dumps(book).encode(), lambda d, e: None)["markdown"] == "```\np\n```"
    with pytest.raises(ValueError):
        notebook.read_notebook(b'{"cells": []}')


def test_rows_that_look_like_data():
    assert delimited.looks_like_data(["1 000,5 €", "2024-01-02 and more", ""]) and not delimited.looks_like_data(["1x", "2"])


def test_options():
    o = load_options('{"outputLocation": "folder", "outputFolder": "a//b/", "extractImages": false, "other": 1}')
    assert o == Options(output_location="folder", output_folder="a//b/", extract_images=False) and load_options(None) == Options()
    assert output_folder(o, "x/y.pdf") == "a/b" and output_folder(Options(), "x/y.pdf") == "x"
    with pytest.raises(ValueError):
        output_folder(o, "x/y.pdf", {"a/b"})


def test_engine_folder(tmp_path):
    with pytest.raises(ValueError, match="missing"):
        recognition.engine_files(str(tmp_path))
    for name in (recognition.CORES[1], recognition.CORES[4], recognition.LANGUAGES[1]):
        (tmp_path / name).write_bytes(b"")
    assert recognition.engine_files(str(tmp_path))[0].endswith(recognition.CORES[1])


def test_any_letter_case_is_scanned(spark, tmp_path):
    for name in ("A.CSV", "b.csv", "c.exe"):
        (tmp_path / name).write_text("x,y\n1,2\n")
    found = read_files(scan(spark, str(tmp_path))).collect()
    assert len(found) == 2 and all(r.error is None for r in found) and "[cC][sS][vV]" in pattern()
    assert read_files(scan(spark, str(tmp_path), every=True)).where("error IS NOT NULL").count() == 1


def test_notes_are_placed_and_linked(spark):
    page = b"<p>x</p><img src='data:image/png;base64,iVBORw0KGgo='>"
    rows = [("f/a.html", bytearray(page)), ("g/a.html", bytearray(page)), ("f/a.csv", bytearray(b"p,q\n1,2"))]
    files = spark.createDataFrame(rows, "path string, content binary")
    notes = placed(compose(linked(read_files(files))))
    got = {r.path: r for r in notes.collect()}
    assert got["f/a.csv"].note_path == "f/a.md" and got["f/a.html"].note_path == "f/a 2.md" and '"[[f/a.html]]"' in got["f/a.html"].note and "[[a.csv]]" in got["f/a.csv"].note
    assert {r.asset_path.rsplit("/", 1)[0] for r in attachments(notes).collect()} == {"f/a 2 attachments", "g/a attachments"}
    plain = compose(read_files(files, Options(extract_images=False)), Options(add_frontmatter=False, add_conversion_notes=False)).where("path = 'f/a.html'").collect()[0]
    assert plain.note == "x\n" and plain.assets == []
