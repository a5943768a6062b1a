import csv
import io
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators.readers import read_files
from quire.plans.notes import compose
from quire.sources import delimited, html_render, lines, mail, notebook, subtitles

cell = st.text(st.characters(blacklist_characters="\r\0", blacklist_categories=("Cs",)), min_size=1, max_size=8).filter(lambda x: x.strip() == x)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(cell, min_size=2, max_size=4), min_size=1, max_size=5))
def test_delimited_round_trip(rows):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(rows)
    assert delimited.parse(out.getvalue(), ",") == rows


def test_sniff():
    for d in ",;\t|":
        assert delimited.sniff(f"a{d}b{d}c\n1{d}2{d}3\n") == d


def test_html():
    md = html_render.read_html(b"<title>T</title><p>a<b>b<p>c</b>d<table><tr><td rowspan=2>x<td>y<tr><td>z</table><ul><li>q<ul><li>w</ul></ul><ol start=3><li>e</ol>")["markdown"]
    assert md == "# T\n\na**b**\n\n**c**d\n\n| x | y |\n| --- | --- |\n|  | z |\n\n- q\n  - w\n\n3. e"


def test_the_reader_takes_titles_by_the_rules_of_html():
    title = lambda data: dict(html_render.read_html(data)["frontmatter"]).get("title")
    assert title(b"<TITLE> a&amp;&amp\n b &#39;c&amp;lt; </TITLE><p>d") == "a&& b 'c<" and title(b"<h1>only </h1>") == "only" and title(b"<p>d") is None


def test_unclosed_bold_is_reconstructed_three_deep():
    md = html_render.read_html(b"<p><b>a<p><b>b<p><b>c<p><b>d<p>e")["markdown"]
    assert md.split("\n\n")[-1].count("*") == 12


def test_subtitles():
    got = subtitles.read_subtitles(b"WEBVTT\n\n00:01.000 --> 00:02.000\n<v Bob>Hello\n\n00:02.500 --> 00:03.000\n<v Bob>again\n\n00:09.000 --> 00:10.000\n<v Bob>later\n")
    assert got["markdown"] == "**00:01 Bob:** Hello again\n\n**00:09 Bob:** later"
    assert subtitles.appended("one two three four", "three four five") == "one two three four three four five"
    assert subtitles.appended("and then the cat sat down", "the cat sat down again") == "and then the cat sat down again"


def test_mail():
    raw = b"From: =?UTF-8?B?4oKsIDEwMA==?= <a@b>\r\nSubject: Hi\r\nContent-Type: multipart/mixed; boundary=x\r\n\r\n--x\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\nA=C3=A9=\r\nc\r\n--x\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename*0*=utf-8''%E2%82%AC; filename*1=x.pdf\r\nContent-Transfer-Encoding: base64\r\n\r\nAAAA\r\n--x--\r\n"
    got = mail.read_eml(raw)
    assert got["markdown"] == "# Hi\n\nAéc" and got["warnings"] == ["Attachments not converted: €x.pdf (3 B)"]
    assert dict(got["frontmatter"])["from"] == "€ 100 <a@b>"


def test_notebook():
    book = {"cells": [{"cell_type": "code", "source": "1", "outputs": [{"output_type": "stream", "text": "\x1b[31mx\x1b[0m\n"}]}], "metadata": {}}
    assert notebook.read_notebook(json.dumps(book).encode())["markdown"] == "```\n1\n```\n\n```\nx\n```"


def test_join_blocks_is_idempotent():
    once = lines.join_blocks(["", "a", "", " ", "b", ""])
    assert once == "a\n\nb" and lines.join_blocks(once.split("\n")) == once


def test_files_are_isolated(spark):
    rows = [("a/x.csv", bytearray(b"a,b\n1,2\n")), ("a/y.ipynb", bytearray(b"no")), ("z.exe", bytearray(b""))]
    got = {r.path: r for r in compose(read_files(spark.createDataFrame(rows, "path string, content binary"))).collect()}
    assert got["a/x.csv"].error is None and "| 1 | 2 |" in got["a/x.csv"].note
    assert got["a/y.ipynb"].error and got["z.exe"].error and got["z.exe"].note is None
