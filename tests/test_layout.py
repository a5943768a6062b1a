import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quire import catalog, catalog_layout  # noqa: F401
from quire.plans import layout, ocr
from quire.sources import page_arrays
from quire.sources import page_layout as page
from quire.sources import pdf, pdf_fonts, pdf_objects, png, recognition
from quire.sources.image import image_format, read_image
from quire.sources.page_layout import Item


def test_rows_join_items_by_baseline_and_gap():
    items = [Item("b", 30, 100, 10, 10), Item("a", 10, 102, 18.5, 10), Item("c", 60, 99, 5, 10), Item("d", 10, 80, 5, 10), Item("", 0, 0, 0, 0)]
    assert [x.text for x in page.lines(items)] == ["ab c", "d"]
    assert page.line([Item(" ", 0, 0, 5, 10)]) is None and page.lines([]) == []


def _columns(banner: bool) -> list[Item]:
    items = [Item(f"{side}{k}", x, 700 - 14 * k, 200, 10) for k in range(15) for side, x in (("l", 72), ("r", 330))]
    return items + [Item("whole width", 72, 800, 458, 14), Item("foot over all", 72, 590 - 14 * 8, 458, 14)] if banner else items


def test_columns_read_one_after_another_and_banners_part_them():
    assert [x.text for x in page.reading_order(_columns(False))] == [f"l{k}" for k in range(15)] + [f"r{k}" for k in range(15)]
    got = [x.text for x in page.reading_order(_columns(True))]
    assert got[0] == "whole width" and got[-1] == "foot over all" and got[1:16] == [f"l{k}" for k in range(15)]


def test_narrow_columns_go():
    assert page.wide_columns([100, 130, 300], 72, 540) == [300] and page.wide_columns([520], 72, 540) == []


def test_heading_runs_break_at_long_lines():
    big = page.Line("x", 20, 0, 0, 1)
    assert page.heading_levels([big, page.Line("y" * 130, 20, 0, 0, 1), big], 10) == [1, None, 1]
    assert page.heading_levels([big] * 3, 10) == [None] * 3 and page.heading_levels([big, big], 10) == [1, 1]


def test_furniture_key_drops_digits():
    assert page.furniture_key("Volume3Number 12") == "volumenumber"
    assert page.furniture_key("Winter 2007 x 27") == page.furniture_key("28 x Winter 2007")


def test_furniture_counts_pages_without_lines(spark):
    lines = spark.createDataFrame([(1, p, k, t) for p in range(3) for k, t in enumerate(["Head 1", "a" * (p + 1), "b" * (p + 1)])], "doc_id long, page long, line_ord long, text string")
    assert [r.key for r in layout.furniture(lines).collect()] == ["head"]
    many = spark.createDataFrame([(1, 8)], "doc_id long, pages long")
    assert layout.furniture(lines, many).count() == 0


def test_relational_layout_equals_one_document(spark):
    pages = [[Item("Head", 72, 760, 40, 10), *_columns(False), Item(f"page {k}", 72, 20, 40, 10)] for k in range(4)]
    rows = [(7, p, k, i.text, *map(float, i[1:])) for p, items in enumerate(pages) for k, i in enumerate(items)]
    items = spark.createDataFrame(rows, "doc_id long, page long, item_ord long, text string, x double, y double, width double, size double")
    got = layout.documents(items).collect()[0].markdown
    rows = [page.rows(p) for p in pages]
    done = [page.reading_order(page.without(r, page.running(rows))) for r in rows]
    every = [x for d in done for x in d]
    want = [x for d in done for x in page.render(d, page.body_size(every), page.median_width(every)) if x]
    assert got.replace("\n\n", "\n").split("\n") == want and "Head" not in got


def _any_page(r: random.Random) -> list[Item]:
    """Items anywhere, or columns with holes, steps, blanks, and now and then lines across them."""
    text = lambda: r.choice(["a", "bb", " c", "d ", " ", "", "\u2003", "é", "x y", "ü\u00a0"])
    if r.random() < 0.2:
        return [Item(text(), r.choice([72.0, r.uniform(0, 500)]), r.choice([r.uniform(0, 700), 14.0 * r.randrange(20)]), r.choice([0.0, r.uniform(0, 90)]), r.uniform(1, 30)) for _ in range(r.randrange(60))]
    wide, parts, full = r.choice([100.0, 140.0, 200.0]), r.randrange(1, 4), r.choice([0.3, 0.9, 1])
    pitch = wide + r.choice([4, 8, 20, 58])
    out = [Item(text(), 72 + c * pitch + k * wide / parts, 760.0 - 14 * n + r.choice([0, 0, 3.5]), wide / parts - r.choice([0, 3, 9]), r.choice([10.0, 10.0, 14.0])) for n in range(r.randrange(8, 40)) for c in range(r.randrange(2, 5)) for k in range(parts) if r.random() < full]
    out += [Item("across", 72.0 + r.choice([0, 200]), r.uniform(200, 800), r.choice([300.0, 458.0]), 14.0) for _ in range(r.choice([0, 0, 1, 3]))]
    return r.sample(out, len(out)) if r.random() < 0.5 else out


@pytest.mark.parametrize("cells", [900, page_arrays.CELLS])
def test_many_pages_at_once_equal_each_page_alone(monkeypatch, cells):
    monkeypatch.setattr(page_arrays, "CELLS", cells)
    r = random.Random(7)
    for size in (0, 1, 150, 150):
        pages = [_any_page(r) for _ in range(size)]
        every = [i for p in pages for i in p]
        items = page_arrays.Items(np.repeat(np.arange(size), [len(p) for p in pages]).astype(int), pa.array([i.text for i in every], pa.string()), *(np.array([i[c] for i in every], float) for c in range(1, 5)))
        got: dict[int, list] = {}
        for found in page_arrays.reading_order(items, size):
            for k, *x in zip(found.group.tolist(), found.text.to_pylist(), *(c.tolist() for c in found[2:]), strict=True):
                got.setdefault(k, []).append(page.Line(*x))
        assert [got.get(k, []) for k in range(size)] == [page.reading_order(p) for p in pages]


def test_lines_in_order_take_pages_apart_as_they_come(spark, monkeypatch):
    monkeypatch.setattr(layout, "TOGETHER", 40)
    rows = [(7, p, [(i.text, *map(float, i[1:])) for i in _columns(p % 2 == 1)]) for p in range(5)] + [(8, 0, []), (8, 1, None), (8, 2, [(None, 1.0, 1.0, 1.0, 1.0), ("x", 1.0, 1.0, 1.0, 1.0)])]
    pages = spark.createDataFrame(rows, "doc_id long, page long, items array<struct<text:string,x:double,y:double,width:double,size:double>>").coalesce(1)
    got = sorted((r.doc_id, r.page, r.line_ord, r.text) for r in layout.lines_in_order(pages).collect())
    assert got == [(7, p, k, x.text) for p in range(5) for k, x in enumerate(page.reading_order(_columns(p % 2 == 1)))] + [(8, 2, 0, "x")]


def test_columns_of_words_are_laid_out_without_a_shuffle_and_equal_their_sql(spark, tmp_path):
    words = lambda n: " ".join(f"w{k}" for k in range(n))
    texts = [(k, words(n)) for k, n in enumerate((1, 40, 41, 54, 55, 80, 81, 135, 400))] + [(20, ""), (21, None), (22, " \t\n"), (23, "é — ü"), (None, words(60)), (-1, words(160)), (-1, words(160))]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    ours = catalog.QUERIES["pdf_columns"](spark, str(tmp_path))
    assert "Exchange" not in ours._jdf.queryExecution().executedPlan().toString()
    key = lambda r: tuple((x is None, x) for x in r)
    want = con.sql("SELECT doc_id, page, line_ord, text FROM (" + catalog.ORACLE_SQL["pdf_columns"] + ")").fetchall()
    assert sorted(map(tuple, ours.collect()), key=key) == sorted(want, key=key)


def _line(text, y, x1=100, x0=10, conf=90, word=20):
    box = {"x0": x0, "y0": y, "x1": x1, "y1": y + 10}
    return {"text": text, "confidence": conf, "bbox": box, "words": [{"text": text, "bbox": {**box, "x1": x0 + word}}]}


def _blocks(*groups):
    return [{"paragraphs": [{"lines": list(g)}]} for g in groups]


def test_recognised_paragraphs():
    got = recognition.build_paragraphs(_blocks([_line("one two", 0), _line("three", 12, 60)], [_line("| am here", 40, 98)], [_line("and on", 52, 50)], [_line("noise", 90, 60, conf=10)]))
    assert got == (["one two three", "I am here and on"], 1)
    assert recognition.build_paragraphs([]) == ([], 0)
    assert recognition.repair_strokes("a | b | c") == "a | b | c" and recognition.repair_strokes("(l've seen") == "(I've seen"
    assert recognition.median([3, 1, 2, 10]) == 2.5 and recognition.average([]) == 0


def test_paragraphs_of_a_table_of_lines(spark):
    rows = [(1, 0, 0, 0, " one two", 90.0, 10.0, 0.0, 100.0, 10.0, 20.0), (1, 0, 1, 0, "three", 70.0, 10.0, 12.0, 60.0, 22.0, 20.0), (1, 0, 2, 0, "?", 5.0, 10.0, 90.0, 60.0, 100.0, 20.0)]
    lines = spark.createDataFrame(rows, "doc_id long, page long, group_ord long, line_ord long, text string, confidence double, x0 double, y0 double, x1 double, y1 double, first_word_width double")
    r = ocr.paragraphs(lines).collect()[0]
    assert r.paragraphs == ["one two three"] and r.discarded == 1
    assert ocr.line_heights(lines).collect()[0].height == 10


def test_images():
    data = png.encode_png(2, 1, bytes(range(8)))
    assert image_format(data) == "png" and image_format(data[:11]) is None and image_format(b"GIF89a" + bytes(9)) == "gif" and image_format(b"\x89PNG" + bytes(12)) is None
    assert png.bilevel(9, 2, b"\xff") is None and image_format(png.bilevel(9, 2, bytes(4))) == "png"
    with pytest.raises(ValueError):
        png.encode_png(2, 2, b"\0" * 15)
    engine = lambda _: {"confidence": 65, "blocks": _blocks([_line("text", 0)])}
    got = read_image(data, lambda d, e: f"![[{e}]]", engine)
    assert got["markdown"] == "![[png]]\n\ntext" and len(got["warnings"]) == 1
    with pytest.raises(ValueError):
        read_image(data)


def _file(objects: list[bytes], tail: bytes = b"trailer << /Root 1 0 R >>") -> bytes:
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + tail


def _page(content: bytes, more: list[bytes] = (), resources: bytes = b"<< /Font << /F 3 0 R >> >>") -> bytes:
    head = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [4 0 R] /Count 1 /Resources " + resources + b" >>", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /Differences [65 /eacute /uni20AC /fi] >> >>"]
    return _file([*head, b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content), *more])


def test_pdf_text_positions():
    items = pdf.page_items(_page(rb"q 2 0 0 2 10 0 cm BT /F 10 Tf 5 50 Td (A\(B\051) Tj [(x) -500 (y)] TJ 12 TL T* <43> Tj ET Q"))[0]
    assert [(i.text, i.y, i.size) for i in items] == [("é(€)", 100.0, 20.0), ("x", 100.0, 20.0), ("y", 100.0, 20.0), ("fi", 76.0, 20.0)]
    assert items[0].x == 20.0 and items[2].x - items[1].x == pytest.approx(2 * (5 + 5))


def test_pdf_object_streams_and_filters():
    import zlib

    inner = b"1 0 2 40 << /Type /Catalog /Pages 2 0 R >>".ljust(48) + b"<< /Type /Pages /Kids [4 0 R] /Count 1 >>"
    first = inner.index(b"<<")
    body = zlib.compress(inner.replace(b"2 40", b"2 %d" % (inner.index(b"<< /Type /Pages") - first)))
    data = b"%%PDF-1.5\n9 0 obj\n<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (first, len(body), body)
    data += b"4 0 obj\n<< /Type /Page /Parent 2 0 R >>\nendobj\n8 0 obj\n<< /Type /XRef /Root 1 0 R /Length 0 >>\nstream\n\nendstream\nendobj"
    assert len(pdf_objects.Document(data).pages()) == 1
    rows = np.arange(12, dtype=np.uint8).reshape(3, 4)
    up = b"".join(b"\x02" + (r - (rows[k - 1] if k else 0)).astype(np.uint8).tobytes() for k, r in enumerate(rows))
    assert pdf_objects._unpredicted(up, {"Predictor": 12, "Columns": 4}) == rows.tobytes()
    assert pdf_objects._runs(b"\x01ab\xfec\x80") == b"abccc"
    assert pdf_objects._lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), 1) == b"-----A---B"


def test_pdf_pictures_scans_and_faults():
    pixels = bytes([200]) * (64 * 64)
    image = b"<< /Subtype /Image /Width 64 /Height 64 /BitsPerComponent 8 /ColorSpace /DeviceGray /Length %d >>\nstream\n%s\nendstream" % (len(pixels), pixels)
    resources = b"<< /Font << /F 3 0 R >> /XObject << /I 6 0 R >> >>"
    got = pdf.read_pdf(_page(b"BT /F 10 Tf 5 50 Td (some text) Tj ET /I Do", [image], resources), lambda d, e: f"![[{image_format(d)}]]")
    assert got["markdown"] == "some text\n\n![[png]]" and got["frontmatter"] == [("pages_converted", "1/1")]
    engine = lambda _: {"confidence": 80, "blocks": _blocks([_line("scanned", 0)])}
    got = pdf.read_pdf(_page(b"/I Do", [image], resources), engine=engine)
    assert got["markdown"] == "scanned" and dict(got["frontmatter"])["pages_read_by_ocr"] == "1"
    for data in (b"no", _page(b""), _file([b"<< /Type /Catalog >>"], b"trailer << /Root 1 0 R /Encrypt 2 0 R >>")):
        with pytest.raises(ValueError):
            pdf.read_pdf(data)
    assert pdf.list_pages([3]) == "page 3" and pdf.list_pages(list(range(1, 14))).endswith("12, …")


def test_character_maps():
    cmap = b"1 beginbfchar <0041> <00480069> endbfchar 2 beginbfrange <0001> <0003> <0061> <0005> <0006> [<0078> <0079>] endbfrange"
    assert pdf_fonts.to_unicode(cmap) == {b"\0A": "Hi", b"\0\1": "a", b"\0\2": "b", b"\0\3": "c", b"\0\5": "x", b"\0\6": "y"}
    assert [pdf_fonts.glyph_text(g) for g in ("Adieresis", "f_i", "u1F600", "nothere", "a.alt")] == ["Ä", "fi", "😀", "", "a"]
