import io
import zipfile

from quire.sources import book, sheets, slides, word

W = 'xmlns:w="w" xmlns:r="r"'


def packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_word():
    body = '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="3"/></w:numPr></w:pPr><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/><w:i/></w:rPr><w:t>x </w:t></w:r><w:hyperlink r:id="a"><w:r><w:t>l</w:t></w:r></w:hyperlink></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c|</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    rels = '<R><Relationship Id="a" Type="x/hyperlink" Target="http://e" TargetMode="External"/></R>'
    got = word.read_docx(packed({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": rels}))
    assert got["markdown"] == "## Head\n\n- one\n\n***x*** [l](http://e)\n\n| c\\| |\n| --- |"


def test_slides():
    shapes = '<p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>T</a:t></a:r></a:p></p:txBody></p:sp><p:grpSp><p:sp><p:txBody><a:p><a:r><a:t>u</a:t></a:r></a:p><a:p><a:pPr lvl="1"/><a:r><a:rPr b="1"/><a:t>v</a:t></a:r></a:p></p:txBody></p:sp></p:grpSp>'
    parts = {"ppt/presentation.xml": '<p:p xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId id="1" r:id="b"/></p:sldIdLst></p:p>', "ppt/_rels/presentation.xml.rels": '<R><Relationship Id="b" Type="x/slide" Target="slides/s2.xml"/></R>', "ppt/slides/s2.xml": f'<p:s xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:s>'}
    assert slides.read_pptx(packed(parts))["markdown"] == "## Slide 1: T\n\n- u\n  - **v**"


def test_sheets():
    parts = {
        "xl/workbook.xml": '<w xmlns:r="r"><sheets><sheet name="A" r:id="1"/><sheet name="My B" state="hidden" r:id="2"/><sheet name="C" state="hidden" r:id="3"/></sheets></w>',
        "xl/_rels/workbook.xml.rels": "<R>" + "".join(f'<Relationship Id="{k}" Type="x/worksheet" Target="worksheets/s{k}.xml"/>' for k in (1, 2, 3)) + "</R>",
        "xl/sharedStrings.xml": "<sst><si><r><t>a</t></r><r><t>b*</t></r><rPh><t>zz</t></rPh></si></sst>",
        "xl/styles.xml": '<s><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="10"/></cellXfs></s>',
        "xl/worksheets/s1.xml": "<w><sheetData><row><c r=\"B1\" t=\"s\"><v>0</v></c><c r=\"C1\" s=\"1\"><v>45000.5</v></c></row><row/><row><c s=\"2\"><f>'My B'!A1</f><v>0.125</v></c></row></sheetData></w>",
        "xl/worksheets/s2.xml": '<w><sheetData><row><c s="0"><v>0.1234567890123</v></c></row></sheetData></w>',
    }
    got = sheets.read_xlsx(packed(parts))
    assert got["markdown"] == "## A\n\n|  | ab\\* | 2023-03-15 12:00:00 |\n| --- | --- | --- |\n| 12.50% |  |  |\n\n## My B\n\n| 0.12345678901 |\n| --- |"
    assert got["frontmatter"] == [("sheets_converted", "2/3")] and any("C" in w for w in got["warnings"])


def test_numbers():
    assert [sheets.format_number(x, ("number", None)) for x in (1e21, 1e-7, 3.0, -0.0)] == ["1e+21", "1e-7", "3", "0"]
    assert sheets.format_number(2.5, ("number", 0)) == "3" and sheets.format_number(-0.0, ("number", 2)) == "0.00"
    assert sheets.iso_date(0) is None and sheets.column_index("AB7") == 27 and sheets.references("'x''y'!A1+B:C!Z") == {"x'y", "b", "c"}
    assert [sheets.interpret(170, c)[0] for c in ("[h]:mm", "[Red]0.0", '0"day"', "0%")] == ["date", "number", "number", "percent"]


def test_book():
    parts = {
        "META-INF/container.xml": '<c><rootfiles><rootfile full-path="o/b.opf"/></rootfiles></c>',
        "o/b.opf": '<p xmlns:dc="d"><metadata><dc:title>Bk</dc:title></metadata><manifest><item id="2" href="two.xhtml" media-type="application/xhtml+xml"/><item id="1" href="one.xhtml" media-type="application/xhtml+xml"/><item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="1"/><itemref idref="2"/></spine></p>',
        "o/t.ncx": '<n><navMap><navPoint><navLabel><text>First</text></navLabel><content src="one.xhtml#x"/></navPoint></navMap></n>',
        "o/one.xhtml": '<html><body><p>a <a href="two.xhtml">b</a></p><svg><image xlink:href="i.png"/></svg></body></html>',
        "o/two.xhtml": "<html><body><h2>Own</h2></body></html>",
        "o/i.png": "png",
    }
    got = book.read_epub(packed(parts), lambda data, ext: f"![[{ext}]]")
    assert got["markdown"] == "# First\n\na b\n\n![[png]]\n\n## Own"
    assert got["frontmatter"] == [("title", "Bk"), ("chapters_converted", "2/2")]
