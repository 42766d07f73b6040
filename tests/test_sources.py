import io
import zipfile

from quire.sources import files, html

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body>
<h1>Title &amp; more</h1><p>Hello <b>wor</b>ld<br>again<!-- not this --></p>
<div>Notice</div><div>skip <p>kept</p></div><ul><li>one</li><li>two <em>x</em></li></ul>
<table><tr><th>a</th><td>b
c</td></tr><tr><td>1</td></tr></table><script>var x;</script><h5>deep</h5><p> </p><img src="a.png">
<p>open<p>nested</body></html>"""


def test_html_blocks():
    got = [(t, k, lv, x) for t, k, lv, x, _ in html.elements(PAGE)]
    assert got[:7] == [("h1", "heading", 1, "Title & more"), ("p", "paragraph", None, "Hello world again"), ("div", "paragraph", None, "Notice"), ("p", "paragraph", None, "kept"), ("li", "paragraph", None, "one"), ("li", "paragraph", None, "two x"), ("table", "table", None, None)]
    assert got[7:] == [("h5", "heading", 3, "deep"), ("p", "paragraph", None, "opennested")]
    assert [r[4] for r in html.elements(PAGE) if r[4]] == [[["a", "b c"], ["1"]]]
    assert html.elements("") == [] and html.elements("plain") == [] and html.elements("</p></div>") == []
    assert html.elements("<div>" * 3000 + "deep") == [("div", "paragraph", None, "deep", None)]


def test_read_html(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id int, html string")
    got = html.read_html(df, ["id"], "html").collect()
    assert {r.id for r in got} == {1} and [r.seq for r in got] == list(range(1, 10))
    t = {r.id: (r.has_table, r.image_count, r.loop_size) for r in html.triage(df, "html").collect()}
    assert t[1] == (True, 1, "tight") and t[3] == (False, 0, "loose")


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="{}"/></Relationships>'


def docx():
    para = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = para("Front") + para("One", "H1") + para("text") + "<w:tbl><w:tr><w:tc>" + para("a") + "</w:tc><w:tc>" + para("b") + "</w:tc></w:tr></w:tbl>" + para("Two", "H1") + para("Deep", "H5") + para(" ") + f'<w:p><w:r><a:blip {A} r:embed="r1"/></w:r></w:p>'
    styles = "".join(f'<w:style w:styleId="H{n}"><w:name w:val="heading {n}"/></w:style>' for n in (1, 5))
    return packed(**{"word/document.xml": f"<w:document {W} {R}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {W}>{styles}</w:styles>", "word/_rels/document.xml.rels": RELS.format("media/image1.png")})


def xlsx():
    sheet = '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2"><v>3</v></c></row><row r="4"><c r="C4"><v>2.50</v></c><c r="D4" t="b"><v>1</v></c></row>'
    return packed(**{"xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="Data" sheetId="1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": RELS.format("worksheets/sheet1.xml"), "xl/sharedStrings.xml": f"<sst {S}><si><t>na</t><t>me</t></si></sst>", "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>{sheet}</sheetData></worksheet>"})


def pptx():
    shape = lambda t, y, ph="": f'<p:sp><p:nvSpPr><p:cNvPr id="1"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    body = shape("low", 900) + shape("high", 100) + shape("The title", 500, '<p:ph type="title"/>') + shape("7", 0, '<p:ph type="sldNum"/>')
    return packed(**{"ppt/slides/slide1.xml": f"<p:sld {P} {A} {R}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>", "ppt/slides/slide10.xml": f"<p:sld {P} {A}/>"})


def test_office_readers():
    got = [(r[0], r[2], r[3], r[4], r[5], r[6]) for r in files.read_file("docx", docx())]
    assert got == [(1, "paragraph", None, "Front", None, None), (2, "heading", 1, "One", None, None), (2, "paragraph", None, "text", None, None), (2, "table", None, None, [["a", "b"]], None), (3, "heading", 1, "Two", None, None), (3, "heading", 3, "Deep", None, None), (3, "image", None, None, None, "media/image1.png")]
    assert [(r[2], r[4], r[5]) for r in files.read_file("xlsx", xlsx())] == [("heading", "Data", None), ("table", None, [["name", "3", ""], ["", "", ""], ["", "2.5", "True"]])]
    assert [(r[0], r[2], r[4]) for r in files.read_file("pptx", pptx())] == [(1, "heading", "The title"), (1, "paragraph", "high"), (1, "paragraph", "low")]
    assert files.read_file("docx", files.OLE + b"x")[0][-1].startswith("encrypted")
    assert files.read_file("xlsx", b"junk")[0][-1].startswith("unreadable")
    assert files.read_file("pdf", b"%PDF")[0][-1] == "no reader for pdf"


def test_folder_of_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx())
    (tmp_path / "a.HTML").write_text("<p>other</p>")
    (tmp_path / "b.htm").write_text(PAGE)
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "d.xlsx").write_bytes(b"broken")
    found = files.document_files(spark, str(tmp_path))
    assert sorted((r.doc, r.format) for r in found.collect()) == [("a", "docx"), ("b", "html"), ("d", "xlsx")]
    rows = files.read_documents(found).collect()
    assert {r.doc for r in rows if r.reason} == {"d"}
    assert sum(r.doc == "a" for r in rows) == 7 and sum(r.doc == "b" for r in rows) == 9


def test_html_images(spark):
    page = """<img src="a/b%20c.png?x=1"><p><img><img src=" data:image/gif;base64,R0lGOA== "><img src="data:image/svg+xml,<svg/>"><img src="http://x.example/a.png">
      <img src="//x.example/a.png"><img src="../out.png"><img src="/etc/a.png"><img src="a/../d"><img src="data:;base64,AAAA"><img src="data:image/png;base64,R0lGOD"><img src="http://[">"""
    got = [(r.place, r.ext, r.path, r.content and bytes(r.content)) for r in html.html_images(spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string"), ["id"], "html").collect()]
    assert got == [(1, "png", "a/b c.png", None), (3, "gif", None, b"GIF8"), (9, "png", "d", None), (10, "png", None, b"\0\0\0")]
    files = spark.createDataFrame([(1, "d", b"x"), (2, "a/b c.png", b"y")], "id int, path string, content binary")
    kept = html.with_contents(html.html_images(spark.createDataFrame([(1, page)], "id int, html string"), ["id"], "html"), ["id"], files).collect()
    assert sorted((r.place, bytes(r.content)) for r in kept) == [(3, b"GIF8"), (9, b"x"), (10, b"\0\0\0")]
