"""Office files made here, and their Markdown."""

import io
import zipfile

from quillmill.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="urn:p"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def made(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x"), text)
    return out.getvalue()


def test_office_files(spark):
    p = lambda t, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={style!r}/></w:pPr>' if style else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    document = f"<w:document {W}><w:body>{p('A title', 'Heading1')}{p('One &amp; two')}<w:tbl>{row('k', 'v')}{row('a|b', '1')}</w:tbl>{p('')}{p('End')}</w:body></w:document>"
    cell = lambda at, v, t="": f"<c r={at!r} t={t!r}><v>{v}</v></c>"
    sheet = f"<worksheet {S}><sheetData><row>{cell('A1', 1, 's')}{cell('B1', 0, 's')}</row><row>{cell('B3', 2.5)}{cell('AA3', 1, 'b')}</row></sheetData></worksheet>"
    book = f'<workbook {S}><sheets><sheet name="Sums"/></sheets></workbook>'
    slide = lambda *t: f"<p:sld {A}>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in t) + "</p:sld>"
    epub = io.BytesIO()
    with zipfile.ZipFile(epub, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package><manifest><item id="b" href="2.html"/><item id="a" href="t/1.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("o/t/1.html", "<h1>First</h1><p>Some words of the first chapter, as they are.</p>")
        z.writestr("o/2.html", "<p>Some words of the second chapter, as they are.</p>")
    files = {
        "a.docx": made(word__document_xml=document), "b.xlsx": made(xl__workbook_xml=book, xl__sharedStrings_xml=f"<sst {S}><si><t>name</t></si><si><t>i</t><t>d</t></si></sst>", xl__worksheets__sheet1_xml=sheet),
        "c.pptx": made(ppt__slides__slide10_xml=slide("last"), ppt__slides__slide2_xml=slide("first", "more")), "d.epub": epub.getvalue(), "e.docx": b"no archive", "f.pdf": b"%PDF", "g.docx": made(word__document_xml="<!DOCTYPE x><x/>"), "h.xlsx": made(xl__workbook_xml=book),
    }
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    got = {r.path: (r.text, r.reason) for r in office.to_markdown(df).collect()}
    assert got["a.docx"] == ("# A title\nOne & two\n| k | v |\n| --- | --- |\n| a\\|b | 1 |\nEnd", None)
    lines = got["b.xlsx"][0].split("\n")
    assert lines[0] == "## Sums" and len(lines) == 4
    table = [x.strip("|").split("|") for x in (lines[1], lines[3])]
    assert [[c.strip() for c in r] for r in table] == [["id", "name", *[""] * 25], ["", "2.5", *[""] * 24, "TRUE"]]
    assert got["c.pptx"] == ("## Slide 1\nfirst\nmore\n## Slide 2\nlast", None)
    assert got["d.epub"][0] == "First\nSome words of the first chapter, as they are.\nSome words of the second chapter, as they are."
    assert got["h.xlsx"] == ("", None) and all(got[x][0] is None and got[x][1] for x in ("e.docx", "f.pdf", "g.docx"))
    assert office.to_markdown(df.limit(0)).count() == 0
