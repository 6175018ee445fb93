"""Conversion of whole documents: formats, dispatch, limits, charsets, streams."""

import io
import zipfile

import pytest

from docmd.plans.convert import to_markdown
from docmd.session import discard
from docmd.sources import files
from docmd.sources.csvtext import parse

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(parts: dict[str, str]) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return data.getvalue()


def rels(*items: tuple[str, str, str]) -> str:
    inner = "".join(f'<Relationship Id="{i}" Type="{REL}/{kind}" Target="{t}"{" TargetMode=" + chr(34) + "External" + chr(34) if "://" in t else ""}/>' for i, kind, t in items)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'


CORE = '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> Budget\n2026 </dc:title><dc:creator>Ada</dc:creator></cp:coreProperties>'


def p(text: str, style: str = "", number: tuple[int, int] | None = None) -> str:
    own = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{number[1]}"/><w:numId w:val="{number[0]}"/></w:numPr>' if number else "")
    return f'<w:p><w:pPr>{own}</w:pPr><w:r><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'


NUMBERING = (
    f'<w:numbering {W}><w:abstractNum w:abstractNumId="0">' + "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="5"/><w:numFmt w:val="decimal"/></w:lvl>' for k in range(9)) + "</w:abstractNum>"
    + '<w:abstractNum w:abstractNumId="1">' + "".join(f'<w:lvl w:ilvl="{k}"><w:numFmt w:val="bullet"/></w:lvl>' for k in range(9)) + "</w:abstractNum>"
    + '<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="3"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="3"/></w:lvlOverride></w:num>'
    + '<w:num w:numId="4"><w:abstractNumId w:val="1"/></w:num></w:numbering>'
)


def docx(body: str, footnotes: str = "") -> bytes:
    return package({
        "_rels/.rels": rels(("a", "officeDocument", "word/document.xml")), "docProps/core.xml": CORE,
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": rels(("n", "numbering", "numbering.xml"), ("s", "styles", "styles.xml"), ("f", "footnotes", "footnotes.xml"), ("l", "hyperlink", "https://example.org/guide")),
        "word/numbering.xml": NUMBERING, "word/footnotes.xml": f"<w:footnotes {W}>{footnotes}</w:footnotes>",
        "word/styles.xml": f'<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr><w:lang w:val="en-GB"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:styleId="Heading2"><w:name w:val="heading 2"/></w:style><w:style w:styleId="Title"><w:name w:val="Title"/></w:style></w:styles>',
    })


LINK = '<w:hyperlink r:id="l"><w:r><w:t>our </w:t></w:r><w:r><w:t xml:space="preserve">oven log </w:t></w:r></w:hyperlink>'
DOCX = {
    "styles": (p("Oven manual", "Title") + p("Read this first.") + p("") + p("  ") + p("Heating up", "Heading2") + p("# It is hot."), "# Oven manual\n\nRead this first.\n\n## Heating up\n\n\\# It is hot.\n"),
    "bullets": (p("Should:") + p("a", "", (4, 0)) + p("# b", "", (4, 1)) + p("c", "", (4, 0)), "Should:\n\n- a\n    - \\# b\n- c\n"),
    "numbers": (
        p("Five", "", (1, 0)) + p("nested", "", (1, 1)) + p("Six", "", (1, 0)) + p("Between.") + p("Seven", "", (2, 0)) + p("Restart:") + p("Three", "", (3, 0)) + p("Four", "", (3, 0)),
        "5. Five\n    5. nested\n6. Six\n\nBetween.\n\n7. Seven\n\nRestart:\n\n3. Three\n4. Four\n",
    ),
    "sdt": (
        p("Before") + f"<w:sdt><w:sdtContent>{p('First')}{p('# Second')}{p('  ')}</w:sdtContent></w:sdt><w:sdt><w:sdtContent/></w:sdt>" + "<w:p><w:sdt><w:sdtContent><w:r><w:t>Inline</w:t></w:r></w:sdtContent></w:sdt></w:p>",
        "Before\n\nFirst\n\\# Second\n\nInline\n",
    ),
    "table": (f"<w:tbl><w:tr><w:tc>{p('Level')}</w:tc><w:tc>{p('Impact')}</w:tc></w:tr><w:tr><w:tc>{p('Low | Mod')}{p('two')}</w:tc></w:tr></w:tbl>", "| Level | Impact |\n| --- | --- |\n| Low \\| Mod two |  |\n"),
    "link": (f'<w:p><w:r><w:t xml:space="preserve">See </w:t></w:r>{LINK}<w:r><w:t>of Dough&lt;</w:t></w:r><w:r><w:t>Rye&gt;!</w:t></w:r></w:p>', "See [our oven log](https://example.org/guide) of Dough\\<Rye>!\n"),
    "footnote": ('<w:p><w:r><w:t>Order</w:t></w:r><w:r><w:footnoteReference w:id="2"/></w:r></w:p>' + p("Next."), "Order[^2]\n\nNext.\n\n[^2]: Often made.\n"),
}


def xlsx(*sheets: tuple[str, str, str]) -> bytes:
    M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="s{i}" state="{state}"/>' for i, (n, state, _) in enumerate(sheets))
    return package({
        "_rels/.rels": rels(("a", "officeDocument", "xl/workbook.xml")), "docProps/core.xml": CORE, "xl/workbook.xml": f"<workbook {M}><sheets>{book}</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": rels(*((f"s{i}", "worksheet", f"worksheets/s{i}.xml") for i in range(len(sheets))), ("x", "sharedStrings", "shared.xml"), ("y", "styles", "styles.xml")),
        "xl/shared.xml": f"<sst {M}><si><t>Item</t></si><si><r><t>Pri</t></r><r><t>ce</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {M}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="4"/><xf numFmtId="164"/><xf numFmtId="10"/></cellXfs></styleSheet>',
    } | {f"xl/worksheets/s{i}.xml": f"<worksheet {M}><sheetData>{rows}</sheetData></worksheet>" for i, (_, _, rows) in enumerate(sheets)})


def inline(ref: str, text: str) -> str:
    return f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'


XLSX = {
    "formats": (
        [("Sales", "visible", '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c>' + inline("C1", "Date") + "</row><row>" + inline("A2", "Tea") + '<c r="B2" s="1"><v>1234.5</v></c><c r="C2" s="2"><v>46304</v></c></row><row/><row>' + inline("A4", "Total") + '<c r="B4"><f>B2*2</f><v>2469</v></c><c r="C4" s="3"><v>0.125</v></c></row>')],
        "| Item | Price | Date |\n| --- | --- | --- |\n| Tea | 1,234.50 | 2026-10-09 |\n| Total | 2469 | 12.50% |\n",
    ),
    "sheets": ([("Q1", "visible", f"<row>{inline('A1', 'a')}</row>"), ("Empty", "visible", ""), ("Secret", "hidden", f"<row>{inline('A1', 'h')}</row>"), ("# Q2", "visible", f"<row>{inline('A1', 'b')}</row><row>{inline('C2', 'c')}</row>")], "# Q1\n\n| a |\n| --- |\n\n# \\# Q2\n\n| b |  |\n| --- | --- |\n|  | c |\n"),
    "cells": ([("S", "visible", f"<row>{inline('B1', 'a|b')}{inline('D1', 'two&#10;lines &lt;b&gt;bold&lt;/b&gt;, x&lt;5')}</row>")], "| a\\|b | two lines \\<b>bold\\</b>, x<5 |\n| --- | --- |\n"),
}
CSV = {
    ("name,age\nAnn,31\nBob,42\n", "a.csv"): "| name | age |\n| --- | --- |\n| Ann | 31 |\n| Bob | 42 |\n",
    ('item,note\r\n"a, b","say ""hi"""\r\n"multi\r\nline",x|y\r\n', "a.csv"): '| item | note |\n| --- | --- |\n| a, b | say "hi" |\n| multi line | x\\|y |\n',
    ('"Month", "1958", "1959"\n"JAN",  340,  360\n', "a.csv"): "| Month | 1958 | 1959 |\n| --- | --- | --- |\n| JAN | 340 | 360 |\n",
    ("Name;Preis\nKaffee;3,50\n", "a.csv"): "| Name | Preis |\n| --- | --- |\n| Kaffee | 3,50 |\n",
    ("a\tb\n1\t2\n", "a.tsv"): "| a | b |\n| --- | --- |\n| 1 | 2 |\n",
    ("a,b\n1\n\n1,2,3\n", "a.csv"): "| a | b |  |\n| --- | --- | --- |\n| 1 |\n| 1 | 2 | 3 |\n",
    ("h\n# not a heading\n<b>tag</b>\n", "a.csv"): "| h |\n| --- |\n| # not a heading |\n| \\<b>tag\\</b> |\n",
    ("h,i\nx\\|y,z\n", "a.csv"): "| h | i |\n| --- | --- |\n| x\\\\\\|y | z |\n",
    ("", "a.csv"): "", ("\n\n", "a.csv"): "", ("a\tb", "x.tsv"): "| a | b |\n| --- | --- |\n",
}


def convert(spark, rows, **options):
    """rows of (name, bytes or None, address) as (markdown, title, author, language, error) by position."""
    given = [(i, n, None if c is None else bytearray(c), None if c is None else len(c), u) for i, (n, c, u) in enumerate(rows)]
    df = spark.createDataFrame(given, "id int, name string, content binary, length long, source_uri string")
    out = {r.id: r for r in to_markdown(df, **options).collect()}
    return [out[i] for i in range(len(rows))]


def test_csv(spark):
    out = convert(spark, [(name, text.encode(), None) for text, name in CSV])
    assert [r.markdown for r in out] == list(CSV.values())


def test_hostile_csv():
    text = "," * 1_000_000 + "\n" + "x\n" * 200_000 + '"never closed'
    rows = parse(text)
    assert len(rows[0]) == 1_000_001 and rows[-1] == ["never closed"] and len(rows) == 200_002


def test_docx(spark):
    out = convert(spark, [("a.DOCX", docx(body, f'<w:footnote w:id="2">{p("Often made.")}</w:footnote>'), None) for body, _ in DOCX.values()])
    for name, r in zip(DOCX, out, strict=True):
        assert r.markdown == DOCX[name][1], name
        assert (r.title, r.author, r.language, r.error) == ("Budget 2026", "Ada", "en-GB", None)


def test_xlsx(spark):
    sparse = "".join(f"<row>{inline(_reference(r), 'x')}</row>" for r in range(1100))
    out = convert(spark, [("b.xlsx", xlsx(*sheets), None) for sheets, _ in XLSX.values()] + [("c.xlsx", xlsx(("S", "visible", sparse)), None)])
    assert [r.markdown for r in out[:-1]] == [x for _, x in XLSX.values()]
    assert out[0].title == "Budget 2026" and out[0].language is None
    assert out[-1].error.kind == "too_large" and "1100 rows and 1100 columns" in out[-1].error.message


def _reference(n: int) -> str:
    name, k = "", n + 1
    while k:
        k, rest = divmod(k - 1, 26)
        name = chr(65 + rest) + name
    return f"{name}{n + 1}"


def test_dispatch_limits_charsets(spark):
    out = convert(
        spark,
        [
            ("notes.TXT", "Café 5 €".encode("cp1252"), None), ("a.txt", "\ufeffGrüße".encode(), None), ("a.txt", b"\xff\xfe" + "Grüße".encode("utf-16-le"), None), ("a.txt", b"\xfe\xff" + "é".encode("utf-16-be"), None),
            ("a.pages", b"x", None), ("none", b"x", None), ("big.txt", b"x" * 11, None), ("ten.txt", b"x" * 10, None), ("page.html", b"<p>Hi <a href='x'>there</a></p>", "https://a.org/b/"),
            ("old.docx", bytes.fromhex("D0CF11E0") + b"xxxx", None), ("bad.xlsx", b"no zip", None), ("null.txt", None, None), (None, b"x", None), ("e.html", b"", None),
        ],
        limit=None,
    )
    assert [r.markdown for r in out[:4]] == ["Café 5 €\n", "Grüße\n", "Grüße\n", "é\n"]
    assert out[4].error.kind == out[5].error.kind == out[12].error.kind == "unsupported" and "csv, docx, htm, html" in out[4].error.message
    assert out[8].markdown == "Hi [there](https://a.org/b/x)\n"
    assert out[9].error.kind == "conversion" and "password" in out[9].error.message and out[10].error.kind == "conversion"
    assert out[11].markdown is None and out[11].error is None and out[13].markdown == ""
    limited = convert(spark, [("big.txt", b"x" * 11, None), ("ten.txt", b"x" * 10, None)], limit=10)
    assert limited[0].error.kind == "too_large" and limited[1].markdown == "x" * 10 + "\n"
    with pytest.raises(Exception, match="Unsupported"):
        convert(spark, [("a.pages", b"x", None)], mode="failfast")
    with pytest.raises(ValueError):
        files.refusal(None, None, 0)


def test_files_and_stream(spark, tmp_path):
    from docmd.streaming import ingest

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("# x")
    (source / "b.csv").write_text("a,b\n")
    batch = {r.name: r.markdown for r in to_markdown(files.scan(spark, str(source))).collect()}
    assert batch == {"a.txt": "\\# x\n", "b.csv": "| a | b |\n| --- | --- |\n"}
    ingest.convert(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    (source / "c.html").write_text("<p>c</p>")
    ingest.convert(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r.name: r.markdown for r in spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out")).collect()} == batch | {"c.html": "c\n"}


def pdf(pages: list[bytes], extra: str = "", info: str = "<< /Title (A \\(PDF\\)) /Author <FEFF00C90076> >>", packed: bool = True) -> bytes:
    """A file of pages with the given contents and two fonts."""
    import zlib

    objects = {1: f"<< /Type /Catalog /Pages 2 0 R /Lang (en) {extra} >>".encode(), 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", 4: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>", 5: info.encode()}
    kids = []
    for k, text in enumerate(pages):
        data = zlib.compress(text) if packed else text
        objects[10 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R >>".encode()
        objects[11 + 2 * k] = f"<< /Length {len(data)} {'/Filter /FlateDecode' if packed else ''} >>\nstream\n".encode() + data + b"\nendstream"
        kids.append(f"{10 + 2 * k} 0 R")
    objects[2] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(kids)}] /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>".encode()
    body = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in sorted(objects.items()))
    return body + b"trailer\n<< /Root 1 0 R /Info 5 0 R >>\n%%EOF"


def shown(*lines: tuple[float, float, str, int, str]) -> bytes:
    return b"BT " + b"".join(f"/{font} {size} Tf 1 0 0 1 {x} {y} Tm ({text}) Tj ".encode("cp1252") for x, y, text, size, font in lines) + b"ET"


def test_pdf(spark):
    body = "This is the body of the document with enough words in it"
    one = shown((72, 720, "The Title", 20, "F2"), (72, 680, body, 11, "F1"), (72, 666, "and a second line \\(caf\\351 \\200\\).", 11, "F1"), (72, 630, "1 Introduction", 14, "F2"), (72, 600, body + ".", 11, "F1"))
    two = b"BT /F1 11 Tf 72 720 Td 14 TL [(Split)-600(wo) 10 (rds)] TJ T* (next <b> line.) Tj ET"
    good = pdf([one, two])
    image = pdf([b"/Im Do"]).replace(b"/F2 4 0 R >>", b"/F2 4 0 R >> /XObject << /Im 30 0 R >>").replace(b"trailer", b"30 0 obj\n<< /Subtype /Image /Length 0 >>\nstream\n\nendstream\nendobj\ntrailer")
    encrypted = good.replace(b"/Info", b"/Encrypt 9 0 R /Info")
    out = convert(spark, [("a.pdf", good, None), ("b.PDF", good, None), ("scan.pdf", image, None), ("locked.pdf", encrypted, None), ("bad.pdf", b"nothing", None), ("cut.pdf", good[:700], None), ("plain.pdf", pdf([one], packed=False), None), ("none.pdf", None, None), ("empty.pdf", pdf([b""]), None)])
    text = f"# The Title\n\n{body}\nand a second line (café €).\n\n## 1 Introduction\n\n{body}.\n"
    assert out[0].markdown == out[1].markdown == text + "\nSplit words\nnext \\<b> line.\n"
    assert (out[0].title, out[0].author, out[0].language) == ("A (PDF)", "Év", "en") and out[6].markdown == text
    assert [r.error.kind for r in out[2:5]] == ["unsupported", "conversion", "conversion"] and "OCR" in out[2].error.message and "encrypted" in out[3].error.message
    assert out[5].error is not None or out[5].markdown is not None
    assert (out[7].markdown, out[7].error, out[8].markdown, out[8].error) == (None, None, "", None)


def test_pdf_links(spark):
    page = shown((72, 720, "See the guide for more than a few details of this", 10, "F1"))
    link = "<< /Subtype /Link /Rect [92 715 140 732] /A << /S /URI /URI (https://example.org/guide) >> >>"
    data = pdf([page]).replace(b"/Type /Page /Parent", f"/Annots [{link}] /Type /Page /Parent".encode())
    # every glyph is half its size wide: "See " is 20 points, "the guide" the next 45
    assert convert(spark, [("a.pdf", data, None)])[0].markdown == "See [the guide](https://example.org/guide) for more than a few details of this\n"


def test_clashing_names_and_repeated_files(spark):
    from pyspark.sql import functions as F

    rows = [("a.txt", "u", 3, b"rye", "m", "r", "k"), ("a.txt", "u", 3, b"rye", "m", "r", "k"), ("b.pdf", "u", 3, b"no pdf", "m", "r", "k"), ("b.pdf", "u", 3, b"no pdf", "m", "r", "k"), ("c.csv", "u", 3, None, "m", "r", "k")]
    docs = spark.createDataFrame(rows, "name string, source_uri string, length long, content binary, markdown string, r string, doc_id string").withColumn("_refusal", F.lit("kept")).withColumn("kept", F.lit(1))
    out = to_markdown(docs).collect()
    assert sorted(str(x.markdown) for x in out) == ["None", "None", "None", "rye\n", "rye\n"]
    assert all((x.r, x.doc_id, x["_refusal"], x.kept) == ("r", "k", "kept", 1) for x in out) and sum(x.error is not None for x in out) == 2


def test_numbers_beyond_any_date():
    from docmd.sources import xlsx

    assert xlsx.date_text(1e8, "yyyy-mm-dd", False) == "100000000" and xlsx.date_text(2_958_465, "yyyy-mm-dd", False) == "9999-12-31"
    assert xlsx.date_text(float("inf"), "yyyy", False) == xlsx.general(float("inf")) == xlsx.number_text(float("inf"), "0.00") == "inf"
    assert xlsx.general(float("nan")) == xlsx.number_text(float("nan"), "0%") == "nan"
    for from_1904 in (False, True):
        assert xlsx.date_text(xlsx.MAX_SERIAL - 1 - xlsx.LATER * from_1904, "yyyy", from_1904) == "9999"


@pytest.mark.parametrize(("v", "code", "shown"), [
    (1234.5, "#,##0.00", "1,234.50"), (0.125, "0.00%", "12.50%"), (-5, "0;(0)", "(5)"), (1.5, "# ?/?", "1 1/2"), (0.3333, "# ?/?", "1/3"), (2, "# ?/?", "2"), (0, "# ?/?", "0"), (0.25, "?/4", "1/4"),
    (1.99, "# ?/4", "2"), (1234567, "#,##0,", "1,235"), (1234567, "0.0,,", "1.2"), (150, '[>100]"much" 0;[<0]"low" 0;0.0', "much 150"), (-3, '[>100]"much" 0;[<0]"low" 0;0.0', "-low 3"),
    (50, '[>100]"much" 0;[<0]"low" 0;0.0', "50.0"), (0, '0;-0;"none"', "none"), (5, "[Red]0.0", "5.0"), (5, "[$kr-414] 0.00", "kr 5.00"), (12345, "0.00E+00", "1.23E+04"), (0.5, ".00", ".50"),
    (-7, '0" kg"', "-7 kg"), (3, 'General" loaves"', "3 loaves"), (1234567.891, "#,##0.###", "1,234,567.891"), (5551234, "000-0000", "555-1234"), (4, r"\#0", "#4"), (0, "#", ""), (1.5, '"a;b" 0;0', "a;b 2"),
])
def test_number_formats(v, code, shown):
    from docmd.sources import xlsx

    assert xlsx.number_text(v, code) == shown


def test_styles_numbers_and_notes_of_word_files(spark):
    note = lambda k, body: f'<w:footnote w:id="{k}">{body}</w:footnote>'
    ref = lambda k: f'<w:p><w:r><w:t>Flour</w:t></w:r><w:r><w:footnoteReference w:id="{k}"/></w:r></w:p>'
    notes = note(2, "<w:p/>") + note(3, p("Sifted.") + ref(4) + f"<w:p>{LINK}</w:p>") + note(4, p("Never shown."))
    # a style's name decides on titles; an unknown style is its own name
    body = p("Loaves", "Title") + p("Rolls", "title") + p("Crusts", "heading 3") + ref(2) + ref(3) + ref(9)
    out = convert(spark, [("a.docx", docx(body, notes), None)])[0].markdown
    assert out == "# Loaves\n\n# Rolls\n\n### Crusts\n\nFlour[^2]\n\nFlour[^3]\n\nFlour[^9]\n\n[^2]:\n\n[^3]: Sifted. Flour our oven log\n"
    # an instance's override counts at its first item, whatever its level
    items = p("a", "", (3, 1)) + p("b", "", (3, 0)) + p("c", "", (3, 0))
    assert convert(spark, [("a.docx", docx(items), None)])[0].markdown.split("\n")[1].startswith("5. b")


def test_scan_reads_no_content_beyond_the_limit(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"rye")
    (tmp_path / "b.txt").write_bytes(b"x" * 50)
    rows = {r.name: (r.length, r.content) for r in files.scan(spark, str(tmp_path), limit=10).collect()}
    assert rows == {"a.txt": (3, bytearray(b"rye")), "b.txt": (50, None)}
    out = {r.name: (r.markdown, r.error and r.error.kind) for r in to_markdown(files.scan(spark, str(tmp_path), limit=10), limit=10, pdf=False).collect()}
    assert out == {"a.txt": ("rye\n", None), "b.txt": (None, "too_large")}


def test_words_of_a_language_for_pdf_files(spark):
    page = shown((72, 700, "We like autom-", 10, "F1"), (72, 688, "atic ovens.", 10, "F1"))
    docs = spark.createDataFrame([("a.pdf", None, 1, pdf([page]))], "name string, source_uri string, length long, content binary")
    words = spark.createDataFrame([("automatic",)], "word string")
    assert [to_markdown(docs, words=w).first().markdown for w in (None, words)] == ["We like autom-atic\novens.\n", "We like automatic\novens.\n"]


def test_contents_are_read_once_and_results_deleted(spark, tmp_path):
    import os

    (tmp_path / "a.pdf").write_bytes(pdf([shown((72, 700, "rye", 10, "F1"))]))
    (tmp_path / "b.txt").write_bytes(b"oat")
    out = to_markdown(files.scan(spark, str(tmp_path)))
    assert str(tmp_path) not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.name: r.markdown for r in out.collect()} == {"a.pdf": "rye\n", "b.txt": "oat\n"}
    (folder,) = (x.removeprefix("file://") for x in out.scratch)
    assert os.path.isdir(folder)
    discard(out)
    assert not os.path.exists(folder)
    discard(to_markdown(files.scan(spark, str(tmp_path)), pdf=False))


def test_more_extensions(spark, monkeypatch):
    monkeypatch.setattr(files, "FORMATS", dict(files.FORMATS))
    files.register(".LOG", "txt")
    files.register("log", "txt")
    with pytest.raises(ValueError, match="two formats"):
        files.register("log", "csv")
    with pytest.raises(ValueError, match="no reader"):
        files.register("md", "markdown")
    docs = spark.createDataFrame([("a.log", None, 3, b"# a"), ("b.docx", None, 3, b"x y"), ("c.xlsx", None, 3, b"x y")], "name string, source_uri string, length long, content binary")
    out = {r.name: (r.markdown, r.error and r.error.message) for r in to_markdown(docs, pdf=False).collect()}
    assert out == {"a.log": ("\\# a\n", None), "b.docx": (None, "Cannot read the DOCX file: b.docx"), "c.xlsx": (None, "Cannot read the XLSX file: c.xlsx")}
