"""DOCX, XLSX and PDF files made of a table's columns, for queries that read them back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_M = f'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{_OFFICE}"'


def text(*parts: Column | str) -> Column:
    """parts, columns or fixed text, as one text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def cents(number: Column) -> Column:
    """A double with two decimals, rounded from its exact binary value, ties to even; what rounds to zero keeps its sign."""
    return F.translate(F.format_number(number, 2), ",", "")


def _relations(*targets: tuple[str, str]) -> str:
    return f'<Relationships xmlns="{_RELATIONS}">' + "".join(f'<Relationship Id="r{k}" Type="{_OFFICE}/{kind}" Target="{target}"/>' for k, (kind, target) in enumerate(targets)) + "</Relationships>"


def _package(varying: str, fixed: dict[str, str]):
    """An Arrow function from the text of the part `varying` to a zip package."""

    def run(parts: pa.Array) -> pa.Array:
        import io
        import zipfile

        out = []
        for part in parts:
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                for name, own in {**fixed, varying: part.as_py() or ""}.items():
                    z.writestr(zipfile.ZipInfo(name), own)
            out.append(data.getvalue())
        return pa.array(out, pa.binary())

    run.__annotations__ = {"parts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")


def docx(body: Column) -> Column:
    """A document of body; its style H is a heading of the first level, its list 1 counts from 3."""
    styles = f'<w:styles {_W}><w:style w:type="paragraph" w:styleId="H"><w:name w:val="heading 1"/></w:style></w:styles>'
    level = '<w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="decimal"/></w:lvl>'
    numbering = f'<w:numbering {_W}><w:abstractNum w:abstractNumId="0">{level}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
    fixed = {
        "_rels/.rels": _relations(("officeDocument", "word/document.xml")), "word/_rels/document.xml.rels": _relations(("styles", "styles.xml"), ("numbering", "numbering.xml")),
        "word/styles.xml": styles, "word/numbering.xml": numbering,
    }
    return _package("word/document.xml", fixed)(text(f"<w:document {_W}><w:body>", body, "</w:body></w:document>"))


def paragraph(shown: Column, properties: str = "") -> Column:
    return text(f'<w:p><w:pPr>{properties}</w:pPr><w:r><w:t xml:space="preserve">', shown, "</w:t></w:r></w:p>")


def xlsx(rows: Column) -> Column:
    """A workbook of one sheet; its cell styles are plain, 1,234.00, a date, and 12.00%."""
    styles = f'<styleSheet {_M}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="4"/><xf numFmtId="164"/><xf numFmtId="10"/></cellXfs></styleSheet>'
    fixed = {
        "_rels/.rels": _relations(("officeDocument", "xl/workbook.xml")), "xl/workbook.xml": f'<workbook {_M}><sheets><sheet name="S" sheetId="1" r:id="r0"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _relations(("worksheet", "sheet.xml"), ("styles", "styles.xml")), "xl/styles.xml": styles,
    }
    return _package("xl/sheet.xml", fixed)(text(f"<worksheet {_M}><sheetData>", rows, "</sheetData></worksheet>"))


def pdf(content: Column, tree: Column | str = "", *more: Column) -> Column:
    """A file of a page's content and the elements of its structure tree, and of more pages; the pages are objects 4, 6, ...,
    the fonts F1 and F2 are plain and bold."""
    head = "%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R /Lang (en) /StructTreeRoot << /K ["
    fonts = "".join(f"/F{k} << /Type /Font /Subtype /Type1 /BaseFont /Helvetica{style} >> " for k, style in ((1, ""), (2, "-Bold")))
    kids = " ".join(f"{4 + 2 * k} 0 R" for k in range(1 + len(more)))
    pages = f"] >> >>\nendobj\n2 0 obj\n<< /Type /Pages /Count {1 + len(more)} /Kids [{kids}] /MediaBox [0 0 612 792] /Resources << /Font << {fonts}>> >> >>\nendobj\n"
    page = lambda k, own: text(f"{4 + 2 * k} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {5 + 2 * k} 0 R >>\nendobj\n{5 + 2 * k} 0 obj\n<< /Length ", F.octet_length(own), " >>\nstream\n", own, "\nendstream\nendobj\n")
    whole = text(head, tree if isinstance(tree, Column) else F.lit(tree), pages, *(page(k, own) for k, own in enumerate((content, *more))), "trailer\n<< /Root 1 0 R >>\n%%EOF")
    return F.encode(whole, "ISO-8859-1")


def shown(x: float, y: float, what: Column | str, size: int = 10, font: str = "F1", mark: int | None = None) -> Column:
    """Content that shows a text without brackets, marked where mark is given."""
    own = text(f"BT /{font} {size} Tf 1 0 0 1 {x} {y} Tm (", what, ") Tj ET ")
    return own if mark is None else text(f"/P << /MCID {mark} >> BDC ", own, "EMC ")


def rules(xs: tuple[float, ...], ys: tuple[float, ...]) -> str:
    """Content that paints a grid's rules."""
    return "".join(f"{xs[0]} {y} m {xs[-1]} {y} l S " for y in ys) + "".join(f"{x} {ys[0]} m {x} {ys[-1]} l S " for x in xs)
