"""The registered queries of the document operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmd import officefiles as O
from docmd.functions import markdown as M
from docmd.operators import layout as L
from docmd.plans.convert import csv_markdown, csv_records, to_markdown
from docmd.session import spread
from docmd.sources import files

# DuckDB forms of the column functions: RE2 has no lookahead and no back references
_TAGS = r"regexp_replace({x}, '(\\*)<([A-Za-z/!?])', '\1\1\\<\2', 'g')"
_RULE = r"^\s*(?:-(?:\s*-)*|=(?:\s*=)*|\*(?:\s*\*){2,}|_(?:\s*_){2,}|\*)\s*$"
_ESCAPE = r"CASE WHEN regexp_matches({x}, '" + _RULE + r"') THEN regexp_replace({x}, '^(\s*)', '\1\\') ELSE regexp_replace({x}, '^(\s*)(#|>|```|~~~)', '\1\\\2') END"
_WS = r"[\t\x0B\f\x1C-\x1F \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"


def _normalize_sql(x: str) -> str:
    one = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    two = rf"regexp_replace({one}, '{_WS}+(\n|\z)', '\1', 'g')"
    three = rf"regexp_replace({two}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({three}, '\A\n+|\n+\z', '', 'g')"


def _finished_sql(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN '' ELSE {x} || chr(10) END"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txt_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", M.render_txt(F.col("text")).alias("markdown"))


_TXT = rf"""
WITH l AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: {_TAGS.replace("{x}", "x")}) AS ls FROM documents),
e AS (SELECT doc_id, array_to_string(list_transform(ls, lambda x: {_ESCAPE.replace("{x}", "x")}), chr(10)) AS t FROM l),
n AS (SELECT doc_id, {_normalize_sql("t")} AS t FROM e)
SELECT doc_id, {_finished_sql("t")} AS markdown FROM n
"""


def escaped_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", M.escape_tags(F.col("html")).alias("escaped"))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", M.table_cell(F.translate("text", "e", "|")).alias("cell"))


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", M.normalize(F.translate("text", "xyq", "\r\n\t")).alias("markdown"))


def clean_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", M.clean(F.concat(F.lit(" \n"), F.col("text"))).alias("title"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit(" page ["), F.col("page_id").cast("string"), F.lit("] "))
    return _table(spark, sf_dir, "pages").select("page_id", M.link(label, F.col("url")).alias("link"), M.link(F.col("url"), F.col("url")).alias("own"))


def csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    text = F.concat(F.lit('key;name;"the ""segment"""\r\n'), c("c_custkey").cast("string"), F.lit(';  "'), c("c_name"), F.lit('\n"x;'), c("c_mktsegment"), F.lit("|"))
    return _table(spark, sf_dir, "customer").select("c_custkey", csv_markdown(csv_records(text)).alias("markdown"))


_CSV = """
SELECT c_custkey, '| key | name | the "segment" |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || c_custkey || ' | ' || c_name || ' x | ' || c_mktsegment || '\\| |' || chr(10) AS markdown FROM customer
"""


def html_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    docs = files.from_table(spread(pages.select("page_id", "url", "html")), F.col("html"), F.lit("page.html"), F.col("url"))
    return to_markdown(docs, pdf=False).select("page_id", "title", "author", "language")


# Character references, which may lack their semicolon at the end of a text that was cut
_REFERENCES = (("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&"))
_TEXT = "{x}"
for _name, _shown in _REFERENCES:
    _TEXT = f"regexp_replace({_TEXT}, '&{_name};?', '{_shown}', 'g')"

_HTML = rf"""
WITH t AS (SELECT page_id, nullif(trim(regexp_replace({_TEXT.replace("{x}", "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '\s+', ' ', 'g')), '') AS title,
nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS language FROM pages)
SELECT page_id, title, CAST(NULL AS VARCHAR) AS author, language FROM t
"""


def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as Markdown: the flagship query."""
    pages = _table(spark, sf_dir, "pages")
    return to_markdown(files.from_table(spread(pages.select("page_id", "url", "html")), F.col("html"), F.lit("page.html"), F.col("url")), pdf=False).select("page_id", "markdown", "title", "language")


# Pages are navigation, a note, an article of a heading and paragraphs, and a footer: all but the article and the note goes
# by the rules for page furniture. Blanks are one space, a `br` is a line end, and what is left is escaped.
_BLOCK = "</?(?:p|div|article|h1)(?: [^>]*)?>"
_HTML_MARKDOWN = rf"""
WITH b AS (SELECT page_id, regexp_extract(html, '(?s)<body>(.*?)(?:</body>|\z)', 1) AS body FROM pages),
r AS (SELECT page_id, regexp_replace(regexp_replace(body, '(?s)<!--.*?-->', '', 'g'), '(?s)<(?:nav|footer)\b.*?(?:</(?:nav|footer)>|\z)', '', 'g') AS body FROM b),
a AS (SELECT page_id, string_split(regexp_replace(body, '{_BLOCK}', chr(1) || '\0', 'g'), chr(1)) AS ts FROM r),
s AS (SELECT page_id, unnest(ts) AS t, unnest(range(len(ts))) AS n FROM a),
l AS (SELECT page_id, n, starts_with(t, '<h1') AS head, string_split(regexp_replace(regexp_replace(regexp_replace(t, '^{_BLOCK}', ''), '</?b>', '', 'g'), '[ \t\n\r\f]+', ' ', 'g'), '<br>') AS ls FROM s),
u AS (SELECT page_id, n, head, list_transform(ls, lambda x: trim({_TEXT.replace("{x}", "x")})) AS ls FROM l),
e AS (SELECT page_id, n, head, list_transform(ls, lambda x: {_TAGS.replace("{x}", "x")}) AS ls FROM u WHERE array_to_string(ls, '') <> ''),
m AS (SELECT page_id, n, CASE WHEN head THEN '# ' || array_to_string(ls, ' ') ELSE trim(array_to_string(list_transform(ls, lambda x: {_ESCAPE.replace("{x}", "x")}), chr(10)), chr(10)) END AS t FROM e),
d AS (SELECT page_id, {_normalize_sql("string_agg(t, chr(10) || chr(10) ORDER BY n)")} AS t FROM m GROUP BY 1),
h AS ({_HTML})
SELECT page_id, {_finished_sql("t")} AS markdown, title, language FROM h LEFT JOIN d USING (page_id)
"""


def format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of several extensions, a size limit, and the error of each document that is not read."""
    name = F.concat(F.lit("a.b/"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (".TXT", ".csv", ".htm", ".pages", ".", "", ".Xlsx"))), (F.col("doc_id") % 7 + 1).cast("int")))
    docs = _table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), F.octet_length("text").cast("long").alias("length"))
    return docs.select("doc_id", files.extension(F.col("name")).alias("extension"), files.format_of(F.col("name")).alias("format"), files.refusal(F.col("name"), F.col("length"), 1500)["kind"].alias("error"))


_DISPATCH = """
WITH d AS (SELECT doc_id, octet_length(encode(text)) AS length, ['txt', 'csv', 'htm', 'pages', '', 'b/' || doc_id, 'xlsx'][doc_id % 7 + 1] AS extension FROM documents),
f AS (SELECT *, CASE extension WHEN 'txt' THEN 'txt' WHEN 'csv' THEN 'csv' WHEN 'htm' THEN 'html' WHEN 'xlsx' THEN 'xlsx' END AS format FROM d)
SELECT doc_id, extension, format, CASE WHEN format IS NULL THEN 'unsupported' WHEN length > 1500 THEN 'too_large' END AS error FROM f
"""


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in several encodings, decoded again."""
    t = F.col("text")
    data = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(b"\xff\xfe"), F.encode(t, "UTF-16LE"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit(b"\xfe\xff"), F.encode(t, "UTF-16BE")))
    data = data.when(F.col("doc_id") % 4 == 2, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode(t, "UTF-8"))).otherwise(F.encode(t, "UTF-8"))
    return _table(spark, sf_dir, "documents").select("doc_id", files.decode(data).alias("text"))


#: Small files that a task makes and reads at most.
FILES_PER_TASK = 5_000


def _converted(rows: DataFrame, key: str, name: str, content: Column) -> DataFrame:
    docs = spread(rows, FILES_PER_TASK).select(key, F.lit(name).alias("name"), F.lit(None).cast("string").alias("source_uri"), content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    return to_markdown(docs, pdf=name.endswith("pdf")).select(key, "markdown")


def docx_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as Word documents, read back: a heading, a numbered list, a table."""
    c, p = F.col, O.paragraph
    item = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>'
    cell = lambda x: O.text("<w:tc>", p(x), "</w:tc>")
    row = lambda *xs: O.text("<w:tr>", *map(cell, xs), "</w:tr>")
    table = O.text("<w:tbl>", row(F.lit("Name"), F.lit("Segment | key")), row(c("c_name"), O.text(c("c_mktsegment"), " | ", c("c_custkey"))), "</w:tbl>")
    body = O.text(p(c("c_name"), '<w:pStyle w:val="H"/>'), p(O.text("In &lt;b&gt; ", c("c_mktsegment"))), p(c("c_custkey"), item), p(F.lit("# last"), item), table)
    return _converted(_table(spark, sf_dir, "customer"), "c_custkey", "a.docx", O.docx(body))


_DOCX = r"""
SELECT c_custkey, '# ' || c_name || chr(10) || chr(10) || 'In \<b> ' || c_mktsegment || chr(10) || chr(10) || '3. ' || c_custkey || chr(10) || '4. \# last' || chr(10) || chr(10)
|| '| Name | Segment \| key |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_name || ' | ' || c_mktsegment || ' \| ' || c_custkey || ' |' || chr(10) AS markdown FROM customer
"""


def xlsx_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as workbooks, read back: text, numbers, dates and shares as they are shown, without unused columns."""
    c = F.col
    string = lambda at, x: O.text(f'<c r="{at}" t="inlineStr"><is><t>', x, "</t></is></c>")
    number = lambda at, style, x: O.text(f'<c r="{at}" s="{style}"><v>', x, "</v></c>")
    share = (c("c_custkey") % 10_000 / 10_000).cast("decimal(6,4)")
    head = O.text(*(string(at, F.lit(x)) for at, x in (("A1", "Name"), ("B1", "Balance"), ("D1", "Since"), ("E1", "Share"))))
    row = O.text(string("A2", c("c_name")), number("B2", 1, O.cents(c("c_acctbal"))), number("D2", 2, 40_000 + c("c_custkey") % 1000), number("E2", 3, share))
    return _converted(_table(spark, sf_dir, "customer"), "c_custkey", "a.xlsx", O.xlsx(O.text("<row>", head, "</row><row>", row, "</row>")))


_XLSX = """
SELECT c_custkey, '| Name | Balance | Since | Share |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || '| ' || c_name || ' | ' || format('{:,.2f}', c_acctbal) || ' | '
|| strftime(DATE '1899-12-30' + CAST(40000 + c_custkey % 1000 AS INTEGER), '%Y-%m-%d') || ' | ' || format('{:.2f}', c_custkey % 10000 / 100.0) || '% |' || chr(10) AS markdown FROM customer
"""


def pdf_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as PDF files, read back: a heading, a paragraph, and by turns a table of ruled lines, one of the structure
    tree, and a figure whose labels go."""
    c, s = F.col, O.shown
    body = O.text(s(72, 720, c("c_name"), 20, "F2"), s(72, 690, O.text("The account of this customer is in the segment ", c("c_mktsegment"))), s(72, 678, O.text("and holds a balance of ", O.cents(c("c_acctbal")), ".")))
    cells = ((80, 630, F.lit("Key")), (180, 630, F.lit("Segment")), (80, 610, c("c_custkey")), (180, 610, c("c_mktsegment")))
    ruled = O.text(O.rules((70, 170, 320), (645, 625, 605)), *(s(x, y, t) for x, y, t in cells), s(72, 590, O.text("Table 1: Account of ", c("c_name"))))
    marked = O.text(*(s(x, y, t, mark=k) for k, (x, y, t) in enumerate(cells)))
    row = lambda kind, ks: f"<< /S /TR /K [{' '.join(f'<< /S /{kind} /K {k} >>' for k in ks)}] >>"
    tree = f"<< /S /Table /Pg 4 0 R /K [{row('TH', (0, 1))} {row('TD', (2, 3))}] >>"
    figure = O.text("90 520 200 120 re f ", s(100, 600, O.text("label ", c("c_custkey")), 8), s(72, 500, O.text("Figure 1: Account of ", c("c_name"))))
    turn = c("c_custkey") % 3
    content = O.pdf(O.text(body, F.when(turn == 0, ruled).when(turn == 1, marked).otherwise(figure)), F.when(turn == 1, tree).otherwise(""))
    return _converted(_table(spark, sf_dir, "customer"), "c_custkey", "a.pdf", content)


_PDF = """
WITH t AS (SELECT *, '| Key | Segment |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_custkey || ' | ' || c_mktsegment || ' |' || chr(10) AS cells FROM customer)
SELECT c_custkey, '# ' || c_name || chr(10) || chr(10) || 'The account of this customer is in the segment ' || c_mktsegment || chr(10) || 'and holds a balance of ' || format('{:.2f}', c_acctbal) || '.' || chr(10) || chr(10)
|| CASE c_custkey % 3 WHEN 0 THEN cells || chr(10) || 'Table 1: Account of ' || c_name || chr(10) WHEN 1 THEN cells ELSE 'Figure 1: Account of ' || c_name || chr(10) END AS markdown FROM t
"""


def pdf_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as PDF files of two pages whose content is out of order, read back: a heading and a word that come last, a
    list number after its item, a sentence that a footnote cuts at the page's end, and one that a caption cuts."""
    c, s = F.col, O.shown
    first = O.text(
        s(72, 690, "The account of this customer is"), s(72, 678, "in a segment that has its own clerk."), s(86, 640, O.text("Key ", c("c_custkey"), " of the list")), s(72, 400, O.text("The sentence about account ", c("c_custkey"), " goes on to the")),
        s(72, 100, "Notes are in a smaller font", 8), s(72, 91, O.text("and this one is on ", c("c_nationkey"), "."), 8), s(231, 690, c("c_mktsegment")), s(72, 640, "1."), s(72, 720, c("c_name"), 20, "F2"),
    )
    second = O.text(
        s(72, 720, "next page and ends at its top."), s(72, 660, O.text("The other sentence of account ", c("c_custkey"), " waits for its")), s(72, 600, O.text("Figure 1: Nothing of ", c("c_name"), "."), 9), s(72, 540, "end, which comes after a caption."),
    )
    return _converted(_table(spark, sf_dir, "customer"), "c_custkey", "a.pdf", O.pdf(first, "", second))


_READING = """
SELECT c_custkey, array_to_string(['# ' || c_name, 'The account of this customer is ' || c_mktsegment || chr(10) || 'in a segment that has its own clerk.', '1. Key ' || c_custkey || ' of the list',
'The sentence about account ' || c_custkey || ' goes on to the' || chr(10) || 'next page and ends at its top.', 'Notes are in a smaller font' || chr(10) || 'and this one is on ' || c_nationkey || '.',
'The other sentence of account ' || c_custkey || ' waits for its' || chr(10) || 'end, which comes after a caption.', 'Figure 1: Nothing of ' || c_name || '.'], chr(10) || chr(10)) || chr(10) AS markdown FROM customer
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of lines: ten lines a page, with a running header and a page number."""
    docs = _table(spark, sf_dir, "documents").where("text is not null")
    text = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    n, page = F.col("n"), (F.floor(F.col("n") / 10) + 1).cast("int")
    size = F.when(n % 10 == 3, 14.0).otherwise(11.0)
    body = text.select("doc_id", (n * 3 + 1).alias("seq"), page.alias("page"), F.lit(72.0).alias("x"), (F.lit(200.0) + n % 10 * 14 + F.when(n % 10 > 5, 10).otherwise(0)).alias("y"), size.alias("font_size"), "text")
    of_page = text.where(n % 10 == 0).select("doc_id", n.alias("n"), page.alias("page"))
    head = of_page.select("doc_id", F.col("n") * 3, "page", F.lit(72.0), F.lit(30.0), F.lit(9.0), F.concat(F.lit("Document "), F.col("doc_id").cast("string")))
    foot = of_page.select("doc_id", F.col("n") * 3 + 2, "page", F.lit(300.0), F.lit(770.0), F.lit(9.0), F.col("page").cast("string"))
    whole = body.union(head).union(foot).withColumns({"page_height": F.lit(792.0), "width": F.lit(0.0), "bold": F.lit(False), "rotated": F.lit(False), "table_id": F.lit(-1), "heading": F.lit(0)})
    return whole.select("doc_id", F.col("seq").cast("int").alias("seq"), "page", "page_height", "x", "y", "width", "font_size", "bold", "rotated", "text", "table_id", "heading")


_LINES = """
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(ls) AS text, unnest(range(0, len(ls))) AS n FROM t),
lines AS (SELECT doc_id, n * 3 + 1 AS seq, n // 10 + 1 AS page, 200 + n % 10 * 14 + CASE WHEN n % 10 > 5 THEN 10 ELSE 0 END AS y, CASE WHEN n % 10 = 3 THEN 28 ELSE 22 END AS size_key, text FROM x
UNION ALL SELECT doc_id, n * 3, n // 10 + 1, 30, 18, 'Document ' || doc_id FROM x WHERE n % 10 = 0
UNION ALL SELECT doc_id, n * 3 + 2, n // 10 + 1, 770, 18, CAST(n // 10 + 1 AS VARCHAR) FROM x WHERE n % 10 = 0)
"""


def body_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.body_sizes(_lines(spark, sf_dir)).select("doc_id", "body")


def line_pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.pitches(_lines(spark, sf_dir))


_PITCH = (
    _LINES
    + """, g AS (SELECT *, y - lag(y) OVER w AS gap, lag(page) OVER w AS lp, lag(size_key) OVER w AS ls FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY seq))
SELECT doc_id, size_key, CAST(list_sort(list(gap))[len(list(gap)) // 2 + 1] AS DOUBLE) AS pitch FROM g WHERE page = lp AND gap > 0 AND size_key = ls GROUP BY 1, 2
"""
)


def without_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.without_furniture(_lines(spark, sf_dir)).select("doc_id", "seq", "page", "text")


_FURNITURE = (
    _LINES
    + """, p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM lines GROUP BY 1)
SELECT doc_id, CAST(seq AS INTEGER) AS seq, CAST(page AS INTEGER) AS page, text FROM lines JOIN p USING (doc_id) WHERE size_key > 18 OR pages < 3
"""
)


def section_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    number = F.concat(c("p_size").cast("string"), F.when(c("p_partkey") % 3 > 0, F.concat(F.lit("."), (c("p_partkey") % 10).cast("string"))).otherwise(F.lit("")), F.when(c("p_partkey") % 5 == 0, ".").otherwise(""))
    text = F.when(c("p_partkey") % 7 == 0, c("p_name")).otherwise(F.concat(number, F.lit(" "), c("p_name")))
    return _table(spark, sf_dir, "part").select("p_partkey", L.section_depth(text).alias("depth"))


def layout_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of lines as Markdown: furniture out, paragraphs, headings, hyphens."""
    return L.to_markdown(_lines(spark, sf_dir))


_ALL = (
    html_markdown, txt_markdown, escaped_tags, table_cells, normalized, clean_metadata, links, csv_tables, html_metadata, format_dispatch, decoded, body_sizes, line_pitches, without_furniture, section_depths, layout_markdown, docx_markdown, xlsx_markdown, pdf_markdown, pdf_reading_order,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "txt_markdown": _TXT,
        "escaped_tags": f"SELECT page_id, {_TAGS.replace('{x}', 'html')} AS escaped FROM pages",
        "table_cells": r"SELECT doc_id, regexp_replace(translate(text, 'e', '|'), '(\\*)\|', '\1\1\\|', 'g') AS cell FROM documents",
        "normalized": f"WITH n AS (SELECT doc_id, {_normalize_sql('translate(text, ' + chr(39) + 'xyq' + chr(39) + ', chr(13) || chr(10) || chr(9))')} AS t FROM documents) SELECT doc_id, {_finished_sql('t')} AS markdown FROM n",
        "clean_metadata": r"SELECT doc_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS title FROM documents",
        "links": "SELECT page_id, ' [page \\[' || page_id || '\\]](' || url || ') ' AS link, '<' || url || '>' AS own FROM pages",
        "csv_tables": _CSV,
        "html_metadata": _HTML,
        "html_markdown": _HTML_MARKDOWN,
        "docx_markdown": _DOCX,
        "xlsx_markdown": _XLSX,
        "pdf_markdown": _PDF,
        "pdf_reading_order": _READING,
        "format_dispatch": _DISPATCH,
        "decoded": "SELECT doc_id, text FROM documents",
        "body_sizes": _LINES + ", s AS (SELECT doc_id, size_key, sum(length(trim(text))) AS n FROM lines GROUP BY 1, 2) SELECT doc_id, CAST(arg_max(size_key, n * 1000 + size_key) AS INTEGER) AS body FROM s GROUP BY 1",
        "line_pitches": _PITCH,
        "without_furniture": _FURNITURE,
        "section_depths": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 3 > 0 THEN 2 ELSE 1 END AS INTEGER) AS depth FROM part",
    }
