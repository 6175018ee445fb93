"""Documents to Markdown, one row in and one row out.

Plain text stays in the JVM; the other formats are parsed by Arrow functions in one pass over the rows and, where
they are tables, written as Markdown by column expressions again, without a shuffle. PDF files become lines in the same pass,
the results of which are written to the shared folder, and the layout analysis of `operators.layout` makes Markdown of these. Whatever a
parser trips over is that document's error.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmd.functions import markdown as M
from docmd.operators import layout as L
from docmd.operators import tables as T
from docmd.session import written
from docmd.sources import files

#: Lines of PDF files that a task of the layout analysis gets about.
LINES_PER_TASK = 200_000
_ERROR = "struct<kind:string,message:string>"
_RESULT = f"struct<markdown:string,title:string,author:string,language:string,error:{_ERROR}>"
_ERROR_ARROW = pa.struct([("kind", pa.string()), ("message", pa.string())])


def _result(cells: list[tuple | Exception | None], kind: pa.DataType) -> pa.Array:
    return pa.array([None if c is None else {"error": _error(c)} if isinstance(c, Exception) else c for c in cells], kind)


def _error(e: Exception) -> dict[str, str]:
    from docmd.sources.pdftext import Scanned
    from docmd.sources.xlsx import TooSparse

    kind = "too_large" if isinstance(e, TooSparse) else "unsupported" if isinstance(e, Scanned) else "conversion"
    return {"kind": kind, "message": str(e) or type(e).__name__}


def _parsed(reader: str):
    """An Arrow function from content (and address) to the result struct of a format."""
    kind = pa.struct([("markdown", pa.string()), ("title", pa.string()), ("author", pa.string()), ("language", pa.string()), ("error", _ERROR_ARROW)])

    def run(contents: pa.Array, addresses: pa.Array) -> pa.Array:
        from docmd.sources import docx, html

        out: list = []
        for data, address in zip(contents, addresses, strict=True):
            if not data.is_valid:
                out.append(None)
                continue
            try:
                raw = data.as_buffer().to_pybytes()
                found = html.to_markdown(raw, address.as_py()) if reader == "html" else docx.to_markdown(raw)
                out.append(dict(zip(("markdown", "title", "author", "language"), found, strict=True)))
            except Exception as e:  # noqa: BLE001 - the border of one document
                out.append(e)
        return _result(out, kind)

    run.__annotations__ = {"contents": pa.Array, "addresses": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _RESULT)


_SHEETS = "struct<sheets:array<struct<name:string,rows:array<array<struct<col:int,text:string>>>>>,title:string,author:string,language:string,error:" + _ERROR + ">"


def _sheets():
    cell = pa.struct([("col", pa.int32()), ("text", pa.string())])
    sheet = pa.struct([("name", pa.string()), ("rows", pa.list_(pa.list_(cell)))])
    kind = pa.struct([("sheets", pa.list_(sheet)), ("title", pa.string()), ("author", pa.string()), ("language", pa.string()), ("error", _ERROR_ARROW)])

    def run(contents: pa.Array) -> pa.Array:
        from docmd.sources import xlsx

        out: list = []
        for data in contents:
            try:
                if not data.is_valid:
                    out.append(None)
                    continue
                sheets, own = xlsx.read(data.as_buffer().to_pybytes())
                shown = [{"name": n, "rows": [[{"col": c, "text": t} for c, t in r] for r in rows]} for n, rows in sheets]
                out.append({"sheets": shown, "title": own["title"], "author": own["creator"], "language": own["language"]})
            except Exception as e:  # noqa: BLE001 - the border of one document
                out.append(e)
        return _result(out, kind)

    run.__annotations__ = {"contents": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _SHEETS)


def _records():
    def run(texts: pa.Array, tabs: pa.Array) -> pa.Array:
        from docmd.sources.csvtext import parse

        return pa.array([parse(t.as_py(), bool(b.as_py())) if t.is_valid else None for t, b in zip(texts, tabs, strict=True)], pa.list_(pa.list_(pa.string())))

    run.__annotations__ = {"texts": pa.Array, "tabs": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<array<string>>")


def csv_records(text: Column, tabs: Column | None = None) -> Column:
    """The records of CSV text (tabs: separated by tabs)."""
    return _records()(text, tabs if tabs is not None else F.lit(False))


def csv_markdown(records: Column) -> Column:
    """Records as a Markdown table."""
    return M.normalize(M.render_table(F.transform(records, lambda row: F.transform(row, M.cell_text))))


def sheets_markdown(sheets: Column) -> Column:
    """Sheets as tables of their used columns; with their names as headings where there are several."""

    def table(sheet: Column) -> Column:
        rows = sheet["rows"]
        used = F.array_sort(F.array_distinct(F.flatten(F.transform(rows, lambda r: F.transform(r, lambda c: c["col"])))))
        dense = F.transform(rows, lambda r: F.transform(used, lambda k: F.coalesce(F.get(F.filter(r, lambda c: c["col"] == k), F.lit(0))["text"], F.lit(""))))
        body = M.render_table(F.transform(dense, lambda r: F.transform(r, lambda x: M.table_cell(M.strip(F.regexp_replace(x, r"\s*[\r\n]+\s*", " "))))))
        return F.when(F.size(sheets) > 1, F.concat(F.lit("# "), M.escape(sheet["name"]), F.lit("\n\n"), body)).otherwise(body)

    return M.normalize(M.escape_tags_outside_links(F.array_join(F.transform(sheets, table), "\n")))


_LINE = "struct<page:int,page_height:double,x:double,y:double,width:double,font_size:double,bold:boolean,rotated:boolean,text:string,table_id:int,heading:int,seq:int>"
_TABLE = "struct<table_id:int,rows:array<array<string>>,blank:boolean>"


def _pdf():
    kind = pa.struct([
        ("lines", pa.list_(pa.struct([
            ("page", pa.int32()), ("page_height", pa.float64()), ("x", pa.float64()), ("y", pa.float64()), ("width", pa.float64()), ("font_size", pa.float64()), ("bold", pa.bool_()), ("rotated", pa.bool_()),
            ("text", pa.string()), ("table_id", pa.int32()), ("heading", pa.int32()), ("seq", pa.int32()),
        ]))), ("tables", pa.list_(pa.struct([("table_id", pa.int32()), ("rows", pa.list_(pa.list_(pa.string()))), ("blank", pa.bool_())]))), ("title", pa.string()), ("author", pa.string()), ("language", pa.string()), ("error", _ERROR_ARROW),
    ])

    def run(contents: pa.Array) -> pa.Array:
        from docmd.sources import pdftext

        out: list = []
        for data in contents:
            try:
                found = pdftext.read(data.as_buffer().to_pybytes()) if data.is_valid else None
                out.append(found and {"lines": found[0], "tables": found[2]} | found[1])
            except Exception as e:  # noqa: BLE001 - the border of one document
                out.append(e)
        return _result(out, kind)

    run.__annotations__ = {"contents": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, f"struct<lines:array<{_LINE}>,tables:array<{_TABLE}>,title:string,author:string,language:string,error:{_ERROR}>")


def to_markdown(documents: DataFrame, limit: int | None = files.MAX_DOCUMENT_SIZE, mode: str = "permissive", pdf: bool = True, words: DataFrame | None = None) -> DataFrame:
    """documents (name, source_uri, length, content, ...) with markdown, title, author, language and error in place
    of the content. permissive: a document that can't be read has an error; failfast: it ends the query.

    With pdf, documents are parsed and the results written when this is called, to the folder of `spark.checkpoint.dir`;
    `session.discard` of the result deletes them when it has been used. pdf=False leaves PDF files out of the plan, which is
    lazy then: they are unsupported.
    words: a table of one column, words of the documents' language, for words that a line's end breaks in PDF files. It is
    broadcast while Spark's limit for that holds it, and shuffled beyond.
    A null content has a null result; a null name is unsupported. Columns of the results' names are replaced, and any
    other name is kept as it is.
    """
    if mode not in ("permissive", "failfast"):
        raise ValueError(f"mode is permissive or failfast, not {mode}")
    results = ("markdown", "title", "author", "language", "error")
    keep = [c for c in documents.columns if c.lower() not in (*results, "content")]
    name, c = F.coalesce("name", F.lit("")), F.col
    # the kept columns travel in one, so that none can clash
    marked = documents.select(
        F.struct(*(F.col(f"`{x}`") for x in keep)).alias("kept"), "content", c("source_uri").alias("address"), files.refusal(name, c("length"), limit).alias("refusal"),
        files.format_of(name).alias("format"), (files.extension(name) == "tsv").alias("tabs"), name.alias("name"),
    )
    if not pdf:
        refused = F.struct(F.lit("unsupported").alias("kind"), F.lit("PDF files are left out").alias("message"))
        marked = marked.withColumn("refusal", F.coalesce("refusal", F.when(c("format") == "pdf", refused)))
    is_pdf = c("refusal").isNull() & (F.coalesce("format", F.lit("")) == "pdf")
    # one pass over all formats: each parser gets the contents of its own and nulls. All of them are functions of whole batches,
    # which Spark runs in one worker; functions of iterators would be given a worker each
    own = lambda kind: F.when(c("refusal").isNull() & (c("format") == kind), c("content"))
    read = marked.withColumns({
        "csv": csv_records(files.decode(own("csv")), c("tabs")), "xlsx": _sheets()(own("xlsx")), "html": _parsed("html")(own("html"), c("address")), "docx": _parsed("docx")(own("docx"), c("address")),
    } | ({"pdf": _pdf()(own("pdf"))} if pdf else {}))
    parsers = ("xlsx", "html", "docx", *(("pdf",) if pdf else ()))
    field = lambda n: F.coalesce(*(F.col(f"{k}.{n}") for k in parsers))
    markdown = F.coalesce("html.markdown", "docx.markdown", csv_markdown(c("csv")), sheets_markdown(c("xlsx.sheets")), M.render_txt(files.decode(own("txt"))))
    failed = field("error")
    failure = F.when(failed.isNotNull(), F.struct(failed["kind"].alias("kind"), F.concat(failed["message"], F.lit(": "), "name").alias("message")))
    facts = (*(field(n).alias(n) for n in results[1:4]), F.coalesce("refusal", failure).cast(_ERROR).alias("error"))
    scratch: tuple[str, ...] = ()
    if pdf:
        # contents are read once: what the parsers make of them is written, and the lines of PDF files read from there
        whole = written(read.select("kept", markdown.alias("markdown"), *facts, is_pdf.alias("is_pdf"), "pdf.lines", "pdf.tables", F.when(is_pdf, F.monotonically_increasing_id()).alias("doc_id")), "documents")
        pages = whole.where("is_pdf")
        lines_of = lambda df: df.select("doc_id", F.explode("lines").alias("l")).select("doc_id", "l.*").select(*(x.split(" ")[0] for x in L.LINES.split(", ")))
        lines, broken = lines_of(pages), lines_of(pages.where(F.exists("lines", lambda s: L.may_break(s["text"]))))
        tables = pages.select("doc_id", F.explode("tables").alias("t")).select("doc_id", "t.table_id", T.of_rows(F.col("t.rows"), F.col("t.blank")).alias("markdown"))
        # tasks of bounded lines, whatever the input. The plan seems to have more generated classes than Spark keeps: each task has a
        # cost of its own, so that they are as few as that allows, in whole rounds of the cores
        count = pages.agg(F.sum(F.size("lines").cast("long"))).first()[0] or 0
        cores = whole.sparkSession.sparkContext.defaultParallelism
        rounds = -(-count // (LINES_PER_TASK * cores))
        shown = L.to_markdown(lines, tables, words, rounds * cores if count > LINES_PER_TASK else 1, broken)
        joined = pages.withColumn("read", c("lines").isNotNull()).drop("markdown", "lines", "tables").join(shown.withColumnRenamed("doc_id", "of"), c("doc_id") == c("of"), "left")
        # a file without lines is empty, one that can't be read or has no content is null
        found = F.when(c("error").isNull() & c("read"), F.coalesce("markdown", F.lit("")))
        out = whole.where("not is_pdf").select("kept", *results).unionByName(joined.select("kept", found.alias("markdown"), *results[1:]))
        scratch = (*whole.scratch, *shown.scratch)
    else:
        out = read.select("kept", markdown.alias("markdown"), *facts)
    if mode == "failfast":
        out = out.withColumn("markdown", F.when(c("error").isNotNull(), F.raise_error(c("error.message")).cast("string")).otherwise(c("markdown")))
    out = out.select(*(c("kept")[x].alias(x) for x in keep), *results)
    out.scratch = scratch
    return out
