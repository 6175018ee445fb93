"""Tables from cells: (doc_id, table_id, row, col, text, is_header) to (doc_id, table_id, markdown)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmd.functions import markdown as M

CELLS = "doc_id long, table_id int, row int, col int, text string, is_header boolean"


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def of_rows(rows: Column, blank: Column) -> Column:
    """An array of rows of texts as a Markdown table: cells on one line, rows padded, columns without any text left out; the
    first row is the header. blank: the header is empty, and rows without text go. Null without rows or without any text."""
    own = F.transform(rows, lambda r: F.transform(r, lambda x: M.table_cell(M.strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))))
    at = lambda r, k: F.coalesce(F.get(r, k), F.lit(""))

    def shown(grid: Column) -> Column:
        body = F.when(blank, F.filter(grid, lambda r: F.exists(r, lambda x: x != ""))).otherwise(F.slice(grid, 2, F.size(grid)))
        head = F.when(blank, F.transform(grid[0], lambda _: F.lit(""))).otherwise(grid[0])
        return F.array_join(F.concat(F.array(_line(head), _line(F.transform(grid[0], lambda _: F.lit("---")))), F.transform(body, _line)), "\n")

    def table(clean: Column) -> Column:
        width = F.greatest(F.array_max(F.transform(clean, F.size)), F.lit(1))
        used = F.filter(F.sequence(F.lit(0), width - 1), lambda k: F.exists(clean, lambda r: at(r, k) != ""))
        return _let(used, lambda u: F.when(F.size(u) > 0, _let(F.transform(clean, lambda r: F.transform(u, lambda k: at(r, k))), shown)))

    return F.when(F.size(rows) > 0, _let(own, table))


def to_markdown(cells: DataFrame) -> DataFrame:
    """Each table as Markdown, rows and columns in order, cells on one line, rows padded, empty columns left out.

    Without a header cell the first row is the header; where there are header cells but the first row is not all of
    them, the header is empty, and rows without text go. Several cells of one place are joined by a space. A table
    of fewer than two rows or columns is no table and has no row here; nor has one without any text.
    """
    text = M.table_cell(M.strip(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    placed = cells.where("row is not null and col is not null").select("doc_id", "table_id", "row", "col", text.alias("text"), F.coalesce("is_header", F.lit(False)).alias("is_header"))
    joined = placed.groupBy("doc_id", "table_id", "row", "col").agg(F.array_join(F.sort_array(F.collect_list(F.nullif("text", F.lit("")))), " ").alias("text"), F.bool_and("is_header").alias("is_header"))
    rows = joined.groupBy("doc_id", "table_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("cells"), F.bool_and("is_header").alias("all_header"), F.bool_or("is_header").alias("has_header"))
    ordered = F.sort_array(F.collect_list(F.struct("row", "all_header", "cells_", "has_header")))
    plain = rows.withColumn("cells_", F.sort_array(F.map_entries("cells"))).groupBy("doc_id", "table_id").agg(ordered.alias("rows"))
    all_columns = F.array_distinct(F.flatten(F.transform("rows", lambda r: F.transform(r["cells_"], lambda c: c["key"]))))
    used = F.sort_array(F.array_distinct(F.flatten(F.transform("rows", lambda r: F.transform(F.filter(r["cells_"], lambda c: c["value"] != ""), lambda c: c["key"])))))
    known = plain.withColumns({"used": used, "width": F.size(all_columns)}).where((F.size("rows") > 1) & (F.col("width") > 1) & (F.size("used") > 0))
    grid = F.transform("rows", lambda r: F.transform("used", lambda k: F.coalesce(F.get(F.filter(r["cells_"], lambda c: c["key"] == k), F.lit(0))["value"], F.lit(""))))
    blank = F.exists("rows", lambda r: r["has_header"]) & ~F.col("rows")[0]["all_header"]
    shaped = known.withColumns({"grid": grid, "blank": blank})
    body = F.when(F.col("blank"), F.filter("grid", lambda r: F.exists(r, lambda x: x != ""))).otherwise(F.slice("grid", 2, F.size("grid")))
    head = F.when(F.col("blank"), F.array_repeat(F.lit(""), F.size("used"))).otherwise(F.col("grid")[0])
    lines = F.concat(F.array(_line(head), _line(F.array_repeat(F.lit("---"), F.size("used")))), F.transform(body, _line))
    return shaped.select("doc_id", "table_id", F.array_join(lines, "\n").alias("markdown"))
