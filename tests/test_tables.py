"""Tables from cells, and links split over lines."""

from pyspark.sql import functions as F

from docmd.operators import layout, tables


def test_tables(spark):
    cells = [
        (1, 0, 0, 0, "A", None), (1, 0, 0, 1, " B\n|", None), (1, 0, 1, 0, "1", None), (1, 0, 2, 2, None, None), (1, 0, 2, 1, "2", None),
        (1, 1, 0, 0, "x", True), (1, 1, 0, 1, "y", False), (1, 1, 1, 0, "", False), (1, 1, 2, 0, "z", False),
        (2, 0, 0, 0, "H", True), (2, 0, 0, 1, "I", True), (2, 0, 1, 1, "b", False), (2, 0, 1, 1, "a", False),
        (3, 0, 0, 0, "one row", None), (3, 0, 0, 1, "only", None), (4, 0, 0, 0, "", None), (4, 0, 1, 1, "", None), (5, 0, None, 0, "lost", None),
    ]
    out = {(r.doc_id, r.table_id): r.markdown for r in tables.to_markdown(spark.createDataFrame(cells, tables.CELLS)).collect()}
    assert out == {
        (1, 0): "| A | B \\| |\n| --- | --- |\n| 1 |  |\n|  | 2 |",
        (1, 1): "|  |  |\n| --- | --- |\n| x | y |\n| z |  |",
        (2, 0): "| H | I |\n| --- | --- |\n|  | a b |",
    }


def test_split_links(spark):
    text = "See [the](https://a.org/x)\n[long](https://a.org/x)\n[name](https://a.org/x) and [b](https://b.org)\n[c](https://c.org)"
    got = spark.range(1).select(layout.join_split_links(F.split(F.lit(text), "\n")).alias("x")).first().x
    assert got == "See [the long name](https://a.org/x) and [b](https://b.org)\n[c](https://c.org)"
