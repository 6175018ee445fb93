"""What reviews found: rows that differed from a query's SQL, and work that grew faster than its input."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

BALANCES = [-0.0, 0.0, -0.004, 0.005, 1.005, 2.675, 0.125, 0.375, -999.995, 1234.565, 9999.999, -0.01]


@pytest.mark.parametrize("name", ["xlsx_markdown", "pdf_markdown"])
def test_balances_are_shown_as_sql_shows_them(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, f"Customer#{k:09d}", k, v, "HOUSEHOLD") for k, v in enumerate(BALANCES)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect())) == sorted(own.sql(entry.oracle_sql()[name]).fetchall())


def test_a_negative_zero_keeps_its_sign():
    from docmd.sources import xlsx

    assert xlsx.number_text(-0.0, "#,##0.00") == "-0.00" and xlsx.number_text(0.0, "#,##0.00") == "0.00" and xlsx.number_text(-0.0, "0.00;(0.00)") == "0.00"


@pytest.mark.parametrize("pdf", [False, True])
def test_all_parsers_share_a_worker(spark, pdf, monkeypatch):
    from docmd.plans import convert

    plans = []
    monkeypatch.setattr(convert, "written", lambda df, name: (plans.append(df), (_ for _ in ()).throw(StopIteration))[0])
    docs = spark.createDataFrame([("a.html", None, 3, b"<p>x")], "name string, source_uri string, length long, content binary")
    try:
        plans.append(convert.to_markdown(docs, pdf=pdf))
    except StopIteration:
        pass
    # a node of the plan that runs Python functions has a worker in each task
    assert plans[0]._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_tasks_of_the_layout_analysis_are_bounded(spark, tmp_path, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    from docmd.operators import layout
    from docmd.plans import convert

    own = duckdb.connect()
    own.execute("CREATE TABLE customer AS SELECT range AS c_custkey, 'Customer#' || lpad(CAST(range AS VARCHAR), 9, '0') AS c_name, CAST(range % 25 AS INTEGER) AS c_nationkey, 1.5::DOUBLE AS c_acctbal, 'MACHINERY' AS c_mktsegment FROM range(60)")
    own.execute(f"COPY customer TO '{tmp_path}/customer.parquet'")
    monkeypatch.setattr(convert, "LINES_PER_TASK", 90, raising=False)
    asked = []
    whole = layout.to_markdown
    monkeypatch.setattr(layout, "to_markdown", lambda *args: (asked.append(args[3] if len(args) > 3 else 0), whole(*args))[1])
    out = entry.queries()["pdf_reading_order"](spark, str(tmp_path))
    assert "hashpartitioning(doc_id" in (plan := out._jdf.queryExecution().executedPlan().toString()) and f", {asked[0]})" in plan and asked[0] > 4
    assert sorted(map(tuple, out.collect())) == sorted(own.sql(entry.oracle_sql()["pdf_reading_order"]).fetchall())


def test_texts_of_the_layout_are_made_once(spark):
    from docmd.operators import layout as L

    rows = [(1, k, 1, 792.0, 72.0, 200.0 + 14 * k, 0.0, 11.0, False, False, t, -1, 0) for k, t in enumerate(["one com-", "mon line", "and another"])]
    plan = L.to_markdown(spark.createDataFrame(rows, L.LINES))._jdf.queryExecution().optimizedPlan().toString()
    steps = [x.strip(" :+-") for x in plan.splitlines()]
    # a filter on the finished text would make it once more, and a paragraph's rows hold its text once, in its lines
    assert not [x for x in steps if x.startswith("Filter") and "array_join" in x]
    assert not [x for x in steps if x.startswith("Window") and "lead(text" in x]


def test_only_ends_that_can_break_a_word_are_searched(spark):
    from docmd.operators import layout as L

    ends = ["", "-", "- ", "-\t", "-\n", "-\r\n", "-\x85", "- ", "-   ", "-\n\n", "-\xa0", "--", "-a", "\n-", "-\x0b\f", "-\x1c"]
    lines = spark.createDataFrame([(f"one {head}{end}",) for head in ("word", "\xe4\xf6", "9", "") for end in ends], "t string")
    assert lines.where(~L._broken(F.col("t")).eqNullSafe(F.regexp_extract("t", L.BROKEN, 1))).count() == 0
    # lines without such an end are one text, as they are
    parts = spark.createDataFrame([(["a", "", "b c", "d"],), ([""],), (["", "x"],)], "p array<string>")
    assert [r[0] for r in parts.select(L.join_hyphens(F.col("p"), F.array().cast("array<string>"))).collect()] == ["a\nb c\nd", "", "x"]


def test_pages_of_a_file_share_their_fonts(monkeypatch):
    from docmd.sources import pdftext
    from tests.test_convert import pdf, shown

    made = []
    whole = pdftext.Font.__init__
    monkeypatch.setattr(pdftext.Font, "__init__", lambda self, *args: (made.append(1), whole(self, *args))[1])
    lines, _, _ = pdftext.read(pdf([shown((72, 700 - k, f"Page {k} of the file", 10, "F1")) for k in range(5)]))
    assert [x["text"] for x in lines] == [f"Page {k} of the file" for k in range(5)] and len(made) == 1


def test_objects_that_look_alike_are_told_apart():
    from docmd.sources.pdfobjects import Name, Parser, Ref, Word

    p, out = Parser(b"12 0 R 12 0 RG +.5 -3 4. .x 12a true false trues /a#20b /true (a(b)\\)\\101) (plain) () <</K false>> % c\n+ ' 1 2"), []
    while (x := p.next()) is not None:
        out.append((type(x), x))
    assert out == [
        (Ref, 12), (int, 12), (int, 0), (Word, "RG"), (float, 0.5), (int, -3), (float, 4.0), (Word, ".x"), (Word, "12a"), (bool, True), (bool, False), (Word, "trues"), (Name, "a b"), (Name, "true"),
        (bytes, b"a(b))A"), (bytes, b"plain"), (bytes, b""), (dict, {"K": False}), (Word, "+"), (Word, "'"), (int, 1), (int, 2),
    ]


def test_the_layout_of_files_has_few_tasks_and_a_short_key(spark, tmp_path, monkeypatch):
    from docmd.operators import layout
    from docmd.plans import convert

    rows = [(k, f"Customer#{k:09d}", k % 25, 1.5, "MACHINERY") for k in range(100)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    # each task of the layout compiles its plan again, so that tasks of 40,000 lines spent most of their time on that
    assert convert.LINES_PER_TASK >= 100_000
    asked = []
    whole = layout.to_markdown
    monkeypatch.setattr(layout, "to_markdown", lambda *args: (asked.append((dict(args[0].dtypes)["doc_id"], args[3])), whole(*args))[1])
    for least, tasks in ((1100, 1), (1099, 4), (250, 8)):
        monkeypatch.setattr(convert, "LINES_PER_TASK", least)
        entry.queries()["pdf_reading_order"](spark, str(tmp_path))
        assert asked[-1] == ("bigint", tasks)


def test_small_files_are_dealt_by_their_number(spark):
    from docmd.session import spread

    # one split holds all rows, though there are as many splits as cores
    rows = spark.range(0, 400, 1, 4).where("id < 100")
    sizes = lambda df: [len(x) for x in df.rdd.glom().collect()]
    assert max(sizes(spread(rows))) == 100 and spread(rows, 25).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    assert max(sizes(spread(rows, 5))) <= 10 and len(sizes(spread(rows, 5))) == 20


def test_only_files_with_a_broken_word_are_searched_for_words(spark, monkeypatch):
    from docmd.operators import layout
    from docmd.plans import convert
    from tests.test_convert import pdf, shown

    asked = []
    whole = layout.to_markdown
    monkeypatch.setattr(layout, "to_markdown", lambda *args: (asked.append(args[4]), whole(*args))[1])
    lines = ("A rewrite of the text and one re-", "write more.", "A line of re-", "ading ends it.")
    files = [shown(*((72, 700 - 12 * k, x, 10, "F1") for k, x in enumerate(own))) for own in (lines, ("A line", "and an end."), ())]
    docs = spark.createDataFrame([(k, "a.pdf", None, 1, pdf([x])) for k, x in enumerate(files)], "k int, name string, source_uri string, length long, content binary")
    out = {r.k: r.markdown for r in convert.to_markdown(docs).collect()}
    assert out == {0: "A rewrite of the text and one rewrite\nmore.\nA line of re-ading\nends it.\n", 1: "A line\nand an end.\n", 2: ""}
    assert sorted(r.text for r in asked[0].collect()) == sorted(lines)
