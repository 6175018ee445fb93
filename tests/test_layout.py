"""Layout analysis on small documents of lines."""

import random

from pyspark.sql import functions as F

from docmd.operators import layout as L


def lines(spark, docs: dict[int, list[dict]]):
    rows = []
    for doc, items in docs.items():
        for k, x in enumerate(items):
            d = {"page": 1, "page_height": 792.0, "x": 72.0, "y": 100.0 + 14 * k, "width": 0.0, "font_size": 11.0, "bold": False, "rotated": False, "table_id": -1, "heading": 0} | x
            rows.append((doc, k, *(d[c] for c in ("page", "page_height", "x", "y", "width", "font_size", "bold", "rotated", "text", "table_id", "heading"))))
    return spark.createDataFrame(rows, L.LINES)


def body(text, y, **more):
    return {"text": text, "y": float(y)} | more


def test_furniture(spark):
    pages = []
    for p in range(1, 6):
        pages += [body("Annual Report", 30, page=p, x=60.0), body(f"Text of page {p} is here.", 200, page=p), body(f"{p}", 770, page=p, x=300.0)]
    pages += [body("Annual Report", 300, page=5)]  # in the middle of a page it stays
    left = [r.text for r in L.without_furniture(lines(spark, {1: pages, 2: pages[:3]})).orderBy("doc_id", "seq").collect()]
    assert left == [f"Text of page {p} is here." for p in range(1, 6)] + ["Annual Report"] + ["Annual Report", "Text of page 1 is here.", "1"]
    # a repeated row below other text at the edge stays
    above = [x for p in range(1, 5) for x in (body(f"Table {'abcd'[p - 1]} title", 20, page=p), body("2024 2025", 40, page=p), body("Words.", 300, page=p))]
    assert L.without_furniture(lines(spark, {1: above})).count() == 12


def test_pitch_and_paragraphs(spark):
    doc = [body("First line of a paragraph that goes", 100), body("on here and ends.", 114), body("After a gap.", 150), body("Indented new one", 164, x=90.0), body("back at the margin.", 178)]
    df = lines(spark, {1: doc})
    assert [tuple(r) for r in L.pitches(df).collect()] == [(1, 22, 14.0)]
    assert [r.para for r in L.with_paragraphs(df).orderBy("seq").collect()] == [1, 1, 2, 3, 3]
    cut = [body("A sentence that is long enough to fill its line and is", 700), body("cut by the end of the page.", 80, page=2), body("New one after it.", 120, page=2)]
    assert [r.para for r in L.with_paragraphs(lines(spark, {1: cut})).orderBy("seq").collect()] == [1, 1, 2]


def test_headings(spark):
    text = "This is body text that has quite a few characters in it, so that it is the body."
    doc = [
        body("The Title", 80, font_size=20.0), body(text, 120), body("1 Introduction", 160, font_size=14.0, bold=True), body(text, 190), body("1.1 Details", 220, font_size=12.0, bold=True), body(text, 250),
        body("2. Methods", 280, bold=True), body(text, 300), body("1. An item out of sequence", 330, bold=True), body(text, 350), body("12 May 2024", 380, font_size=14.0), body(text, 400), body("Appendix", 430, font_size=16.0), body(text, 460), body("small note", 490, font_size=8.0),
    ]
    df = lines(spark, {1: doc})
    found = L.with_headings(L.paragraphs(L.with_paragraphs(df)), L.body_sizes(df)).where("level > 0").orderBy("para").collect()
    assert [(r.text, r.level) for r in found] == [("The Title", 1), ("1 Introduction", 2), ("1.1 Details", 3), ("2. Methods", 2), ("Appendix", 2)]


def test_contents_and_depth(spark):
    cases = {"2 x": 1, "2.1 x": 2, "A. x": 1, "A.1 x": 2, "Appendix B: x": 1, "§ 3 x": 1, "1.2.3. x": 3, "x": 0, "1990 x": 0}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", L.section_depth(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == cases
    text = "This is body text that has quite a few characters in it, so that it is the body."
    doc = [body("1 Introduction 4", 80, bold=True), body(text, 120), body("1 Introduction", 160, bold=True), body(text, 190)]
    df = lines(spark, {1: doc})
    found = L.with_headings(L.paragraphs(L.with_paragraphs(df)), L.body_sizes(df)).where("level > 0").collect()
    assert [r.text for r in found] == ["1 Introduction"]


def test_markers_hyphens_markdown(spark):
    doc = [
        body("Guide", 60, font_size=20.0), body("An informa-", 100), body("tion about well-", 114), body("known things, a well-known fact, <b>.", 128), body("•", 160, x=60.0), body("first item", 160, x=80.0), body("# no heading", 200),
        {"text": "", "y": 240.0, "table_id": 0}, body("The end.", 280),
    ]
    tables = spark.createDataFrame([(1, 0, "| a |\n| --- |")], "doc_id long, table_id int, markdown string")
    out = L.to_markdown(lines(spark, {1: doc, 2: [{"text": None}]}), tables).collect()
    assert [r.doc_id for r in out] == [1]
    assert out[0].markdown == "# Guide\n\nAn information\nabout well-known\nthings, a well-known fact, \\<b>.\n\n- first item\n\n\\# no heading\n\n| a |\n| --- |\n\nThe end.\n"
    assert L.to_markdown(lines(spark, {1: []}) if False else spark.createDataFrame([], L.LINES)).count() == 0


def test_hyphens(spark):
    doc = [
        body("It is reli-", 100), body("able and surpris-", 114), body("ing, an over-", 128), body("flow of the lon-", 142), body("gest kind, a flow.", 156), body("seasonal-", 170), body("ity and sea-", 184), body("sonality", 198),
    ]
    (out,) = L.to_markdown(lines(spark, {1: doc})).collect()
    assert out.markdown == "It is reliable\nand surprising,\nan over-flow\nof the lon-gest\nkind, a flow.\nseasonality\nand seasonality\n"
    (out,) = L.to_markdown(lines(spark, {1: doc[:5]}), dictionary=F.array(F.lit("longest"))).collect()
    assert "the longest\n" in out.markdown


def test_split_links(spark):
    many = [f"[w{i}](https://x.org/a)" for i in range(100)]
    row = spark.createDataFrame([(["see [a](https://x.org/a)", "[b](https://x.org/a) and", "[c](https://x.org/b)"], many, [])], "a array<string>, b array<string>, c array<string>")
    got = row.select(*(L.join_split_links(F.col(c)) for c in "abc")).first()
    assert list(got) == ["see [a b](https://x.org/a) and\n[c](https://x.org/b)", "[" + " ".join(f"w{i}" for i in range(100)) + "](https://x.org/a)", ""]


def test_second_body_size(spark):
    text = "A plain line of text with at least forty characters in it, {}."
    mixed = [body(text.format(i), 100 + 14 * i, font_size=11.5 if i % 2 else 11.0) for i in range(40)]
    apart = [body(text.format(i), 100 + 14 * i, font_size=11.5 if i >= 20 else 11.0) for i in range(40)]
    got = {r.doc_id: (r.body, list(r.bodies)) for r in L.body_sizes(lines(spark, {1: mixed + [body("x" * 300, 700)], 2: apart + [body("x" * 300, 700)]})).collect()}
    assert got == {1: (22, [22, 23]), 2: (22, [22])}


def test_bullets_of_a_page(spark):
    doc = [body("•", 100, x=60.0), body("◦", 100, x=65.0), body("near", 101, x=80.0), body("far", 100, x=200.0), body("•", 300, x=60.0), body("•", 100, x=60.0, page=2), body("x", 100, x=90.0, page=2)]
    got = [(r.text, r.x) for r in L.attach_markers(lines(spark, {1: doc})).orderBy("seq").collect()]
    assert got == [("• near", 60.0), ("far", 200.0), ("•", 60.0), ("• x", 60.0)]


def test_plan_has_no_self_join(spark):
    plan = L.to_markdown(lines(spark, {1: [body("x", 100)]}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") + plan.count("Exchange(") <= 6 and plan.count("Join") <= 1


def markdowns(spark, *docs):
    """Of each document, in one run."""
    found = {r.doc_id: r.markdown for r in L.to_markdown(lines(spark, dict(enumerate(docs)))).collect()}
    return [found[k] for k in range(len(docs))]


LONG = "the oven was so hot on that day that all of the loaves of"


def test_a_sentence_goes_on_past_the_footnotes_of_its_page(spark):
    notes = [body("1 A note below the text, which", 700, font_size=8.0), body("goes on for a line.", 709, font_size=8.0)]
    more = [body("2 One more note.", 700, font_size=8.0, page=2)]
    first, second, third = body(LONG, 100), body("rye were black, and " + LONG, 80, page=2), body("oats too.", 80, page=3)
    whole, hyphen, table, *cut = markdowns(
        spark, [first, *notes, second, *more, third], [body(LONG + " wheat-", 100), *notes, body("Less bread.", 80, page=2, x=300.0)], [first, notes[0], body("", 730, table_id=0), body("rye was black.", 80, page=2)],
        # the next page begins a sentence, is of another size or not the next one; the sentence has ended
        [first, *notes, body("Rye was black.", 80, page=2)], [first, *notes, body("rye was black.", 80, page=2, font_size=9.5)], [first, *notes, body("rye was black.", 80, page=3)], [body(LONG + " rye.", 100), *notes, body("rye", 80, page=2)],
    )
    assert whole == f"{LONG}\nrye were black, and {LONG}\noats too.\n\n1 A note below the text, which\ngoes on for a line.\n\n2 One more note.\n"
    assert [x.split("\n\n")[1][:8] for x in cut] == ["1 A note"] * 4
    # after a hyphen, in another column; a table is no footnote
    assert hyphen.startswith(f"{LONG} wheat-\nLess bread.\n\n1 A") and "\n\nrye" in table


def test_a_sentence_goes_on_past_captions(spark):
    caption, table = body("Figure 2: Loaves.", 300, font_size=9.0), body("", 340, table_id=0)
    rest, last = body("rye were black.", 500), body("oats too.", 700)
    joined, capital, digit, plain, twice, four = markdowns(
        spark, [body(LONG, 100), caption, table, rest], [body(LONG, 100), caption, body("Rye was black.", 500)], [body(LONG, 100), caption, body("2 rye loaves", 500)],
        [body(LONG, 100), body("Plain text in between.", 300, font_size=9.0), rest], [body(LONG, 100), caption, body(LONG, 400), body("Table 3. Flour.", 600, font_size=9.0), last],
        [body(LONG, 100), caption, body(LONG, 150), caption | {"y": 200.0}, body(LONG, 250), caption, body(LONG, 350)],
    )
    assert joined == f"{LONG}\nrye were black.\n\nFigure 2: Loaves.\n" and capital == f"{LONG}\n\nFigure 2: Loaves.\n\nRye was black.\n"
    assert digit.count("\n\n") == plain.count("\n\n") == 2
    # the rest takes no rest of its own
    assert twice == f"{LONG}\n{LONG}\n\nFigure 2: Loaves.\n\nTable 3. Flour.\n\noats too.\n"
    assert four.split("\n\n") == [f"{LONG}\n{LONG}", "Figure 2: Loaves.", "Figure 2: Loaves.", f"{LONG}\n{LONG}", "Figure 2: Loaves.\n"]


def test_numbers_and_levels_of_many_headings(spark):
    """The running forms, against a loop over the headings."""
    r = random.Random(4)
    text = "This is body text that has quite a few characters in it, so that it is the body."
    items, heads = [body(text, 50)], []
    for k in range(60):
        kind = r.choice(["number", "number", "letter", "plain"])
        name = {"number": f"{r.randint(1, 9)}{'.1' * r.randint(0, 3)} Flour", "letter": f"{r.choice('ABC')}.{r.randint(1, 3)} Flour", "plain": "Flour and bread"}[kind] + f" of kind {k} here"
        size = r.choice([12.0, 14.0, 16.0])
        heads.append((name, kind, size))
        items += [body(name, 60 + 100 * k, font_size=size, page=2), body(text, 100 + 100 * k, page=2)]
    last, own = 0, []
    for name, kind, size in heads:
        top = int(name.split(" ")[0].split(".")[0]) if kind == "number" else None
        if kind == "plain":
            last = 0
        if top is not None and top < last:
            continue
        last = top or last
        own.append((name, 1 + name.split(" ")[0].count(".") if kind != "plain" else 0, size))
    by_size = {s: min((d + 1 for _, d, z in own if d and z == s), default=None) for *_, s in own}
    plain = sorted({s for _, d, s in own if not d and by_size[s] is None}, reverse=True)
    levels = [min(6, d + 1) if d else by_size[s] if by_size[s] is not None else plain.index(s) + 1 for _, d, s in own]
    was = out = 0
    expected = []
    for (name, _, _), level in zip(own, levels, strict=True):
        out = level if not was else min(level, out + 1) if level > was else out if level == was else min(level, out)
        was = level
        expected.append((name, out))
    df = lines(spark, {1: items})
    found = L.with_headings(L.paragraphs(L.with_paragraphs(df)), L.body_sizes(df)).where("level > 0").orderBy("para").collect()
    assert [(x.text, x.level) for x in found] == expected


def test_words_of_a_dictionary(spark):
    doc = [body("A long life for autom-", 100), body("atic ovens, and for sun-", 114), body("set-", 128), body("tings.", 142)]
    words = spark.createDataFrame([("Automatic",), ("sunsettings",), (None,), ("of",)], "w string")
    (out,) = L.to_markdown(lines(spark, {1: doc}), dictionary=words).collect()
    assert out.markdown == "A long life for automatic\novens, and for sun-set-tings.\n"
    assert "autom-atic" in L.to_markdown(lines(spark, {1: doc})).first().markdown
    # a known tail keeps the hyphen
    assert "autom-atic" in L.to_markdown(lines(spark, {1: doc}), dictionary=words.union(spark.createDataFrame([("atic",)], "w string"))).first().markdown
