"""Layout analysis of text lines: from the `lines` of page-oriented documents to Markdown blocks.

lines: doc_id, seq, page, page_height, x, y, width, font_size, bold, rotated, text, table_id (-1: none), heading
(0: none). Every operator is window functions and aggregates over doc_id and what else, without a self-join, so that the
one shuffle on doc_id in `to_markdown` serves the whole chain. What depends on all headings before is a running count or
minimum, and the words that hyphens are joined by are looked up once in a document, so that work grows with a document's
lines. A task holds a page, or the paragraphs of a document, at a time.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmd.functions import markdown as M
from docmd.session import written

LINES = "doc_id long, seq int, page int, page_height double, x double, y double, width double, font_size double, bold boolean, rotated boolean, text string, table_id int, heading int"

# The thresholds and patterns of the output format's rules.
EDGE, PAGE_SHARE, MIN_PAGES, X_BUCKET, SAME_BASELINE = 0.15, 0.4, 3, 20.0, 0.5
PARAGRAPH_GAP, MIN_PITCH, MAX_PITCH, DEFAULT_PITCH, INDENT, HANGING, FULL_LINE = 1.3, 0.8, 1.5, 1.2, 0.5, 3.0, 40
MAX_LINES, MAX_TITLE_LINES, TITLE_RATIO, FIRST_TITLE_RATIO, MAX_LENGTH, MAX_LEVEL, BELOW_BODY, MAX_TAGGED_WORDS = 2, 4, 1.5, 1.25, 200, 6, 3, 12
CENTRED, SHORT_LINE, ABSTRACT_PAGES = 0.1, 40, 2
BULLETS = "•◦▪●○■"
LIST_ITEM = rf"^\s*([{BULLETS}*-]|\d+[.)])\s"
SENTENCE_END = "[.!?:;\"”’)\\]]$"
TOC_ENTRY = r"(\.\s?){4,}\s*\d+\s*$"
WORD = r"\p{L}{3}"
ROMAN = "^[ivxlcdm]+$"
DOT_LEADER = r"\.{4,}|(\. ){3,}"
SECTION_NUMBER = r"^(?:Appendix\s+[A-Z]|\d{1,2}((?:\.\d{1,2})*)\.?|[A-Z]((?:\.\d{1,2})+)\.?|[A-Z]\.|§\s*\d{1,3}((?:\.\d{1,2})*)\.?)(?=[\s—:])"
TOP_NUMBER = r"^(\d{1,2})(?:\.\d{1,2})*\.?(?=[\s—:])"
ABSTRACT = r"(?i)^abstract[.:]?$"
DATE = r"(?i)^(?:(?:\d{1,2}(?:st|nd|rd|th)?\s+)?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?(?:\s+\d{1,2}(?:st|nd|rd|th)?,?)?\s+\d{4}|\d{4}-\d{2}-\d{2})$"
EMAIL = r"[\w.}-]@[\w-]+\.[\w.]+"
CONTENTS_ENTRY = r"^(.*\S)\s+\d{1,4}$"
CAPTION = r"^(Figure|Fig\.|Table)\s*\d+"
FLOATED = r"^\s*(Figure|Fig\.|Table)\s*\d+[.:]"
BROKEN = r"(\p{L}+)-\s*$"
#: What can follow the hyphen there: blanks, and a line end before the text's end.
LAST_BLANKS = "\t\n\x0b\f\r \x85\u2028\u2029"
SECOND_BODY_LINES, SECOND_BODY_LENGTH, SECOND_BODY_SHARE, SECOND_BODY_ABOVE = 10, 40, 0.5, 2
#: Word endings that are never words of their own: a hyphen before one is a line break's.
ENDINGS = r"^(?:ing|ings|tions?|sions?|ity|ities|ments?|ness|able|ible|ics)(?!\p{L})"
#: A part of a compound counts as a word from so many letters.
MIN_PART = 4


def _doc() -> Window:
    return Window.partitionBy("doc_id")


def _order() -> Window:
    return _doc().orderBy("seq")


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


def with_keys(lines: DataFrame) -> DataFrame:
    """lines with size_key (half points), style_key (size and weight) and is_table."""
    size = _half_up(F.col("font_size") * 2)
    return lines.withColumns({"size_key": size, "style_key": size * 2 + F.col("bold").cast("int"), "is_table": F.col("table_id") >= 0})


KEYS = ("size_key", "style_key", "is_table")


def without_furniture(lines: DataFrame) -> DataFrame:
    """lines without running headers and footers.

    A line goes when it is at the top or bottom edge of its page (or rotated, with a word), its text - numbers made
    equal - is at that place of the edge of enough pages, or at the edge anywhere when the text has a word, and no
    other text of its page lies between it and the edge.
    """
    text = F.regexp_replace(F.lower(M.strip(F.col("text"))), r"\d+", "0")
    marked = lines.withColumns({
        "_at": _half_up(F.col("x") / X_BUCKET), "_table": F.col("table_id") >= 0, "_top": F.col("y") < F.col("page_height") / 2,
        "_edge": F.when(F.col("rotated"), F.col("text").rlike(WORD)).otherwise((F.col("y") < EDGE * F.col("page_height")) | (F.col("y") > (1 - EDGE) * F.col("page_height"))),
    })
    edge = F.col("_edge") & ~F.col("_table")
    # other lines are never counted, so that only those at an edge need a key
    marked = marked.withColumn("_text", F.when(F.coalesce(edge, F.lit(True)), text)).withColumn("_key", F.when(F.col("_text").rlike(ROMAN), "0").otherwise(F.col("_text"))).drop("_text")
    distinct_pages = lambda w, of=None: F.size(F.collect_set(F.when(of, F.col("page")) if of is not None else F.col("page")).over(w))
    least = F.greatest(F.lit(MIN_PAGES), F.ceil(PAGE_SHARE * F.col("_pages")))
    counted = marked.withColumns({"_pages": distinct_pages(_doc()), "_here": distinct_pages(Window.partitionBy("doc_id", "_key", "_at"), edge)})
    running = F.max(edge & (F.col("_here") >= least) & F.col("_key").rlike(WORD)).over(Window.partitionBy("doc_id", "_key"))
    known = counted.withColumn("_repeated", edge & ((F.col("_here") >= least) | running))
    other = F.col("_edge") & ~F.col("rotated") & ~F.col("_repeated")
    page = Window.partitionBy("doc_id", "page")
    nearest = known.withColumns({"_first": F.min(F.when(other & F.col("_top"), F.col("y"))).over(page), "_last": F.max(F.when(other & ~F.col("_top"), F.col("y"))).over(page)})
    outside = F.when(F.col("rotated"), True).when(F.col("_top"), F.col("_first").isNull() | (F.col("y") < F.col("_first") + SAME_BASELINE)).otherwise(F.col("_last").isNull() | (F.col("y") > F.col("_last") - SAME_BASELINE))
    return nearest.where(~(F.col("_repeated") & outside)).select(*lines.columns)


def attach_markers(lines: DataFrame) -> DataFrame:
    """lines in which a bullet that stands alone is put before the nearest line to its right on its height."""
    own = [c for c in lines.columns if c not in ("doc_id", "page")]
    pages = lines.groupBy("doc_id", "page").agg(F.collect_list(F.struct(*own)).alias("l"))
    alone = lambda s: s["text"].rlike(rf"^\s*[{BULLETS}]\s*$") & ~s["rotated"] & (s["table_id"] < 0)
    marks, others = F.filter("l", alone), F.filter("l", lambda s: ~alone(s))
    right = lambda m: F.filter("others", lambda s: ~s["rotated"] & (s["table_id"] < 0) & (s["x"] > m["x"]) & (F.abs(s["y"] - m["y"]) < 0.3 * m["font_size"]))
    target = lambda m: F.array_min(F.transform(right(m), lambda s: F.struct(s["x"].alias("x"), s["seq"].alias("seq"))))["seq"]
    placed = F.filter(F.transform("marks", lambda m: F.struct(target(m).alias("seq"), m["x"].alias("x"), M.strip(m["text"]).alias("bullet"), m["seq"].alias("mark"))), lambda m: m["seq"].isNotNull())
    split = pages.withColumns({"marks": marks, "others": others}).withColumn("placed", F.array_sort(placed))
    taken = F.transform("placed", lambda p: p["mark"])
    left = F.filter("marks", lambda m: ~F.array_contains("taken", m["seq"]))
    shown = split.withColumn("taken", taken).select("doc_id", "page", "placed", F.explode(F.concat("others", left)).alias("s"))
    # of several bullets the leftmost one stays
    bullet = F.get(F.filter("placed", lambda p: p["seq"] == F.col("s.seq")), F.lit(0))
    joined = shown.withColumn("b", F.when(F.size("placed") > 0, bullet))
    text = F.when(F.col("b").isNotNull(), F.concat("b.bullet", F.lit(" "), "s.text")).otherwise(F.col("s.text")).alias("text")
    fields = {c: F.col(f"s.{c}").alias(c) for c in own} | {"text": text, "x": F.coalesce("b.x", "s.x").alias("x")}
    return joined.select(*(fields.get(c, F.col(c)) for c in lines.columns))


def _gaps(lines: DataFrame) -> DataFrame:
    """lines with keys and gap: the distance from the line before, of the same size and page; null elsewhere."""
    before = F.lag(F.struct("page", "y", "size_key", "is_table")).over(_order())
    keyed = (lines if "size_key" in lines.columns else with_keys(lines)).withColumn("_b", before)
    b = F.col("_b")
    same = ~F.col("is_table") & ~b["is_table"] & (F.col("page") == b["page"]) & (F.col("y") > b["y"]) & (F.col("size_key") == b["size_key"])
    return keyed.withColumn("gap", F.when(same, F.col("y") - b["y"])).drop("_b")


def with_pitch(lines: DataFrame) -> DataFrame:
    """lines with keys and pitch: the upper median distance of consecutive lines of their size."""
    of_size = Window.partitionBy("doc_id", "size_key")
    ranked = _gaps(lines).withColumns({"_rank": F.row_number().over(of_size.orderBy(F.col("gap").asc_nulls_last())), "_n": F.count("gap").over(of_size)})
    middle = F.when(F.col("_rank") == F.floor(F.col("_n") / 2) + 1, F.col("gap"))
    return ranked.withColumn("pitch", F.max(middle).over(of_size)).drop("gap", "_rank", "_n")


def pitches(lines: DataFrame) -> DataFrame:
    """(doc_id, size_key, pitch) of the sizes that have one."""
    return with_pitch(lines).where("pitch is not null").groupBy("doc_id", "size_key").agg(F.max("pitch").alias("pitch"))


def _unfinished(last: Column) -> Column:
    """Whether a line fills its width and ends no sentence."""
    return (F.length(last) >= FULL_LINE) & ~last.rlike(SENTENCE_END) & ~last.rlike(TOC_ENTRY)


def with_facts(lines: DataFrame) -> DataFrame:
    """lines with keys and `facts`: what other lines ask of a line, without its text, so that windows carry little."""
    text = M.strip(F.col("text"))
    keyed = with_keys(lines).withColumn("_t", text)
    t = F.col("_t")
    own = {
        "open": _unfinished(t), "ended": t.rlike(SENTENCE_END), "hyphen": F.endswith(t, F.lit("-")), "lower": t.rlike(r"^\p{Ll}"), "item": F.col("text").rlike(LIST_ITEM), "blank": t == "",
        "numbered": F.col("bold") & t.rlike(SECTION_NUMBER), "few": (F.col("heading") > 0) & (F.size(F.split(t, r"\s+")) <= MAX_TAGGED_WORDS),
    }
    facts = F.struct("seq", "page", "x", "y", "size_key", "bold", "rotated", "is_table", "heading", *(v.alias(k) for k, v in own.items()))
    return keyed.withColumn("facts", facts).drop("_t")


def _goes_on(last: Column, line: Column) -> Column:
    """Whether a line carries on the sentence of the last one: in lower case, or after a hyphen. Both are facts."""
    return ~line["blank"] & (line["lower"] | last["hyphen"])


def with_notes(lines: DataFrame) -> DataFrame:
    """lines with keys, facts and note: whether the line is one of the smaller lines at the end of a page (footnotes) that a
    sentence passes, from the last line above them to the first line of the next page."""
    page = Window.partitionBy("doc_id", "page")
    own = lines if "facts" in lines.columns else with_facts(lines)
    # the line after the page is the one after its last line
    ends = own.withColumn("_after", F.lead("facts").over(_order())).withColumn("_then", F.max(F.struct("seq", F.col("_after").alias("f"))).over(page)["f"])
    above = F.max(F.when(F.col("is_table") | (F.col("size_key") >= F.col("_then.size_key")), F.col("facts"))).over(page)
    then, last = F.col("_then"), F.col("_above")
    carried = (
        (then["page"] == F.col("page") + 1) & ~then["is_table"] & ~last["is_table"] & (last["size_key"] == then["size_key"]) & (last["bold"] == then["bold"]) & last["open"] & ~then["item"] & _goes_on(last, then)
    )
    flagged = ends.withColumn("_above", above).withColumn("note", F.coalesce(carried & (F.col("seq") > last["seq"]), F.lit(False)))
    return flagged.drop("_after", "_then", "_above")


def with_paragraphs(lines: DataFrame) -> DataFrame:
    """lines with para: the paragraph's number in its document, from 1.

    A line begins a paragraph at a table, a page or column that doesn't go on with a sentence, another font size, the
    end of a bold numbered line or of a tagged heading, a gap wider than usual, or a first-line indent. A sentence goes on
    past the footnotes of its page: these are paragraphs of their own after it.
    """
    keyed = with_notes(with_pitch(with_facts(lines)))
    flow = Window.partitionBy("doc_id", "note").orderBy("seq")
    seen = keyed.withColumns({"_p": F.lag("facts").over(flow), "_n": F.lead(F.struct("page", "x", "y", "size_key")).over(flow)})
    size, now, p, n = F.col("font_size"), F.col("facts"), F.col("_p"), F.col("_n")
    shift, gap = now["x"] - p["x"], now["y"] - p["y"]
    follows = (now["size_key"] == p["size_key"]) & (now["bold"] == p["bold"]) & p["open"] & ~now["item"]
    hanging = p["item"] & (shift > 0) & (shift <= HANGING * size) & now["lower"]
    next_page = (now["page"] == p["page"] + 1) & follows & ((F.abs(shift) < INDENT * size) | hanging | _goes_on(p, now))
    next_column = ~now["rotated"] & ~p["rotated"] & (shift > 0) & follows & _goes_on(p, now)
    indented = (
        (n["page"] == now["page"]) & (n["size_key"] == now["size_key"]) & (n["y"] > now["y"]) & (shift > INDENT * size) & (F.abs(n["x"] - p["x"]) < INDENT * size) & ~p["item"] & p["ended"]
    )
    # null where the distance decides
    starts = (
        F.when(p.isNull() | now["is_table"] | p["is_table"], True)
        .when(p["few"] & (now["heading"] == 0), True)
        .when(now["page"] != p["page"], ~next_page)
        .when(gap <= 0, ~next_column)
        .when(now["size_key"] != p["size_key"], True)
        .when(p["numbered"] & ~now["bold"], True)
        .when(indented, True)
    )
    decided = seen.select(*lines.columns, *KEYS, "pitch", "note", starts.alias("_starts"), F.when((now["page"] == p["page"]) & (now["size_key"] == p["size_key"]), gap).alias("_gap"))
    c = F.col
    usual = lambda pitch: PARAGRAPH_GAP * F.greatest(MIN_PITCH * size, F.least(MAX_PITCH * size, F.coalesce(pitch, DEFAULT_PITCH * size)))
    numbered = decided.withColumn("_begins", F.coalesce("_starts", c("_gap") > usual(c("pitch"))))
    anchored = numbered.withColumn("_para", F.count_if(c("_begins") & ~c("note")).over(_order()))
    # footnotes of a paragraph have a pitch of their own
    of_notes = Window.partitionBy("doc_id", "note", "_para", "size_key")
    notes = Window.partitionBy("doc_id", "note", "_para").orderBy("seq")
    gaps = F.sort_array(F.collect_list(F.when(c("note") & (c("_gap") > 0), c("_gap"))).over(of_notes))
    own_pitch = F.get(gaps, F.floor(F.size(gaps) / 2).cast("int"))
    settled = anchored.withColumns({"_own_pitch": own_pitch, "_first": F.row_number().over(notes) == 1})
    begins = F.when(~c("note"), c("_begins")).when(c("_first"), True).otherwise(F.coalesce("_starts", c("_gap") > usual(c("_own_pitch"))))
    order = _doc().orderBy("_para", "note", "seq")
    return settled.withColumn("_begins", begins).withColumn("para", F.count_if("_begins").over(order).cast("int")).select(*(x for x in lines.columns if x not in KEYS), *KEYS, "para")


def _joined(lines: str) -> Column:
    """The text of a paragraph of such lines."""
    return F.array_join(F.transform(lines, lambda s: s["text"]), " ")


def paragraphs(lines: DataFrame) -> DataFrame:
    """One row for each paragraph of lines with para: its lines in order, text, page, keys, and what headings ask for. A
    sentence that captions or tables cut is one paragraph, and they follow it."""
    line = F.struct("seq", M.strip(F.col("text")).alias("text"), "x", "width", "bold", "heading", "page", "rotated", "size_key")
    own = F.sort_array(F.collect_list(line))
    first = lambda name: F.min_by(name, "seq").alias(name)
    grouped = lines.groupBy("doc_id", "para").agg(
        own.alias("lines"), *([F.first("bodies").alias("bodies")] if "bodies" in lines.columns else []), first("page"), first("size_key"), first("style_key"), first("font_size"), first("is_table"), first("table_id")
    )
    grouped = past_captions(grouped)
    tolerance = CENTRED * F.col("font_size")
    middle = lambda s: s["x"] + s["width"] / 2
    centred = (
        (F.size("lines") > 1)
        & F.forall("lines", lambda s: (s["width"] > 0) & (F.length(s["text"]) <= SHORT_LINE) & (F.abs(middle(s) - middle(F.col("lines")[0])) <= tolerance))
        & F.exists("lines", lambda s: F.abs(s["x"] - F.col("lines")[0]["x"]) > tolerance)
    )
    return grouped.withColumns({
        "text": _joined("lines"), "centred": centred, "all_bold": F.forall("lines", lambda s: s["bold"]),
        "least_heading": F.array_min(F.transform("lines", lambda s: s["heading"])), "most_heading": F.array_max(F.transform("lines", lambda s: s["heading"])),
    })


def past_captions(paras: DataFrame) -> DataFrame:
    """paragraphs in which one that captions or tables follow takes the lines of the next one after them, if that goes on
    with its sentence. One that was taken takes none itself."""
    c, start, end = F.col, F.col("lines")[0], F.element_at("lines", -1)
    said = lambda x: x["text"]
    edge = {
        "page": end["page"], "size_key": end["size_key"], "bold": end["bold"], "open": ~end["rotated"] & _unfinished(said(end)), "hyphen": F.endswith(said(end), F.lit("-")), "para": c("para"),
    }
    begin = {
        "page": start["page"], "size_key": start["size_key"], "bold": start["bold"], "letter": ~start["rotated"] & said(start).rlike(r"^\p{L}") & ~said(start).rlike(LIST_ITEM), "lower": said(start).rlike(r"^\p{Ll}"),
    }
    structs = {f"_{n}": F.struct(*(v.alias(k) for k, v in x.items())) for n, x in (("end", edge), ("start", begin))}
    marked = paras.withColumns(structs | {"_float": c("is_table") | said(start).rlike(FLOATED)})
    text = Window.partitionBy("doc_id", "_float").orderBy("para")
    before = marked.withColumns({"_before": F.lag("_end").over(text), "_at": F.row_number().over(text)})
    s, e = c("_start"), c("_before")
    goes = ~c("_float") & (c("para") - e["para"] > 1) & s["letter"] & e["open"] & (s["page"] - e["page"] <= 1) & (s["size_key"] == e["size_key"]) & (s["bold"] == e["bold"]) & (s["lower"] | e["hyphen"])
    # of a run of paragraphs that go on, every second one is taken
    known = before.withColumn("_goes", F.coalesce(goes, F.lit(False)))
    run = c("_at") - F.max(F.when(~c("_goes"), c("_at"))).over(text)
    taken = known.withColumn("_taken", c("_goes") & (run % 2 == 1))
    rest = F.lead(F.when(c("_taken"), c("lines"))).over(text)
    joined = taken.withColumn("_rest", rest).where(~c("_taken"))
    return joined.withColumn("lines", F.when(c("_rest").isNull() | c("_float"), c("lines")).otherwise(F.concat("lines", "_rest"))).select(*paras.columns)


def with_bodies(lines: DataFrame) -> DataFrame:
    """lines with bodies: the size keys of the body text, the one with the most characters (the larger of equal ones) first.

    A second one, at most a point larger, needs lines of its own: plain ones of some length, half the first one's
    characters in such lines, and as many changes between both from line to line of one column.
    """
    length = F.length(M.strip(F.col("text")))
    of_size = Window.partitionBy("doc_id", "size_key")
    keyed = with_keys(lines).withColumn("_n", F.sum(length).over(of_size))
    keyed = keyed.withColumn("_body", F.max(F.struct("_n", "size_key")).over(_doc())["size_key"])
    plain = (F.col("table_id") < 0) & ~F.col("rotated") & ~F.col("bold") & (length >= SECOND_BODY_LENGTH)
    seen = keyed.withColumn("_plain", plain)
    before = {f"_p_{c}": F.lag(c).over(_order()) for c in ("_plain", "size_key", "page", "x", "y", "font_size")}
    seen = seen.withColumns(before | {"_lines": F.count_if("_plain").over(of_size), "_weight": F.sum(F.when(F.col("_plain"), length).otherwise(0)).over(of_size)})
    c = F.col
    size = F.greatest("font_size", "_p_font_size")
    changes = c("_plain") & c("_p__plain") & (c("page") == c("_p_page")) & (c("y") > c("_p_y")) & (c("y") - c("_p_y") <= 1.5 * size) & (F.abs(c("x") - c("_p_x")) <= 0.5 * size) & (c("size_key") != c("_p_size_key"))
    other = F.when(changes & (c("_p_size_key") == c("_body")), c("size_key")).when(changes & (c("size_key") == c("_body")), c("_p_size_key"))
    first = {f"_first{n}": F.max(F.when(c("size_key") == c("_body"), c(n))).over(_doc()) for n in ("_lines", "_weight")}
    counted = seen.withColumns(first | {"_other": other})
    near = (c("size_key") > c("_body")) & (c("size_key") <= c("_body") + SECOND_BODY_ABOVE) & (c("_first_lines") >= SECOND_BODY_LINES) & (c("_lines") >= SECOND_BODY_LINES) & (c("_weight") >= SECOND_BODY_SHARE * c("_first_weight"))
    # two sizes can be that near; the changes of each are counted over the document
    seconds = [F.count_if((c("_other") == c("_body") + k)).over(_doc()) >= SECOND_BODY_LINES for k in range(1, SECOND_BODY_ABOVE + 1)]
    fits = [F.max(near & (c("size_key") == c("_body") + k)).over(_doc()) & enough for k, enough in enumerate(seconds, 1)]
    more = F.array_compact(F.array(*(F.when(ok, c("_body") + k) for k, ok in enumerate(fits, 1))))
    return counted.withColumn("bodies", F.concat(F.array("_body"), F.coalesce(more, F.array().cast("array<int>")))).select(*(x for x in lines.columns if x != "bodies"), "bodies")


def body_sizes(lines: DataFrame) -> DataFrame:
    """(doc_id, body, bodies): the first size key of the body text, and all."""
    return with_bodies(lines).groupBy("doc_id").agg(F.first("bodies").alias("bodies")).select("doc_id", F.col("bodies")[0].alias("body"), "bodies")


def section_depth(text: Column) -> Column:
    """0 for text without a section number, 1 for `2` and `A.`, 2 for `2.1`, ..."""
    number = F.regexp_extract(text, SECTION_NUMBER, 0)
    dots = F.coalesce(*(F.nullif(F.regexp_extract(text, SECTION_NUMBER, k), F.lit("")) for k in (1, 2, 3)), F.lit(""))
    return F.when(number == "", 0).otherwise(1 + F.length(dots) - F.length(F.replace(dots, F.lit("."), F.lit(""))))


def with_headings(paras: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """paragraphs with level: 0, or the level of a heading.

    Short paragraphs in a larger font, or bold and numbered, that body text or another heading follows; without
    entries of a table of contents, numbers out of sequence, dates, and authors. bodies: (doc_id, bodies), where the
    paragraphs don't have them.
    """
    order = _doc().orderBy("para")
    # a heading has at most MAX_LENGTH characters, and what is asked of other texts is asked once: of a paragraph's text the rows
    # that are sorted hold its lines only
    c, whole, text = F.col, F.col("text"), F.col("_short")
    known = paras if bodies is None else paras.join(bodies.select("doc_id", "bodies"), "doc_id", "left")
    of_text = {
        "_short": F.when(F.length(whole) <= MAX_LENGTH, whole), "numbered": whole.rlike(SECTION_NUMBER), "_email": F.contains(whole, F.lit("@")) & whole.rlike(EMAIL),
        "_abstract": (F.size("lines") == 1) & ~c("is_table") & (F.length(whole) <= MAX_LENGTH) & whole.rlike(ABSTRACT),
        "_tagged": (c("least_heading") > 0) & (F.size("lines") <= MAX_LINES) & (F.size(F.split(whole, r"\s+")) <= MAX_TAGGED_WORDS) & ~F.endswith(whole, F.lit(".")) & ~whole.rlike(CAPTION),
    }
    asked_once = known.withColumns(of_text | {"body": F.array_max("bodies")}).drop("text")
    base = asked_once.withColumns({"n_size": F.lead("size_key").over(order), "_n_email": F.lead("_email").over(order), "index": F.row_number().over(order)}).drop("_email")
    titled = (c("page") == 1) & ((c("size_key") >= TITLE_RATIO * c("body")) | ((c("index") == 1) & (c("size_key") >= FIRST_TITLE_RATIO * c("body"))))
    candidate = (
        ~c("is_table") & ((c("size_key") > c("body")) | (c("numbered") & c("all_bold") & (c("size_key") >= c("body") - BELOW_BODY)))
        & (F.size("lines") <= F.when((c("size_key") >= TITLE_RATIO * c("body")) | c("centred"), MAX_TITLE_LINES).otherwise(MAX_LINES))
        & text.isNotNull() & (c("numbered") | text.rlike(WORD)) & ~text.rlike(DOT_LEADER)
    )
    followed = c("n_size").isNull() | titled | F.array_contains("bodies", c("n_size"))
    # a candidate is a heading when the run of candidates from it on ends in a followed one
    decided = base.withColumns({"candidate": candidate, "followed": followed}).withColumn(
        "heading", F.col("candidate") & F.coalesce(F.first(F.when(c("followed") | ~c("candidate"), c("candidate")), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)), F.lit(False))
    )
    entry = F.when(c("heading"), F.regexp_extract(text, CONTENTS_ENTRY, 1)).otherwise("")
    # a later paragraph with the text of an entry: paragraphs and entries meet by text
    is_entry = c("heading") & (entry != "")
    both = F.when(is_entry, F.array(F.struct(F.lit(False).alias("asks"), text.alias("key")), F.struct(F.lit(True).alias("asks"), entry.alias("key")))).otherwise(F.array(F.struct(F.lit(False).alias("asks"), text.alias("key"))))
    met = decided.withColumn("_k", F.explode(both)).withColumn("_last", F.max(F.when(~c("_k.asks"), c("para"))).over(Window.partitionBy("doc_id", "_k.key")))
    met = met.withColumn("_entry", F.max(c("_k.asks") & (F.coalesce("_last", F.lit(0)) > c("para"))).over(Window.partitionBy("doc_id", "para")))
    decided = met.where(~c("_k.asks")).withColumn("heading", c("heading") & ~c("_entry"))
    # a number below one before it is out of sequence; headings without any number start anew. Runs are told apart by
    # their count, which outweighs any number
    number = F.when(c("heading"), F.regexp_extract(text, TOP_NUMBER, 1)).otherwise("")
    decided = decided.withColumn("_top", F.when(c("heading") & (number != ""), number.cast("int")))
    decided = decided.withColumn("_run", 1000 * F.count_if(c("heading") & c("_top").isNull() & ~c("numbered")).over(order))
    gone = c("_run") + c("_top") < F.max(c("_run") + c("_top")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    decided = decided.withColumn("_gone", F.coalesce(gone, F.lit(False))).withColumn("heading", c("heading") & ~c("_gone") & ~text.rlike(DATE))
    first = F.min(F.when(c("heading"), c("para"))).over(_doc())
    decided = decided.withColumns({"_first": first, "_next": F.lead("heading").over(order), "_page1": F.max(F.when(c("para") == first, c("page"))).over(_doc())})
    authors = (c("para") == c("_first") + 1) & (c("_page1") == 1) & ~F.coalesce("_next", F.lit(True)) & c("_n_email")
    abstract = c("_abstract") & ((c("page") <= ABSTRACT_PAGES) | c("all_bold"))
    decided = decided.withColumn("heading", (c("heading") & ~F.coalesce(authors, F.lit(False))) | abstract)
    tagged = ~c("heading") & c("_tagged")
    # levels: by number, else that of numbered headings in the same style, else by the rank of the style
    depth = F.when(c("heading"), section_depth(text)).otherwise(0)
    own = F.when(depth > 0, F.least(F.lit(MAX_LEVEL), depth + 1))
    styled = decided.withColumns({"tagged": tagged, "own": own}).withColumn("by_style", F.min("own").over(Window.partitionBy("doc_id", "style_key")))
    ranked = styled.withColumn("_plain", c("heading") & c("own").isNull() & c("by_style").isNull())
    ranks = F.dense_rank().over(_doc().orderBy(F.when(c("_plain"), c("style_key")).desc_nulls_last()))
    level = F.when(c("tagged"), c("least_heading")).when(c("heading"), F.coalesce("own", "by_style", F.least(F.lit(MAX_LEVEL), ranks))).otherwise(0)
    leveled = ranked.withColumn("level", level)
    leveled = leveled.withColumns({"_one": F.max((c("level") == 1).cast("int")).over(_doc()), "_top": F.min(F.when(c("level") > 0, c("para"))).over(_doc())})
    leveled = leveled.withColumn("level", F.when((c("_one") == 0) & (c("para") == c("_top")) & (c("page") == 1) & ~c("numbered"), 1).otherwise(c("level")))
    # no skipped levels: a level is at most the one shown before it, and one more where it is deeper than the one before it.
    # That is the number of such steps so far, and the least that any level so far had less of them
    before = F.last(F.when(c("level") > 0, c("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    stepped = leveled.withColumn("_was", before).withColumn("_steps", F.count_if((c("level") > 0) & (c("level") > c("_was"))).over(order))
    least = F.min(F.when(c("level") > 0, c("level") - c("_steps"))).over(order)
    leveled = stepped.withColumn("level", F.when(c("level") > 0, c("_steps") + least).otherwise(0).cast("int"))
    return leveled.withColumn("text", _joined("lines")).select(*paras.columns, "level")


def may_break(line: Column) -> Column:
    """Whether a line's last character is a hyphen, a blank or a line end: of all others `BROKEN` fits none, and looking is cheap."""
    return functools.reduce(Column.__or__, (F.endswith(line, F.lit(x)) for x in "-" + LAST_BLANKS))


def _broken(line: Column) -> Column:
    """The part of a word that a line's end breaks, or nothing."""
    return F.when(may_break(line), F.regexp_extract(line, BROKEN, 1)).otherwise("")


def words(lines: DataFrame) -> DataFrame:
    """(doc_id, words) of documents with a word that a line's end breaks: their words in lower case, their compounds, these'
    longer parts, and words that are broken before an ending."""
    asks = F.max(_broken(F.col("text")) != "").over(_doc())
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+(?:-\p{L}+)*)"), F.lit(1))
    parts = F.flatten(F.transform(F.filter("f", lambda w: F.contains(w, F.lit("-"))), lambda w: F.filter(F.split(w, "-"), lambda x: F.length(x) >= MIN_PART)))
    following = F.lead(F.ltrim(M.strip(F.col("text")))).over(_order())
    head, tail = _broken(F.col("text")), F.regexp_extract("_next", r"^(\p{Ll}\p{L}*)", 1)
    broken = F.when((head != "") & F.col("_next").rlike(ENDINGS), F.array(F.lower(F.concat(head, tail)))).otherwise(F.array().cast("array<string>"))
    every = lines.withColumn("_asks", asks).where("_asks").withColumn("_next", following).withColumn("f", found).select("doc_id", F.explode(F.concat("f", parts, broken)).alias("w"))
    return every.groupBy("doc_id").agg(F.collect_set("w").alias("words"))


def asked(parts: Column) -> Column:
    """The words that `join_hyphens` looks up for the lines of a paragraph: for a head at a line's end and the tail below it
    their compound, the whole and the tail. A line of one broken word can end in either form of what it makes."""

    def step(s: Column, line: Column) -> Column:
        here = F.ltrim(line)
        tail, token = F.regexp_extract(here, r"^(\p{Ll}\p{L}*)", 1), F.regexp_extract(here, r"^(\S*)", 1)
        meets = (F.size(s["heads"]) > 0) & (tail != "")
        more = F.flatten(F.transform(s["heads"], lambda h: F.array(F.lower(F.concat(h, F.lit("-"), tail)), F.lower(F.concat(h, tail)), F.lower(tail))))
        end = _broken(line)
        ends = F.when(end != "", F.array(end)).otherwise(F.array().cast("array<string>"))
        longer = F.when(meets & (M.strip(here) == token) & token.rlike(r"^\p{L}+-$"), F.transform(s["heads"], lambda h: F.concat(h, end))).otherwise(F.array().cast("array<string>"))
        kept = F.struct(F.when(line == "", s["heads"]).otherwise(F.array_distinct(F.concat(ends, longer))).alias("heads"), F.when(meets, F.concat(s["asks"], more)).otherwise(s["asks"]).alias("asks"))
        return kept

    none = F.array().cast("array<string>")
    return F.when(F.exists(parts, may_break), F.aggregate(parts, F.struct(none.alias("heads"), none.alias("asks")), step)["asks"]).otherwise(none)


def join_hyphens(parts: Column, known: Column, dictionary: Column | None = None) -> Column:
    """The lines of a paragraph as one text: a word broken at a line end moves up to its head, with its hyphen where the
    compound is known (to the document) or nothing is, without where the whole is known or the tail is a mere ending."""

    def step(done: Column, line: Column) -> Column:
        here = F.ltrim(line)
        head = _broken(done)
        tail = F.regexp_extract(here, r"^(\p{Ll}\p{L}*)", 1)
        compound, whole = F.lower(F.concat(head, F.lit("-"), tail)), F.lower(F.concat(head, tail))
        joined = F.array_contains(known, whole) | here.rlike(ENDINGS)
        if dictionary is not None:
            joined = joined | (F.array_contains(dictionary, whole) & ~F.array_contains(dictionary, F.lower(tail)))
        joined = joined & ~F.array_contains(known, compound)
        up = F.concat(F.regexp_replace(done, r"\s+$", ""), F.regexp_extract(here, r"^(\S*)", 1))
        up = F.when(joined, F.concat(F.regexp_replace(done, r"-\s*$", ""), F.regexp_extract(here, r"^(\S*)", 1))).otherwise(up)
        rest = M.strip(F.regexp_replace(here, r"^\S*", ""))
        return (
            F.when(done == "", line).when(line == "", done).when((head != "") & (tail != ""), F.when(rest == "", up).otherwise(F.concat(up, F.lit("\n"), M.escape(rest))))
            .otherwise(F.concat(done, F.lit("\n"), line))
        )

    # without such an end the lines stay as they are
    return F.when(F.exists(parts, may_break), F.aggregate(parts, F.lit(""), step)).otherwise(F.array_join(F.filter(parts, lambda x: x != ""), "\n"))


def join_split_links(lines: Column) -> Column:
    """Lines as one text, in which links to one address that follow each other over a line end are one link."""

    def step(done: Column, line: Column) -> Column:
        before = F.regexp_extract(done, r"\[[^\[\]\n]*\]\(([^()\s]+)\)$", 1)
        same = (before != "") & (before == F.regexp_extract(line, r"^\[[^\[\]\n]*\]\(([^()\s]+)\)", 1))
        longer = F.concat(F.regexp_replace(done, r"\]\([^()\s]+\)$", ""), F.lit(" "), F.substr(line, F.lit(2)))
        return F.when(done.isNull(), line).when(same, longer).otherwise(F.concat(done, F.lit("\n"), line))

    return F.coalesce(F.aggregate(lines, F.lit(None).cast("string"), step), F.lit(""))


def bullets(text: Column) -> Column:
    """A list item's bullet as a dash."""
    return F.regexp_replace(text, rf"^(\s*)[{BULLETS}]\s*", "$1- ")


def to_markdown(lines: DataFrame, tables: DataFrame | None = None, dictionary: DataFrame | Column | None = None, tasks: int = 0, broken: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown) of lines; tables: (doc_id, table_id, markdown) for lines that stand for a table; dictionary: words
    of the language, for hyphens at line ends, as an array of them in lower case or as a table of one column in any case;
    tasks: the number of tasks where it is more than one, so that the memory of one doesn't grow with the input; broken: the
    lines of all documents with a line that may break a word, where they are known, so that no others are searched for words.

    A document without lines has no row. Null texts count as empty lines and are dropped; equal documents give
    equal results whatever their doc_id.
    """
    dealt = lambda df: df.where("text is not null and doc_id is not null").repartition(*([tasks] if tasks > 1 else []), "doc_id")
    given = dealt(lines)
    own = without_furniture(attach_markers(given))
    paras = with_headings(paragraphs(with_paragraphs(with_bodies(own))))
    c = F.col
    block = F.struct("para", "level", "is_table", "table_id", "text", F.transform("lines", lambda s: s["text"]).alias("lines"))
    docs = paras.groupBy("doc_id").agg(F.sort_array(F.collect_list(block)).alias("paras"))
    # a heading is its text; other lines with a dash for a bullet and whole links
    shown_line = lambda x: M.escape(bullets(x))
    linked = lambda x: F.contains(x, F.lit("](")) | F.contains(x, F.lit("\n"))
    body = lambda ls: F.when(F.exists(ls, linked), F.split(join_split_links(F.transform(ls, shown_line)), "\n")).otherwise(F.transform(ls, shown_line))
    plain = lambda p: F.when(p["is_table"] | (p["level"] > 0), F.array(M.escape(p["text"]))).otherwise(body(p["lines"]))
    docs = docs.withColumn("paras", F.transform("paras", lambda p: p.withField("lines", plain(p))))
    docs = docs.withColumn("asks", F.array_distinct(F.flatten(F.transform("paras", lambda p: asked(p["lines"])))))
    none = F.array().cast("array<string>")
    docs = docs.join(words(given if broken is None else dealt(broken)), "doc_id", "left").withColumn("known", F.array_intersect("asks", F.coalesce("words", none))).drop("words")
    of_language: Column | None = None
    scratch: tuple[str, ...] = ()
    if isinstance(dictionary, DataFrame):
        kept = written(docs, "layout")
        docs, of_language, scratch = _looked_up(kept, dictionary), c("found"), kept.scratch
    elif dictionary is not None:
        of_language = F.array_intersect("asks", dictionary)
    if tables is not None:
        # one row for each document: the paragraphs stay where they are
        of_doc = tables.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("table_id", "markdown"))).alias("tables"))
        docs = docs.join(of_doc, "doc_id", "left")
    docs = docs.withColumn("of_language", none if of_language is None else of_language)

    def shown(p: Column) -> Column:
        body = F.when(p["level"] > 0, F.concat(F.repeat(F.lit("#"), p["level"]), F.lit(" "), p["lines"][0])).otherwise(join_hyphens(p["lines"], c("known"), c("of_language")))
        return body if tables is None else F.when(p["is_table"], F.coalesce(c("tables")[p["table_id"]], F.lit(""))).otherwise(body)

    joined = F.array_join(F.filter(F.transform("paras", shown), lambda x: x != ""), "\n\n")
    # explode_outer: a filter on the text itself would compute it once more
    out = docs.select("doc_id", F.explode_outer(F.filter(F.array(joined), lambda x: x != "")).alias("m")).where("m is not null").select("doc_id", M.normalize(M.escape_tags_outside_links(F.col("m"))).alias("markdown"))
    out.scratch = scratch
    return out


def _looked_up(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """docs, a table, with `found`: those of their asks that the dictionary has. The asks are a few words of each document; Spark
    broadcasts the dictionary while it is below its limit for that, and shuffles both beyond it."""
    table = dictionary.select(F.lower(F.col(dictionary.columns[0])).alias("word")).where("word is not null").distinct()
    found = docs.select("doc_id", F.explode("asks").alias("word")).join(table, "word", "left_semi").groupBy("doc_id").agg(F.collect_set("word").alias("found"))
    return docs.join(found, "doc_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
