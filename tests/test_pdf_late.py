"""Late text of PDF pages."""

import time

import pytest

from docmd.sources import pdflate
from docmd.sources.pdfblocks import Word
from tests.test_convert import convert, pdf, shown


def line(y, *words, size=10.0, page=1, text=None, **more):
    """A line of (text, left, right)."""
    own = [Word(left, right, t) for t, left, right in words]
    return {"page": page, "page_height": 792.0, "x": own[0].left, "y": y, "width": own[-1].right - own[0].left, "font_size": size, "bold": False, "rotated": False,
            "text": text or " ".join(w.text for w in own), "table_id": -1, "heading": 0, "words": own} | more


def texts(*lines):
    return [x["text"] for x in pdflate.in_reading_order(list(lines))]


BAKED = line(50, ("Bread", 50, 75), ("is", 110, 118), ("baked", 121, 146))


@pytest.mark.parametrize(("late", "expected"), [
    (line(50, ("[rye]", 78, 104)), "Bread [rye] is baked"),
    (line(50, ("[rye]", 75.2, 109.8), text="[\\[rye\\]](http://x.org)") | {"words": [Word(75.2, 109.8, "[rye]")]}, "Bread[\\[rye\\]](http://x.org)is baked"),
    (line(50, ("daily", 149, 170)), "Bread is baked daily"), (line(50, ("3.", 36, 46)), "3. Bread is baked"), (line(50, ("(White)", 20, 49.5)), "(White)Bread is baked"),
    (line(50, ("rye", 80, 95), ("daily", 149, 170)), "Bread rye is baked daily"), (line(50, ("MAY", 80, 104), size=9.0), "Bread MAY is baked"), (line(50, ("2)", 40, 47), size=9.0), "2) Bread is baked"),
])
def test_late_words_take_their_seats(late, expected):
    assert texts(BAKED, line(62, ("Next", 50, 70)), late) == [expected, "Next"]


@pytest.mark.parametrize("late", [
    line(50, ("rye", 100, 115)), line(50, ("far", 153, 170)), line(50, ("row", 30, 46)), line(50.2, ("rye", 80, 95)), line(50, ("daily", 149, 170), size=9.0), line(50, ("rye", 80, 95), size=8.0),
    line(50, ("rye", 80, 95), rotated=True), line(50, ("rye", 80, 95), page=2), line(50, ("•", 38, 42)),
])
def test_late_words_without_a_seat_stay_apart(late):
    assert sorted(texts(BAKED, late)) == sorted([BAKED["text"], late["text"]])


def test_joined_lines_are_wider():
    (x,) = pdflate.in_reading_order([BAKED, line(50, ("3.", 36, 46)), line(50, ("daily", 149, 170))])
    assert (x["x"], x["width"], [w.text for w in x["words"]]) == (36, 134, ["3.", "Bread", "is", "baked", "daily"])


def test_a_broken_word_stays_with_its_rest():
    late, rest = line(50, ("bak-", 149, 165)), line(62, ("ing", 50, 62))
    formula = line(48, ("x", 149, 152), size=7.0)
    assert texts(BAKED, formula, late, rest)[:2] != ["Bread is baked bak-", "x"] and texts(BAKED, late, rest)[0] == "Bread is baked bak-"
    assert texts(BAKED, *(line(48 + k, ("x", 300, 303), size=7.0) for k in (0.3, 0.6, 0.9)), late, rest)[0] == "Bread is baked bak-"
    assert texts(BAKED, formula, late, line(62, ("Ing", 50, 62)))[0] == "Bread is baked bak-"


def test_pieces_are_woven():
    stops = line(50, ("and", 118, 130), (",", 190, 193), (",", 240, 243))
    names = line(50, ("Rye", 80, 95), ("A.", 100, 110), ("Oats", 135, 160), ("B.", 165, 189.6), ("Bread", 196, 240))
    assert texts(line(38, ("before", 50, 80)), stops, names) == ["before", "Rye A. and Oats B., Bread,"]
    # the piece with more words keeps its place
    assert texts(names, line(70, ("after", 50, 80)), stops) == ["Rye A. and Oats B., Bread,", "after"]
    linked = stops | {"text": "[and](http://x.org), ,"}
    assert len(texts(linked, names)) == 2
    assert len(texts(line(50, ("left", 50, 70), ("side", 260, 282)), line(50, ("right", 306, 330), ("side", 520, 545)))) == 2


def test_labels_go_to_their_entries():
    label = lambda y, t: line(y, (t, 50, 80))
    entry = lambda y, t: line(y, (t, 90, 120), ("bread", 123, 150))
    heading = line(30, ("References", 50, 110), size=14.0)
    assert texts(label(50, "[A1]"), label(80, "[B2]"), heading, entry(50, "Rye"), entry(80, "Oat")) == ["References", "[A1] Rye bread", "[B2] Oat bread"]
    # no entry, and one that is too far
    assert texts(label(50, "[A1]"), line(50, ("Rye", 100, 120), ("bread", 123, 150))) == ["[A1]", "Rye bread"]


def test_whole_lines_go_between_two_others():
    first, third, fourth = line(50, ("one", 50, 70)), line(74, ("three", 50, 70)), line(86, ("four", 50, 70))
    second, more = line(58, ("two", 50, 70)), line(66, ("and", 60, 80))
    assert texts(first, third, fourth, second, more) == ["one", "two", "and", "three", "four"]
    assert texts(first, third, fourth, line(62, ("column", 300, 330))) == ["one", "three", "four", "column"]
    assert texts(first, third, fourth, line(62, ("small", 50, 70), size=8.0)) == ["one", "three", "four", "small"]
    far = [line(74 + 12 * k, (f"w{k}", 50, 70)) for k in range(7)]
    assert texts(first, *far, second)[-1] == "two" and texts(first, *far[:6], second)[1] == "two"


def test_lines_above_the_page_go_to_its_top():
    header, body = line(20, ("Header", 50, 80)), [line(100, ("one", 50, 70)), line(112, ("two", 50, 70))]
    items = [line(60, ("9.", 60, 70)), line(72, ("10.", 58, 70))]
    assert texts(header, *body, *items) == ["Header", "9.", "10.", "one", "two"]
    assert pdflate.in_reading_order([]) == []
    assert texts(header, *body, line(60, ("right", 80, 95))) == ["Header", "one", "two", "right"]
    assert texts(line(55, ("near", 50, 80)), *body, line(60, ("9.", 60, 70))) == ["near", "one", "two", "9."]


def test_hostile_pages_are_linear():
    began = time.perf_counter()
    wide = line(50, *(("w", 100 + 10 * k, 106 + 10 * k) for k in range(50_000)))
    assert pdflate.in_reading_order([wide, *(line(50, ("[a]", 60 - k * 1e-4, 90 - k * 1e-4)) for k in range(30_000))])
    assert len(pdflate.in_reading_order([line(400_000 - 2.0 * k, ("w", 50, 56), size=1.0) for k in range(60_000)])) == 60_000
    assert time.perf_counter() - began < 20


def test_late_text_of_files(spark):
    """A table's last column, list numbers and a heading that come after the rest of their page."""
    rows = [(72, 700, "Rye bread is"), (72, 688, "Oat bread is"), (72, 676, "It was baked on a Monday morning.")]
    page = shown(*((x, y, t, 10, "F1") for x, y, t in rows), (134, 700, "dark", 10, "F1"), (134, 688, "pale", 10, "F1"), (72, 724, "Bread", 14, "F1"))
    out = convert(spark, [("a.pdf", pdf([page]), None)])[0].markdown
    assert out == "# Bread\n\nRye bread is dark\nOat bread is pale\nIt was baked on a Monday morning.\n"
