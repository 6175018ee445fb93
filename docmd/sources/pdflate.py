"""Text that a page's content brings late, put where it is read.

Links, list numbers and labels are often drawn after the rest of a page. A line's words are extents on its baseline, so a
late line either has a seat for each of its words - a gap between two words of an earlier line, or its ends - or it is a piece
that interleaves with another one, or it is a line of its own that belongs between two others. All work is on a page, and an
index of baselines and bounded looks back keep it linear in the page's lines.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby, pairwise

from docmd.operators import layout as L
from docmd.sources.pdfblocks import Word

# Fixed values, in points: one baseline, overlap of words. In font sizes: a space, what is near a line's end, a label's
# distance from its entry, the indent of a page's first lines.
SAME_BASELINE, SLACK, SPACE, NEAR_END, NEAR_PIECE, TOP_INDENT = 0.1, 0.5, 0.1, 0.5, 1.5, 2.0
# Fixed values, counts: lines of a baseline that are tried, lines back that a whole line goes, lines of a page of which one
# goes to the top, words of a line, lines that a formula puts in between.
MAX_TRIES, LOOK_BACK, MAX_PAGE_LINES, MAX_WORDS, FEW_LINES = 8, 6, 300, 300, 2
_MARKER, _LABEL, _SPLIT = re.compile(rf"[{L.BULLETS}]|[0-9]+[.)]"), re.compile(r"\[[^\]\s]+\]"), re.compile(r"(?:^|\s)[^\W\d_]+-\s*$")
_BULLET = re.compile(rf"\s*[{L.BULLETS}]\s*")


def _size(line: dict) -> int:
    return int(line["font_size"] * 2 + 0.5)


def _free(line: dict) -> bool:
    """Whether late text may move into, or with, a line."""
    return line["table_id"] < 0 and not line["rotated"] and bool(line["words"])


def _is_label(line: dict) -> bool:
    return len(line["words"]) == 1 and bool(_LABEL.fullmatch(line["text"].strip()))


def _is_plain(line: dict) -> bool:
    """Whether a line's text is its words and nothing else, such as a link's address."""
    return " ".join(line["text"].split()) == " ".join(w.text for w in line["words"])


def _blank(left: Word, right: Word, size: float) -> str:
    return " " if right.left - left.right > SPACE * size else ""


def _grown(line: dict, start: dict, other: dict, text: str, words: list[Word]) -> dict:
    """line with text and words that it shares with other; start: which of both begins it."""
    end = max(x["x"] + x["width"] for x in (line, other))
    return line | {"x": start["x"], "width": end - start["x"], "text": text, "words": words}


def _between(line: dict) -> list[str] | None:
    """What a line's text has before, between and after its words."""
    found, at = [], 0
    for w in line["words"]:
        start = line["text"].find(w.text, at)
        if start < 0:
            return None
        found.append(line["text"][at:start])
        at = start + len(w.text)
    return [*found, line["text"][at:]]


def _seats(words: list[Word], late: list[Word]) -> list[int] | None:
    """The word that each late one goes before (their number: after the last); None where one has no room."""
    lefts, out = [w.left for w in words], []
    for w in late:
        if w.right <= lefts[0] + SLACK:
            seat = 0
        elif w.left >= words[-1].right - SLACK:
            seat = len(words)
        else:
            seat = bisect_left(lefts, w.right - SLACK)
            if seat in (0, len(words)) or w.left < words[seat - 1].right - SLACK:
                return None
        out.append(seat)
    return out if out == sorted(out) else None


def seated(line: dict, late: dict, at_end: bool = True) -> dict | None:
    """line with the words of late in its gaps or at its ends; None where they don't fit.

    Before the first word stands only a list number, or what touches it; after the last one (at_end) what is near. Text of
    another size goes between words only, or is a list number.
    """
    words, new, size, last = line["words"], late["words"], late["font_size"], len(line["words"])
    seats = _seats(words, new)
    parts = _between(line)
    if seats is None or parts is None or (last in seats and not at_end):
        return None
    whole = len(set(seats)) == 1
    if not whole and not _is_plain(late):
        return None
    if _size(line) != _size(late) and any(s == last or (s == 0 and not _MARKER.fullmatch(w.text)) for s, w in zip(seats, new, strict=True)):
        return None
    for seat, group in groupby(zip(seats, new, strict=True), key=lambda p: p[0]):
        run = [w for _, w in group]
        reach = [*run, words[0]] if seat == 0 else [words[-1], *run] if seat == last else []
        if parts[seat].strip() or any(b.left - a.right > NEAR_END * size for a, b in pairwise(reach)):
            return None
        if seat == 0 and not _MARKER.fullmatch(run[0].text) and _blank(run[-1], words[0], size):
            return None
        shown = late["text"].strip() if whole else " ".join(w.text for w in run)
        parts[seat] = (_blank(words[seat - 1], run[0], size) if seat else "") + shown + (_blank(run[-1], words[seat], size) if seat < last else "")
    text = "".join(p + w.text for p, w in zip(parts, words, strict=False)) + parts[-1]
    return _grown(line, late if seats[0] == 0 else line, late, text, sorted([*words, *new], key=lambda w: w.left))


def woven(a: dict, b: dict) -> dict | None:
    """Two pieces of a baseline as one line, by their words' places: pieces that go between each other, or a label and the
    entry at its right. None where words overlap, or the pieces are two lines side by side."""
    left, right = (a, b) if a["x"] <= b["x"] else (b, a)
    size = max(a["font_size"], b["font_size"])
    words = sorted([*a["words"], *b["words"]], key=lambda w: w.left)
    if any(y.left < x.right - SLACK for x, y in pairwise(words)):
        return None
    end, start = left["words"][-1], right["words"][0]
    if start.left >= end.right - SLACK:
        if not _is_label(left) or start.left - end.right > NEAR_PIECE * size:
            return None
        text = left["text"].strip() + _blank(end, start, size) + right["text"].strip()
    elif _is_plain(a) and _is_plain(b):
        text = words[0].text + "".join(_blank(x, y, size) + y.text for x, y in pairwise(words))
    else:
        return None
    body, other = (a, b) if len(a["words"]) >= len(b["words"]) else (b, a)
    return _grown(body, left, other, text, words)


def _baseline(line: dict) -> int:
    return math.floor(line["y"] * 10 + 0.5)


def _newest(index: dict[int, list[int]], line: dict) -> list[int]:
    """The last few lines on, or next to, a line's baseline, newest first."""
    near = [k for key in range(_baseline(line) - 1, _baseline(line) + 2) for k in index.get(key, [])[-MAX_TRIES:]]
    return sorted(near, reverse=True)[:MAX_TRIES]


def _goes_on(line: dict, following: dict | None) -> bool:
    """Whether a line ends in a broken word that the following one carries on."""
    return following is not None and bool(_SPLIT.search(line["text"])) and following["text"].lstrip()[:1].islower()


def _on_baselines(lines: list[dict], after: dict | None) -> list[dict]:
    """The lines of a page, with late words and pieces in the lines on their baselines. after: the next page's first line."""
    out: list[dict | None] = []
    index: dict[int, list[int]] = {}
    for late, following in zip(lines, [*lines[1:], after], strict=True):
        near = [(k, out[k]) for k in _newest(index, late)] if _free(late) else []
        near = [(k, x) for k, x in near if x and _free(x) and len(x["words"]) <= MAX_WORDS and abs(x["y"] - late["y"]) < SAME_BASELINE]
        joined = None
        if not _BULLET.fullmatch(late["text"]):
            for k, x in near:
                if _size(x) == _size(late) or abs(x["font_size"] - late["font_size"]) <= 1:
                    # a broken word stays with its rest past a formula's few lines, not past a whole entry
                    passed = len(out) - 1 - k
                    joined = seated(x, late, passed == 0 or passed > FEW_LINES or not _goes_on(late, following))
                    if joined:
                        out[k] = joined
                        break
        if not joined and len(late["words"]) <= MAX_WORDS:
            for k, x in near:
                joined = woven(x, late) if _size(x) == _size(late) else None
                if joined and len(x["words"]) >= len(late["words"]):
                    out[k] = joined
                elif joined:
                    out[k] = None
                    index.setdefault(_baseline(joined), []).append(len(out))
                    out.append(joined)
                if joined:
                    break
        if not joined:
            index.setdefault(_baseline(late), []).append(len(out))
            out.append(late)
    return [x for x in out if x]


def _top(done: list[dict], line: dict) -> int | None:
    """Where a line goes that is above the text of its page and below its running header."""
    if not done or len(done) > MAX_PAGE_LINES:
        return None
    at = next((k + 1 for k in range(len(done) - 1, -1, -1) if done[k]["y"] <= line["y"]), 0)
    if at == len(done) or any(x["y"] > line["y"] - line["font_size"] for x in done[:at]):
        return None
    first, indent = done[at], line["x"] - done[at]["x"]
    return at if _free(first) and _size(line) >= _size(first) and -SLACK < indent <= TOP_INDENT * line["font_size"] else None


def _in_place(lines: list[dict]) -> list[dict]:
    """The lines of a page, with whole late lines between the two lines they stand between: those with the left edge of the
    lower one, not in a smaller font, those that follow a line that was moved, and those at the page's top."""
    done: list[dict] = []
    last: int | None = None

    def places(x: dict) -> Iterator[int | None]:
        if last is not None and last + 1 < len(done):
            above, below = done[last], done[last + 1]
            if above["y"] < x["y"] < below["y"] and _size(x) == _size(above) and x["y"] - above["y"] < 2 * x["font_size"]:
                yield last + 1
        for k in range(len(done) - 1, max(0, len(done) - 1 - LOOK_BACK), -1):
            below = done[k]
            if done[k - 1]["y"] < x["y"] < below["y"] and _free(below) and abs(x["x"] - below["x"]) < SLACK and _size(x) >= _size(below):
                yield k
        yield _top(done, x)

    for x in lines:
        last = next(places(x)) if _free(x) else None
        done.insert(len(done) if last is None else last, x)
    return done


def _labelled(lines: list[dict]) -> list[dict]:
    """The lines of a page, with labels that stand alone before the entries on their baselines."""
    out: list[dict | None] = list(lines)
    index: dict[int, list[int]] = {}
    for k, x in enumerate(lines):
        index.setdefault(_baseline(x), []).append(k)
    for k, label in enumerate(lines):
        if out[k] is not label or not _free(label) or not _is_label(label):
            continue
        for j in index[_baseline(label)][:MAX_TRIES]:
            entry = out[j]
            fits = j != k and entry and _free(entry) and _size(entry) == _size(label) and 1 < len(entry["words"]) <= MAX_WORDS and entry["x"] > label["x"]
            if fits and (joined := woven(label, entry)):
                out[j], out[k] = joined, None
                break
    return [x for x in out if x]


def in_reading_order(lines: list[dict]) -> list[dict]:
    """The lines of all pages, in the order of their contents, with late text in its place."""
    pages = [list(own) for _, own in groupby(lines, key=lambda x: x["page"])]
    after = [*(own[0] for own in pages[1:]), None]
    return [x for own, first in zip(pages, after, strict=False) for x in _labelled(_in_place(_on_baselines(own, first)))]
