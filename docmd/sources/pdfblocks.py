"""Figures and ruled tables among the lines of PDF pages.

lines are dicts as `pdftext` makes them, in their order; boxes: what each page paints, (left, top, right, bottom) from the
top left. All work is on a page at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

import numpy as np

from docmd.operators import layout as L
from docmd.operators.boxes import FIGURE_CAPTION, MAX_BOXES, MAX_RULES, TABLE_CAPTION, THIN, cluster_groups, near_groups

# Fixed values, in sizes of the caption (or the line) where they are no counts: distance of a drawing or grid, growth of a
# figure's area, distance and size of its title, pitch of a table's rows, step that starts a caption.
MAX_GAP, MARGIN, TITLE_GAP, TITLE_SIZE, ROW_PITCH, CAPTION_STEP = 3.0, 1.0, 2.0, 1.5, 2.0, 1.5
# Words of a label, rows that make a table, drawings and captions of a page, points between equal rules.
MAX_LABEL_WORDS, TABLE_ROWS, MAX_DRAWINGS, MAX_CAPTIONS, SAME = 8, 3, 200, 50, 2.0
_FIGURE, _TABLE = re.compile(FIGURE_CAPTION, re.A), re.compile(TABLE_CAPTION, re.A)
_NUMBER = re.compile(r"[(\[]?[-+]?[0-9][0-9.,]*[x%]?[)\]]?[,;]?")
_ITEM, _END = re.compile(L.LIST_ITEM, re.A), re.compile(L.SENTENCE_END)
Box = tuple[float, float, float, float]


class Word(NamedTuple):
    """A word's extent, its text, and its text where a mere scale of ten may stand."""

    left: float
    right: float
    text: str
    scale: str | None = None

    @property
    def centre(self) -> float:
        return (self.left + self.right) / 2


def place_of_table(line: dict, table: int) -> dict:
    """The line that stands for a table, where its first line is."""
    return line | {"text": "", "table_id": table, "bold": False, "rotated": False, "width": 0.0, "heading": 0, "words": []}


def groups(lines: list[dict]) -> list[list[dict]]:
    """The paragraphs of lines, as far as captions ask: a table, a new page, a line that is not below the one before it,
    another size, a gap wider than usual and a first-line indent start one."""
    key = lambda x: int(x["font_size"] * 2 + 0.5)
    gaps: dict[int, list[float]] = {}
    for a, b in zip(lines, lines[1:], strict=False):
        if a["page"] == b["page"] and key(a) == key(b) and b["y"] > a["y"] and max(a["table_id"], b["table_id"]) < 0:
            gaps.setdefault(key(b), []).append(b["y"] - a["y"])
    pitch = {k: sorted(g)[len(g) // 2] for k, g in gaps.items()}
    out: list[list[dict]] = []
    for k, x in enumerate(lines):
        size, last = x["font_size"], lines[k - 1] if k else None
        if last and x["page"] == last["page"] and x["y"] > last["y"] and key(x) == key(last) and max(x["table_id"], last["table_id"]) < 0:
            usual = max(L.MIN_PITCH * size, min(L.MAX_PITCH * size, pitch.get(key(x), L.DEFAULT_PITCH * size)))
            then = lines[k + 1] if k + 1 < len(lines) else None
            returns = then and then["page"] == x["page"] and key(then) == key(x) and then["y"] > x["y"] and abs(then["x"] - last["x"]) < L.INDENT * size
            indent = returns and x["x"] > last["x"] + L.INDENT * size and not _ITEM.search(last["text"]) and _END.search(last["text"].strip())
            if x["y"] - last["y"] <= L.PARAGRAPH_GAP * usual and not indent:
                out[-1].append(x)
                continue
        out.append([x])
    return out


def _is_caption(x: dict, pattern: re.Pattern) -> bool:
    return not x["rotated"] and x["table_id"] < 0 and bool(pattern.search(x["text"]))


def _contains(box: Box, x: float, y: float) -> bool:
    return box[0] <= x <= box[2] and box[1] <= y <= box[3]


def _union(boxes: list[Box]) -> Box:
    return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)


def _clusters(boxes: list[Box]) -> list[list[Box]]:
    """The clusters of a page's boxes; none of a page with too many."""
    if not boxes or len(boxes) > MAX_BOXES:
        return []
    of = cluster_groups(np.array(boxes, float))
    return [[boxes[k] for k in np.flatnonzero(of == head)] for head in np.unique(of)]


def _is_drawing(parts: list[Box]) -> bool:
    return any(b[2] - b[0] >= THIN and b[3] - b[1] >= THIN for b in parts)


# Figures


def _count(x: dict) -> int:
    return len(x["words"]) or len(x["text"].split())


def _mostly_numbers(x: dict) -> bool:
    words = x["text"].split()
    return 2 * sum(bool(_NUMBER.fullmatch(w)) for w in words) > len(words)


def _has_word(text: str) -> bool:
    return any(len(own) > 2 and own.islower() for w in re.findall(r"[^\W\d_]+", text) for own in [w[1:] if w[0].isupper() else w])


def _areas(caption: list[dict], drawings: list[Box]) -> list[Box]:
    """The areas of the figures above a caption, in its column; else of those below it."""
    first, size = caption[0], caption[0]["font_size"]
    left, right, end = min(x["x"] for x in caption), max(x["x"] + x["width"] for x in caption), caption[-1]["y"]
    column = [d for d in drawings if d[0] < right and d[2] > left]
    if not column:
        return []
    of, gap = near_groups(np.array(column, float), MAX_GAP * size), MAX_GAP * size
    figures = [[column[k] for k in np.flatnonzero(of == head)] for head in np.unique(of)]
    whole = [(_union(f), f) for f in figures]
    whole = [(b, f) for b, f in whole if not _contains(b, first["x"], first["y"])]
    grown = lambda b, top, bottom: (min(b[0] - MARGIN * size, left), top, max(b[2] + MARGIN * size, right), bottom)
    above = [grown(b, b[1] - MARGIN * size, first["y"]) for b, f in whole if b[3] <= first["y"] and any(first["y"] - size - p[3] <= gap for p in f)]
    return above or [grown(b, end, b[3] + MARGIN * size) for b, f in whole if b[1] >= end and any(p[1] - end <= gap for p in f)]


def _is_table(area: Box, lines: list[dict]) -> bool:
    """Whether an area holds long lines of numbers that follow each other: a table drawn as a figure."""
    rows = sorted((x["y"], x["font_size"]) for x in lines if not x["rotated"] and x["table_id"] < 0 and _contains(area, x["x"], x["y"]) and _count(x) > MAX_LABEL_WORDS and _mostly_numbers(x))
    run = 1
    for (above, _), (y, size) in zip(rows, rows[1:], strict=False):
        run = run + 1 if y - above <= ROW_PITCH * size else 1
        if run >= TABLE_ROWS:
            return True
    return False


def without_figures(lines: list[dict], boxes: dict[int, list[Box]]) -> list[dict]:
    """lines without the labels and titles of drawings that have a caption. Sentences, rows of numbers with their labels,
    captions and tables stay."""
    captions: dict[int, list[list[dict]]] = {}
    for group in groups(lines):
        if _is_caption(group[0], _FIGURE):
            captions.setdefault(group[0]["page"], []).append(group)
    of_page: dict[int, list[dict]] = {}
    for x in lines:
        of_page.setdefault(x["page"], []).append(x)
    gone: set[int] = set()
    for page, own in captions.items():
        drawings = [_union(c) for c in _clusters(boxes.get(page, [])) if _is_drawing(c)] if len(own) <= MAX_CAPTIONS else []
        if len(drawings) > MAX_DRAWINGS:
            continue
        areas = [(a, c[0]["font_size"]) for c in own for a in _areas(c, drawings)]
        areas = [(a, size) for a, size in areas if not _is_table(a, of_page[page])]
        kept = {id(x) for c in own for x in c}
        ends: dict[int, float] = {}  # by baseline, how far right a long line begins
        baseline = lambda x: int(np.floor(x["y"] * 10 + 0.5))
        for x in of_page[page]:
            if not x["rotated"] and _count(x) > MAX_LABEL_WORDS:
                ends[baseline(x)] = max(ends.get(baseline(x), x["x"]), x["x"])
        for x in of_page[page]:
            is_label = not x["rotated"] and _count(x) <= MAX_LABEL_WORDS and x["x"] + x["width"] < ends.get(baseline(x), float("-inf"))
            is_text = _count(x) > MAX_LABEL_WORDS and (_has_word(x["text"]) or _mostly_numbers(x))
            if x["table_id"] >= 0 or id(x) in kept or is_label or is_text:
                continue
            title = lambda a, size, x=x: (
                not x["rotated"] and x["font_size"] >= TITLE_SIZE * size and x["y"] <= a[3] and a[1] - x["y"] <= TITLE_GAP * x["font_size"] and x["x"] <= a[2] and x["x"] + x["width"] >= a[0]
            )
            if any(_contains(a, x["x"], x["y"]) or title(a, size) for a, size in areas):
                gone.add(id(x))
    return [x for x in lines if id(x) not in gone]


# Ruled tables


class _Grid:
    """A cluster of rules: its columns between vertical rules, and its bands between horizontal ones."""

    def __init__(self, rules: list[Box]) -> None:
        self.box = left, _, right, _ = _union(rules)
        flat = [b[2] - b[0] > b[3] - b[1] for b in rules]
        self.across = [b for b, f in zip(rules, flat, strict=True) if f]
        self.down = [b for b, f in zip(rules, flat, strict=True) if not f]
        middles = _merged([(b[0] + b[2]) / 2 for b in self.down])
        self.edges = [left, *(x for x in middles if x - left > SAME and right - x > SAME), right]
        self.n = len(self.edges) - 1
        narrowest = min(b - a for a, b in zip(self.edges, self.edges[1:], strict=False))
        # shorter rules are parts of letters
        self.bands = _merged([(b[1] + b[3]) / 2 for b in self.across if b[2] - b[0] >= narrowest / 2])
        self.at_edge: list[list[Box]] = [[] for _ in self.edges]
        for rule in self.down:
            x = (rule[0] + rule[2]) / 2
            nearest = min(range(len(self.edges)), key=lambda k: (abs(self.edges[k] - x), k))
            if 0 < nearest < self.n and abs(self.edges[nearest] - x) <= SAME:
                self.at_edge[nearest].append(rule)

    def column(self, word: Word) -> int:
        return max(0, min(bisect_right(self.edges, word.centre) - 1, self.n - 1))

    def lines(self, page: list[dict], taken: set[int]) -> list[dict] | None:
        """The page's lines in the grid; None when it is no table: a line crosses its edge, is rotated, or of another table."""
        left, top, right, bottom = self.box
        out = []
        for x in page:
            if not top < x["y"] < bottom:
                continue
            if x["table_id"] >= 0 or x["rotated"] or not x["words"]:
                if left <= x["x"] <= right:
                    return None
                continue
            inside = sum(left <= w.centre <= right for w in x["words"])
            if inside and (inside < len(x["words"]) or id(x) in taken):
                return None
            if inside:
                out.append(x)
        return out

    def row(self, lines: list[list[Word]], top: float, bottom: float, header: bool) -> list[str]:
        """The cells of a row: words by column; where no rule parts two columns the text goes to the first of them."""
        parted = [any(r[1] < bottom - 0.5 and r[3] > top + 0.5 for r in rules) for rules in self.at_edge]
        cells: list[list[Word]] = [[] for _ in range(self.n)]
        for word in (w for line in lines for w in line):
            k = self.column(word)
            while k > 0 and not parted[k]:
                k -= 1
            cells[k].append(word)
        return [_cell(c, header) for c in cells]

    def rows(self, lines: list[dict]) -> list[list[str]] | None:
        """The rows; None when text is outside the bands. A band is a row, or one for each line that has a first cell."""
        texts: list[tuple[float, float, list[Word]]] = []
        for x in sorted(lines, key=lambda x: x["y"]):
            if texts and x["y"] - texts[-1][0] <= SAME:
                texts[-1][2].extend(x["words"])
            else:
                texts.append((x["y"], x["font_size"], list(x["words"])))
        for _, _, words in texts:
            words.sort(key=lambda w: w.left)
        out: list[list[str]] = []
        placed = 0
        for top, bottom in zip(self.bands, self.bands[1:], strict=False):
            band = [t for t in texts if top < t[0] <= bottom]
            placed += len(band)
            if band and all(any(self.column(w) == 0 for w in words) for _, _, words in band):
                for y, size, words in band:
                    out.append(self.row([words], max(top, y - size), y, not out))
            elif band:
                out.append(self.row([words for _, _, words in band], top, bottom, not out))
        return out if placed == len(texts) else None


def _merged(values: list[float]) -> list[float]:
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > SAME:
            out.append(v)
    return out


def _cell(words: list[Word], header: bool) -> str:
    """A cell's text; a scale of ten may end the header of parameters."""
    scales = header and any(w.text.lower() == "params" for w in words)
    return " ".join(w.scale if scales and w.scale and k == len(words) - 1 else w.text for k, w in enumerate(words))


def _grid_of(caption: list[dict], grids: list[_Grid]) -> _Grid | None:
    """The nearest grid above a caption, else below it, over or under its first line."""
    first, size = caption[0], caption[0]["font_size"]
    end = caption[-1]["y"]
    beside = [g for g in grids if not _contains(g.box, first["x"], first["y"]) and g.box[0] < first["x"] + first["width"] and g.box[2] > first["x"]]
    above = [g for g in beside if g.box[3] <= first["y"] and first["y"] - size - g.box[3] <= MAX_GAP * size]
    below = [g for g in beside if g.box[1] >= end and g.box[1] - end <= MAX_GAP * size]
    return max(above, key=lambda g: g.box[3]) if above else min(below, key=lambda g: g.box[1], default=None)


def with_ruled_tables(lines: list[dict], boxes: dict[int, list[Box]], number: int) -> tuple[list[dict], list[dict]]:
    """lines in which one line stands for each captioned grid of rules that reads as a table, and these tables, numbered
    from number."""
    of_page: dict[int, list[dict]] = {}
    for x in lines:
        of_page.setdefault(x["page"], []).append(x)
    grids: dict[int, list[_Grid]] = {}
    places: dict[int, int] = {}
    taken: set[int] = set()
    tables = []
    for group in groups(lines):
        starts = [k for k, x in enumerate(group) if _is_caption(x, _TABLE) and (k == 0 or x["y"] - group[k - 1]["y"] > CAPTION_STEP * x["font_size"])]
        if not starts:
            continue
        caption, page = group[starts[0] :], group[0]["page"]
        if page not in grids:
            parts = [c for c in _clusters(boxes.get(page, [])) if not _is_drawing(c) and len(c) <= MAX_RULES]
            flat = [sum(b[2] - b[0] > b[3] - b[1] for b in c) for c in parts]
            grids[page] = [_Grid(c) for c, n in zip(parts, flat, strict=True) if n >= 2 and n < len(c)]
        grid = _grid_of(caption, grids[page])
        inside = grid and grid.lines(of_page[page], taken)
        rows = grid.rows(inside) if inside else None
        if rows:
            places[id(inside[0])] = number + len(tables)
            tables.append({"table_id": number + len(tables), "rows": rows, "blank": False})
            taken |= {id(x) for x in inside}
    shown = [place_of_table(x, places[id(x)]) if id(x) in places else x for x in lines if id(x) in places or id(x) not in taken]
    return shown, tables
