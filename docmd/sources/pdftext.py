"""Text lines of PDF pages, in the order of their content streams."""

from __future__ import annotations

import functools
import re
import unicodedata

from typing import NamedTuple

from docmd.functions.text import clean, link
from docmd.sources import pdfblocks, pdflate
from docmd.sources.pdfmarks import Marks
from docmd.sources.pdfobjects import File, Name, Parser, Stream, Unreadable, Word

# When glyphs make one line, when a gap is a space, what makes a font bold, how high a glyph is.
SAME_BASELINE, SPACE_GAP, STRETCHED, BOLD_WEIGHT, HEIGHT = 0.1, 0.2, 1.05, 600, 0.5
# When a space is drawn over a letter (share of its width, letters away), and what a raised digit is, in sizes
# of the text beside it: size, rise, distance; how far a number may be from its factor.
COVERED, COVER_WINDOW = 0.9, 8
SCRIPT_SIZE, SCRIPT_RISE, SCRIPT_GAP, ON_BASELINE, SAME_SIZE, FACTOR_GAP = (0.55, 0.80), (0.20, 0.50), (-0.01, 0.15), 0.05, 0.01, 0.25
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
_DIGITS = frozenset("0123456789")
_BOLD = re.compile(r"(?i:bold|black|heavy|semibold)|-Medi(Ital)?$|(^|\+)CMBX")
_POWER, _FACTOR = re.compile(r"((?:[0-9]+(?:\.[0-9]+)?)?×)?10([0-9]{1,3})"), re.compile(r"[0-9]+(?:\.[0-9]+)?×")
#: Names of characters that are no letters; letters and `uniXXXX` are their own names.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",",
    "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<",
    "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}",
    "asciitilde": "~", "bullet": "•", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "ellipsis": "…", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl",
    "germandbls": "ß", "section": "§", "copyright": "©", "degree": "°", "minus": "−", "multiply": "×", "Euro": "€", "ae": "æ", "AE": "Æ", "oslash": "ø", "Oslash": "Ø", "dotlessi": "ı",
}
_ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "cedilla": "̧", "ring": "̊", "caron": "̌"}


def glyph_text(name: str) -> str:
    """The text of a glyph name; empty for an unknown one."""
    name = name.split(".")[0]
    if name in GLYPHS:
        return GLYPHS[name]
    if m := re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", name):
        return chr(int(m[1] or m[2], 16))
    if len(name) == 1:
        return name
    if name[1:] in _ACCENTS:
        return unicodedata.normalize("NFC", name[0] + _ACCENTS[name[1:]])
    return ""


@functools.lru_cache(4)
def _single_bytes(codec: str) -> dict[int, str]:
    """The characters of an encoding's bytes; nobody changes them."""
    return {b: bytes([b]).decode(codec, "ignore") for b in range(32, 256)}


def _mul(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


class Font:
    """Codes to text and widths."""

    def __init__(self, file: File, head: dict) -> None:
        get = file.get
        self.wide = get(head.get("Subtype")) == "Type0"
        inner = head
        if self.wide:
            below = get(head.get("DescendantFonts")) or [{}]
            inner = get(below[0]) or {}
        descriptor = get(inner.get("FontDescriptor")) or {}
        name = str(get(head.get("BaseFont")) or "")
        flags, weight = get(descriptor.get("Flags")) or 0, get(descriptor.get("FontWeight")) or 0
        self.bold = bool(isinstance(flags, int) and flags & 1 << 18) or (isinstance(weight, (int, float)) and weight >= BOLD_WEIGHT) or bool(_BOLD.search(name))
        self.widths: dict[int, float] = {}
        self.default = 500.0
        if self.wide:
            self.default = float(get(inner.get("DW")) or 1000)
            w, k = get(inner.get("W")) or [], 0
            while k < len(w):
                first, second = get(w[k]), get(w[k + 1]) if k + 1 < len(w) else None
                if isinstance(second, list):
                    self.widths |= {first + j: get(x) for j, x in enumerate(second)}
                    k += 2
                else:
                    if k + 2 < len(w) and isinstance(second, int) and second - first < 70_000:
                        self.widths |= dict.fromkeys(range(first, second + 1), get(w[k + 2]))
                    k += 3
        else:
            first = get(head.get("FirstChar")) or 0
            self.widths = {first + j: get(x) for j, x in enumerate(get(head.get("Widths")) or [])}
            self.default = float(get(descriptor.get("MissingWidth")) or 500)
        self.map = self._cmap(file, get(head.get("ToUnicode")))
        self.simple = {} if self.wide else self._simple(file, get(head.get("Encoding")))
        self.known: dict[int, tuple[str, float, bool]] = {}  # what was shown so far

    @staticmethod
    def _cmap(file: File, stream) -> dict[int, str]:
        out: dict[int, str] = {}
        if not isinstance(stream, Stream):
            return out
        p, stack = Parser(file.decoded(stream)), []
        text = lambda b: b.decode("utf-16-be", "ignore")
        while (x := p.next()) is not None:
            if isinstance(x, Word):
                if x == "endbfchar":
                    for a, b in zip(stack[::2], stack[1::2], strict=False):
                        if isinstance(a, bytes) and isinstance(b, bytes):
                            out[int.from_bytes(a, "big")] = text(b)
                elif x == "endbfrange":
                    for a, b, c in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                        if not isinstance(a, bytes) or not isinstance(b, bytes):
                            continue
                        low, high = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                        if isinstance(c, list):
                            out |= {low + j: text(y) for j, y in enumerate(c) if isinstance(y, bytes)}
                        elif isinstance(c, bytes) and c and high - low < 70_000:
                            start = int.from_bytes(c, "big")
                            out |= {low + j: text((start + j).to_bytes(len(c), "big")) for j in range(high - low + 1) if (start + j).bit_length() <= 8 * len(c)}
                stack = []
            else:
                stack.append(x)
        return out

    @staticmethod
    def _simple(file: File, encoding) -> dict[int, str]:
        base = file.get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else encoding
        codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
        out = dict(_single_bytes(codec))
        code = 0
        for x in (file.get(encoding.get("Differences")) or []) if isinstance(encoding, dict) else []:
            x = file.get(x)
            if isinstance(x, Name):
                if t := glyph_text(x):
                    out[code] = t
                code += 1
            elif isinstance(x, int):
                code = x
        return out

    def glyphs(self, data: bytes) -> list[tuple[str, float, bool]]:
        """(text, width in thousandths, whether it is a one-byte space) of each code."""
        codes = [int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data), 2)] if self.wide else data
        return [self.known.get(c) or self._glyph(c) for c in codes]

    def _glyph(self, c: int) -> tuple[str, float, bool]:
        width = w if isinstance(w := self.widths.get(c), (int, float)) else self.default
        self.known[c] = found = self.map[c] if c in self.map else self.simple.get(c, ""), float(width), c == 32 and not self.wide
        return found


class Glyph(NamedTuple):
    """A shown character or ligature: its baseline's start from the top left of the page, and its marked content (-1: none)."""

    text: str
    x: float
    y: float
    advance: float
    size: float
    bold: bool
    rotated: bool
    invisible: bool
    mark: int


class _Page:
    """The interpreter of one page's content: its glyphs, and the boxes that it paints (of a page that is not turned)."""

    def __init__(self, file: File, page: dict, number: int, marks: Marks) -> None:
        self.file, self.number, self.marks = file, number, marks
        box = [file.get(x) for x in (file.get(page.get("CropBox")) or file.get(page.get("MediaBox")) or [0, 0, 612, 792])]
        box = box if len(box) == 4 and all(isinstance(x, (int, float)) for x in box) else [0, 0, 612, 792]
        self.box = (min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3]))
        turn = file.get(page.get("Rotate")) or 0
        self.turn = int(turn) % 360 if isinstance(turn, (int, float)) else 0
        self.glyphs: list[Glyph] = []
        self.boxes: list[tuple[float, float, float, float]] = []
        self.open_marks: list[int] = []
        self.images = False
        self.links = [] if self.turn else self._links(page)
        contents = file.get(page.get("Contents"))
        parts = [file.get(c) for c in contents] if isinstance(contents, list) else [contents]
        data = b"\n".join(file.decoded(s) for s in parts if isinstance(s, Stream))
        self.run(data, file.get(page.get("Resources")) or {}, (1, 0, 0, 1, 0, 0), 0, self.extent([(self.box[0], self.box[1]), (self.box[2], self.box[3])]))

    @property
    def height(self) -> float:
        return self.box[2] - self.box[0] if self.turn % 180 else self.box[3] - self.box[1]

    def place(self, x: float, y: float) -> tuple[float, float]:
        """Page coordinates from the top left, as the page is shown."""
        x, y = x - self.box[0], y - self.box[1]
        if not self.turn:
            return x, self.box[3] - self.box[1] - y
        w, h = self.box[2] - self.box[0], self.box[3] - self.box[1]
        return {0: (x, h - y), 90: (y, x), 180: (w - x, y), 270: (h - y, w - x)}.get(self.turn, (x, h - y))

    def _links(self, page: dict) -> list[tuple[float, float, float, float, str]]:
        """left, top, right, bottom and address of the page's links to addresses."""
        get, out = self.file.get, []
        for a in get(page.get("Annots")) or []:
            a = get(a)
            action = get(a.get("A")) if isinstance(a, dict) and get(a.get("Subtype")) == "Link" else None
            url = _string(get(action.get("URI"))) if isinstance(action, dict) else None
            rect = [get(v) for v in get(a.get("Rect")) or []] if url else []
            if len(rect) == 4 and all(isinstance(v, (int, float)) for v in rect):
                (x1, y1), (x2, y2) = self.place(rect[0], rect[1]), self.place(rect[2], rect[3])
                out.append((min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2), url))
        return out

    def extent(self, points: list[tuple[float, float]], ctm: tuple = (1, 0, 0, 1, 0, 0)) -> tuple[float, float, float, float]:
        """left, top, right and bottom of points on the page."""
        placed = [self.place(x * ctm[0] + y * ctm[2] + ctm[4], x * ctm[1] + y * ctm[3] + ctm[5]) for x, y in points]
        return min(p[0] for p in placed), min(p[1] for p in placed), max(p[0] for p in placed), max(p[1] for p in placed)

    def paint(self, box: tuple | None, clip: tuple) -> None:
        """Keeps the visible part of a painted box; one more than a page may have tells that it has too many."""
        if box and not self.turn and len(self.boxes) <= pdfblocks.MAX_BOXES:
            seen = _within(box, clip)
            if seen[0] <= seen[2] and seen[1] <= seen[3]:
                self.boxes.append(seen)

    def url(self, g: Glyph) -> str | None:
        """The address of the link that a glyph's centre is in."""
        if g.rotated or not self.links:
            return None
        x, y = g.x + g.advance / 2, g.y - 0.3 * g.size
        return next((u for left, top, right, bottom, u in self.links if left <= x <= right and top <= y <= bottom), None)

    def run(self, data: bytes, resources: dict, ctm: tuple, depth: int, clip: tuple) -> None:
        get = self.file.get
        properties = get(resources.get("Properties")) or {}
        path: tuple | None = None  # the extent of the path that is being made
        cutting = False  # whether it becomes a clip
        fonts, objects = get(resources.get("Font")) or {}, get(resources.get("XObject")) or {}
        p, stack, saved = Parser(data), [], []
        state = {"ctm": ctm, "font": None, "size": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0, "mode": 0, "clip": clip}
        tm = line = (1, 0, 0, 1, 0, 0)

        def show(data_: bytes) -> None:
            nonlocal tm
            font, size = state["font"], state["size"]
            if font is None:
                return
            # what the glyphs of one text share: all but their places
            scale, rise, char, space, clip = state["scale"], state["rise"], state["char"], state["word"], state["clip"]
            c0, c1, c2, c3, c4, c5 = ctm = state["ctm"]
            t0, t1, t2, t3, t4, t5 = tm
            b0, b1, b2, b3, _, _ = _mul(tm, ctm)
            m0, m1, m2, m3, _, _ = _mul((size * scale, 0, 0, size, 0, rise), (b0, b1, b2, b3, 0, 0))
            high, broad = (m2**2 + m3**2) ** 0.5, (m0**2 + m1**2) ** 0.5
            shown = high if high and broad / high <= STRETCHED else broad
            left, top, right, bottom = clip
            tall, lift, place = max(HEIGHT * shown, 0.1), rise * c3, self.place if self.turn else None
            from_left, from_top, deep = self.box[0], self.box[1], self.box[3] - self.box[1]
            new = tuple.__new__  # a named tuple's own is slower
            bold, hidden, mark, out = font.bold, state["mode"] == 3, self.open_marks[-1] if self.open_marks else -1, self.glyphs
            for text, width, is_space in font.glyphs(data_):
                advance = (width / 1000 * size + char + (space if is_space else 0)) * scale
                if text:
                    b4, b5 = t4 * c0 + t5 * c2 + c4, t4 * c1 + t5 * c3 + c5
                    drawn = width / 1000 * size * scale
                    x, y, x2, y2 = 0 * b0 + rise * b2 + b4, 0 * b1 + rise * b3 + b5, drawn * b0 + 0 * b2 + b4, drawn * b1 + 0 * b3 + b5 + lift
                    if place:
                        (x, y), (x2, y2) = place(x, y), place(x2, y2)
                    else:  # the same without a call
                        x, y, x2, y2 = x - from_left, deep - (y - from_top), x2 - from_left, deep - (y2 - from_top)
                    flat = abs(y2 - y) <= abs(x2 - x) + 1e-6 and x2 >= x - 1e-6
                    text = unicodedata.normalize("NFKC", text) if "\ufb00" <= text[:1] <= "\ufdff" or "\ufe70" <= text[:1] <= "\ufeff" else text
                    # a glyph goes that is wholly outside the clip
                    if (x2 > left or x + 0.1 > left) and (x < right or x2 < right) and (y > top or y2 > top) and (y if y < y2 else y2) - tall < bottom:
                        out.append(new(Glyph, (text, x, y, x2 - x if flat else ((x2 - x) ** 2 + (y2 - y) ** 2) ** 0.5, shown, bold, not flat, hidden, mark)))
                t4, t5 = advance * t0 + 0 * t2 + t4, advance * t1 + 0 * t3 + t5
            tm = (t0, t1, t2, t3, t4, t5)

        def number(k: int) -> float:
            return float(stack[k]) if -k <= len(stack) and isinstance(stack[k], (int, float)) else 0.0

        def add(*points: tuple[float, float]) -> None:
            nonlocal path
            box = self.extent(list(points), state["ctm"])
            path = box if path is None else (min(path[0], box[0]), min(path[1], box[1]), max(path[2], box[2]), max(path[3], box[3]))

        while (x := p.next()) is not None:
            if not isinstance(x, Word):
                stack.append(x)
                continue
            # text first, as it is most of a page
            if x == "Tj" and stack and isinstance(stack[-1], bytes):
                show(stack[-1])
            elif x == "Tm" and len(stack) >= 6:
                tm = line = tuple(number(k) for k in range(-6, 0))
            elif x == "BT":
                tm = line = (1, 0, 0, 1, 0, 0)
            elif x == "Tf" and len(stack) >= 2:
                ref = fonts.get(stack[-2]) if isinstance(stack[-2], Name) else None
                head = get(ref)
                if isinstance(head, dict):
                    # pages share fonts; the dictionary is kept, so that no other one gets its id
                    state["font"] = self.file.fonts.setdefault(id(head), (head, None))[1] or Font(self.file, head)
                    self.file.fonts[id(head)] = head, state["font"]
                state["size"] = number(-1)
            elif x == "ET":
                pass
            elif x == "q":
                saved.append(dict(state))
            elif x == "Q" and saved:
                state = saved.pop()
            elif x == "cm" and len(stack) >= 6:
                state["ctm"] = _mul(tuple(number(k) for k in range(-6, 0)), state["ctm"])
            elif x in _POINTS:
                add(*((number(k), number(k + 1)) for k in range(-2 * _POINTS[x], 0, 2)))
            elif x == "re":
                left, low, wide, high = (number(k) for k in range(-4, 0))
                add((left, low), (left + wide, low), (left, low + high), (left + wide, low + high))
            elif x in ("W", "W*"):
                cutting = True
            elif x in _PAINTS:
                if x != "n":
                    self.paint(path, state["clip"])
                if cutting and path:
                    state["clip"] = _within(path, state["clip"])
                path, cutting = None, False
            elif x in ("BMC", "BDC"):
                of = stack[-1] if x == "BDC" and stack else None
                of = get(properties.get(of)) if isinstance(of, Name) else of
                mark = get(of.get("MCID")) if isinstance(of, dict) else None
                self.open_marks.append(mark if isinstance(mark, int) and mark >= 0 else self.open_marks[-1] if self.open_marks else -1)
            elif x == "EMC":
                del self.open_marks[-1:]
            elif x in ("Tc", "Tw", "TL", "Ts", "Tr", "Tz"):
                key = {"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise", "Tr": "mode", "Tz": "scale"}[x]
                state[key] = number(-1) / 100 if x == "Tz" else int(number(-1)) if x == "Tr" else number(-1)
            elif x in ("Td", "TD"):
                if x == "TD":
                    state["lead"] = -number(-1)
                tm = line = _mul((1, 0, 0, 1, number(-2), number(-1)), line)
            elif x in ("T*", "'", '"'):
                if x == '"':
                    state["word"], state["char"] = number(-3), number(-2)
                tm = line = _mul((1, 0, 0, 1, 0, -state["lead"]), line)
                if x != "T*" and stack and isinstance(stack[-1], bytes):
                    show(stack[-1])
            elif x == "TJ" and stack and isinstance(stack[-1], list):
                for part in stack[-1]:
                    if isinstance(part, bytes):
                        show(part)
                    elif isinstance(part, (int, float)):
                        tm = _mul((1, 0, 0, 1, -part / 1000 * state["size"] * state["scale"], 0), tm)
            elif x == "Do" and stack and isinstance(stack[-1], Name):
                form = get(objects.get(stack[-1]))
                if isinstance(form, Stream) and get(form.head.get("Subtype")) == "Image":
                    self.images |= depth == 0
                    self.paint(self.extent(_UNIT, state["ctm"]), state["clip"])
                elif isinstance(form, Stream) and get(form.head.get("Subtype")) == "Form" and depth < 12:
                    matrix = [get(v) for v in get(form.head.get("Matrix")) or [1, 0, 0, 1, 0, 0]]
                    inner = _mul(tuple(matrix), state["ctm"])
                    limits = [get(v) for v in get(form.head.get("BBox")) or []]
                    seen = self.extent([(limits[i], limits[j]) for i in (0, 2) for j in (1, 3)], inner) if len(limits) == 4 and all(isinstance(v, (int, float)) for v in limits) else state["clip"]
                    self.run(self.file.decoded(form), get(form.head.get("Resources")) or resources, inner, depth + 1, _within(seen, state["clip"]))
            elif x == "BI":  # an inline image: its data is no operator
                end = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").search(p.data, p.at)
                p.at = end.end() if end else len(p.data)
                self.paint(self.extent(_UNIT, state["ctm"]), state["clip"])
            stack = []

    def shown(self) -> list[Glyph]:
        """The visible glyphs, or all of a page without any."""
        return [g for g in self.glyphs if not g.invisible] or self.glyphs

    def cell(self, g: Glyph) -> tuple[int, int, int] | None:
        return self.marks.cells.get((self.number, g.mark)) if g.mark >= 0 else None

    def lines(self) -> list[dict]:
        """The page's lines: glyphs on one baseline, in one direction, from left to right, with their words."""
        groups: list[list[Glyph]] = []
        group: list[Glyph] = []
        last: Glyph | None = None
        low = high = 0.0
        for g in self.shown():
            size = g.size if g.size > 1e-3 else 1e-3
            y, tall = g.y, HEIGHT * size
            if g.rotated or last is None or last.rotated:
                joins = last is not None and g.rotated == last.rotated and abs(g.x - last.x) <= SAME_BASELINE * size
            else:  # raised ones reach into the height of the line's others
                joins = (abs(y - low) <= SAME_BASELINE * size or low - high <= y <= low or y - tall <= low <= y) and g.x >= last.x + last.advance - size
            if joins:
                low, high = y if y > low else low, tall if tall > high else high
                group.append(g)
            else:
                low, high, group = y, tall, [g]
                groups.append(group)
            last = g
        return [line for glyphs in groups if (line := self._line(glyphs))]

    def _line(self, glyphs: list[Glyph]) -> dict | None:
        glyphs = _without_covered(glyphs)
        cells = [self.cell(g) for g in glyphs] if self.marks.cells else [None] * len(glyphs)
        inked = [g for g in glyphs if not g.text.isspace()]
        if not inked:
            return None
        tables = {c[0] for c in cells if c}
        others = not tables or any(not c and not g.text.isspace() for g, c in zip(glyphs, cells, strict=True))
        raised = _with_raised(glyphs, cells)
        text, words = self._text([g for g, c in zip(raised, cells, strict=True) if not c] if tables and others else raised, not tables and not self.turn)
        letters: dict[float, int] = {}
        for g in inked:
            letters[g.size] = letters.get(g.size, 0) + len(g.text.strip())
        sizes: dict[float, int] = {}
        for own, n in letters.items():
            points = _points(own)
            sizes[points] = sizes.get(points, 0) + n
        levels: dict[int, int] = {} if self.marks.headings else {0: len(inked)}
        for g in inked if self.marks.headings else ():
            level = self.marks.headings.get((self.number, g.mark), 0)
            levels[level] = levels.get(level, 0) + 1
        size = max(sizes, key=lambda s: (sizes[s], s))
        first, rotated = glyphs[0], glyphs[0].rotated
        level = max(levels, key=lambda k: (k > 0, levels[k]))
        return {
            "page": self.number, "page_height": float(self.height), "x": first.x, "y": first.y if rotated else next((g.y for g in inked if _points(g.size) == size), first.y),
            "width": 0.0 if rotated else glyphs[-1].x + glyphs[-1].advance - first.x, "font_size": float(size), "bold": 2 * sum(g.bold for g in inked) > len(inked), "rotated": rotated,
            "text": text.strip() if tables and others else text.rstrip(), "table_id": min(tables) if len(tables) == 1 and not others else -1,
            "heading": level if 2 * (len(inked) - levels.get(0, 0)) > len(inked) else 0, "words": words,
        }

    def _text(self, glyphs: list[Glyph], powers: bool) -> tuple[str, list[pdfblocks.Word]]:
        """The text of glyphs, with links, spaces in its gaps and powers of ten, and its words with their places."""
        pieces: list[list[Glyph]] = [[]]  # of words
        gaps: set[int] = set()  # glyphs with a gap before them
        before = None
        for k, g in enumerate(glyphs):
            gap = before is not None and not g.rotated and g.x - (before.x + before.advance) > SPACE_GAP * g.size
            if gap:
                gaps.add(k)
            blank = g.text.isspace()
            if (gap or blank) and pieces[-1]:
                pieces.append([])
            if not blank:
                pieces[-1].append(g)
            before = g
        pieces = [p for p in pieces if p]
        powered = _powers(pieces, self.boxes, glyphs) if powers and "10" in "".join(g.text for g in glyphs) else {}
        shown = {id(g): t for p in powered.values() if p.inline for g, t in zip(p.glyphs, p.texts, strict=True)}
        if self.links and any(self.url(g) for g in glyphs):
            shown, powered = {}, {}
        parts: list[tuple[str | None, str]] = [(None, "")]
        parted = False  # by a gap, which is one blank together with the blanks beside it
        for k, g in enumerate(glyphs if self.links else ()):
            text, url, so_far = shown.get(id(g), g.text), self.url(g), parts[-1][1]
            if k in gaps:
                parts[-1] = parts[-1][0], so_far if so_far[-1:].isspace() else so_far + " "
                parted = True
            elif k and so_far[-1:].isalnum() and text[:1].isalnum():
                url = parts[-1][0]  # a link's box ends at words, not in them
            if parted and text.isspace():
                continue
            parted = False
            if url == parts[-1][0]:
                parts[-1] = url, parts[-1][1] + text
            else:
                parts.append((url, text))
        if not self.links:
            # the same without addresses
            run: list[str] = []
            for k, g in enumerate(glyphs):
                text = shown.get(id(g), g.text) if shown else g.text
                if k in gaps:
                    if not run or not run[-1][-1:].isspace():
                        run.append(" ")
                    parted = True
                if parted and text.isspace():
                    continue
                parted = False
                run.append(text)
            parts = [(None, "".join(run))]
        words = []
        for k, p in enumerate(pieces):
            found = powered.get(k)
            own = "".join(found.texts) if found and found.alone else "".join(g.text for g in p)
            words.append(pdfblocks.Word(p[0].x, p[-1].x + p[-1].advance, own, "".join(found.texts) if found and found.scale else None))
        text = ""
        for url, t in parts:
            own = link(t, url) if url else t
            # an address that is written in brackets is a link already
            text += t if url and text.endswith("<") and own.startswith("<") else own
        return text, words


_POINTS = {"m": 1, "l": 1, "c": 3, "v": 2, "y": 2}
_PAINTS = ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n")
_UNIT = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0)]


def _within(box: tuple, clip: tuple) -> tuple[float, float, float, float]:
    return max(box[0], clip[0]), max(box[1], clip[1]), min(box[2], clip[2]), min(box[3], clip[3])


def _without_covered(glyphs: list[Glyph]) -> list[Glyph]:
    """glyphs without the spaces that are drawn over a letter near them."""

    def covered(k: int) -> bool:
        space = glyphs[k]
        if space.rotated or space.advance <= 0:
            return False
        left, right, least = space.x, space.x + space.advance, COVERED * space.advance
        for g in glyphs[max(0, k - COVER_WINDOW) : k + COVER_WINDOW + 1]:
            end = g.x + g.advance
            if (end if end < right else right) - (g.x if g.x > left else left) >= least and g.text[:1].isalnum() and abs(g.y - space.y) < 0.1:
                return True
        return False

    return [g for k, g in enumerate(glyphs) if not (g.text.isspace() and covered(k))]


def _points(size: float) -> float:
    """A glyph's size in whole points; smaller than one as it is."""
    return float(int(size + 1e-3)) if size >= 1 else round(size, 2)


def _is_raised(digit: Glyph, text: Glyph, gap: float) -> bool:
    if text.size <= 0:
        return False
    bounds = ((digit.size / text.size, SCRIPT_SIZE), ((text.y - digit.y) / text.size, SCRIPT_RISE), (gap / text.size, SCRIPT_GAP))
    return all(low <= value <= high for value, (low, high) in bounds)


def _with_raised(glyphs: list[Glyph], cells: list) -> list[Glyph]:
    """glyphs in which raised numbers of footnotes are superscripts: up to three digits that touch a text, with nothing or
    text on the baseline at their other side."""
    digit = [g.text in _DIGITS and not g.rotated and not c for g, c in zip(glyphs, cells, strict=True)]
    if True not in digit:
        return glyphs
    out, k = list(glyphs), 0
    while k < len(glyphs):
        end = k
        while end < len(glyphs) and digit[end]:
            end += 1
        run = glyphs[k:end]
        if 0 < len(run) <= 3 and all(abs(g.size - run[0].size) <= SAME_SIZE * run[0].size and abs(g.y - run[0].y) < 0.1 for g in run):
            before, after = glyphs[k - 1] if k else None, glyphs[end] if end < len(glyphs) else None
            texts = [g is not None and not g.rotated and not g.text.isspace() for g in (before, after)]
            level = lambda g, of: g is None or g.text.isspace() or abs(g.y - of.y) <= ON_BASELINE * of.size
            follows = texts[0] and _is_raised(run[0], before, run[0].x - before.x - before.advance) and level(after, before)
            leads = texts[1] and _is_raised(run[-1], after, after.x - run[-1].x - run[-1].advance) and level(before, after)
            if follows or leads:
                out[k:end] = [g._replace(text=SUPERSCRIPTS[int(g.text)]) for g in run]
        k = max(end, k + 1)
    return out


class _Power(NamedTuple):
    """A word with a raised exponent: whether it stands alone (with its factor), is a mere scale, and goes into the line."""

    glyphs: list[Glyph]
    texts: list[str]
    alone: bool
    scale: bool
    inline: bool


def _powers(words: list[list[Glyph]], boxes: list[tuple], line: list[Glyph]) -> dict[int, _Power]:
    """The words that are powers of ten with a factor, in the word or as the nearest word before it."""
    found: dict[int, _Power] = {}
    for k, word in enumerate(words):
        m = _POWER.fullmatch("".join(g.text for g in word))
        if not m or len(word) != len(m[0]) or any(g.rotated for g in word):
            continue
        start = len(m[1] or "")
        base, script = word[start], word[start + 2 :]
        same = lambda g: abs(g.y - base.y) <= ON_BASELINE * base.size and abs(g.size - base.size) <= SAME_SIZE * base.size  # noqa: B023, E731
        gaps = [g.x - p.x - p.advance for p, g in zip(word[start + 1 :], script, strict=False)]
        if not all(map(same, word[: start + 2])) or not all(_is_raised(g, base, gap) and abs(g.size - script[0].size) <= SAME_SIZE for g, gap in zip(script, gaps, strict=True)):
            continue
        texts = [g.text for g in word[: start + 2]] + [SUPERSCRIPTS[int(g.text)] for g in script]
        inline = m[1] != "×"
        if m[1] is None:
            before = max((w for j, w in enumerate(words) if j != k and w[-1].x + w[-1].advance <= base.x), key=lambda w: w[-1].x + w[-1].advance, default=None)
            if before is None or not _FACTOR.fullmatch("".join(g.text for g in before)) or not all(map(same, before)):
                continue
            edge = before[-1].x + before[-1].advance
            size = max((g.size for g in line), default=base.size)
            ruled = any(b[2] - b[0] <= 1.5 and b[3] - b[1] >= 0.5 * size and b[0] <= base.x and b[2] >= edge and b[1] <= base.y <= b[3] for b in boxes)
            between = any(g.x + g.advance > edge and g.x < base.x for j, w in enumerate(words) if j != k and w is not before for g in w)
            inline = base.x - edge <= FACTOR_GAP * base.size and not ruled and not between and len(boxes) <= pdfblocks.MAX_BOXES
        found[k] = _Power(word, texts, m[1] is not None and m[1] != "×", m[1] == "×", inline)
    return found


def _tagged(pages: list[_Page], marks: Marks) -> list[dict]:
    """The tables of the structure tree: their cells' glyphs in reading order, with a space for a gap or a new line."""
    texts: dict[tuple[int, int, int], str] = {}
    last: dict[tuple[int, int, int], Glyph] = {}
    for page in pages:
        for g in page.shown():
            if cell := page.cell(g):
                before = last.get(cell)
                if before and (abs(g.y - before.y) > HEIGHT * before.size or g.x - before.x - before.advance > SPACE_GAP * g.size):
                    texts[cell] += " "
                texts[cell] = texts.get(cell, "") + g.text
                last[cell] = g
    shown = lambda t, r, n: [texts.get((t, r, c), "") for c in range(n)]
    return [{"table_id": t, "rows": [shown(t, r, n) for r, n in enumerate(shape)], "blank": marks.blank[t]} for t, shape in enumerate(marks.shapes)]


def _placed(lines: list[dict]) -> list[dict]:
    """lines in which the first one of each tagged table stands for it, and its others are left out."""
    out, seen = [], set()
    for x in lines:
        if x["table_id"] < 0:
            out.append(x)
        elif x["table_id"] not in seen:
            seen.add(x["table_id"])
            out.append(pdfblocks.place_of_table(x, x["table_id"]))
    return out


def _string(value) -> str | None:
    if not isinstance(value, bytes):
        return None
    if value[:2] == b"\xfe\xff":
        return value[2:].decode("utf-16-be", "replace")
    return value[3:].decode("utf-8", "replace") if value[:3] == b"\xef\xbb\xbf" else value.decode("latin-1")


class Scanned(Unreadable):
    """A file of images without text."""


def read(data: bytes) -> tuple[list[dict], dict[str, str | None], list[dict]]:
    """The lines of all pages, without the labels of figures and with one line for each table; title, author and language;
    and the tables: table_id, rows, and whether their header is blank. A file of images without text is refused."""
    try:
        file = File(data)
        dictionaries = file.pages()
        marks = Marks(file)
        pages = [_Page(file, page, k + 1, marks) for k, page in enumerate(dictionaries)]
        info = file.get(file.trailer.get("Info"))
        info = info if isinstance(info, dict) else {}
        own = {"title": clean(_string(file.get(info.get("Title")))), "author": clean(_string(file.get(info.get("Author")))), "language": clean(_string(file.get(file.root.get("Lang"))))}
        lines = _placed(pdflate.in_reading_order([line for page in pages for line in page.lines() if line["text"].strip()]))
        boxes, tables = {p.number: p.boxes for p in pages}, _tagged(pages, marks)
        shown, ruled = pdfblocks.with_ruled_tables(pdfblocks.without_figures(lines, boxes), boxes, len(tables))
    except Unreadable:
        raise
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, OverflowError, RecursionError) as e:
        raise Unreadable("Cannot read PDF") from e
    if not lines and any(p.images for p in pages):
        raise Scanned("The PDF has only images: run OCR on it")
    return [{n: v for n, v in x.items() if n != "words"} | {"seq": k} for k, x in enumerate(shown)], own, tables + ruled
