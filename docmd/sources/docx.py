"""Word documents as Markdown: headings by style, lists by numbering, tables, links, footnotes."""

from __future__ import annotations

import re

from docmd.functions import text as T
from docmd.sources.opc import REL, Package, Unreadable

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Fixed value: list levels are 0 to 8.
LEVELS = 9


def _value(e, *path: str) -> str | None:
    for name in path:
        e = e.find(W + name) if e is not None else None
    return e.get(W + "val") if e is not None else None


_HEADING = re.compile(r"heading\s*([0-9])", re.I)


class Numbering:
    """The numbering part and the counters of a walk through the document."""

    def __init__(self, root) -> None:
        self.formats: dict[tuple[str, int], str] = {}
        self.starts: dict[tuple[str, int], int] = {}
        self.abstract: dict[str, str] = {}
        self.overrides: dict[tuple[str, int], int] = {}
        for a in root.findall(W + "abstractNum") if root is not None else ():
            for level in a.findall(W + "lvl"):
                key = a.get(W + "abstractNumId", ""), int(level.get(W + "ilvl", 0))
                self.formats[key] = _value(level, "numFmt") or "decimal"
                self.starts[key] = int(_value(level, "start") or 1)
        for n in root.findall(W + "num") if root is not None else ():
            own = n.get(W + "numId", "")
            self.abstract[own] = _value(n, "abstractNumId") or ""
            for o in n.findall(W + "lvlOverride"):
                if start := _value(o, "startOverride"):
                    self.overrides[own, int(o.get(W + "ilvl", 0))] = int(start)
        self.counters: dict[str, list[int | None]] = {}
        self.used: set[str] = set()

    def format(self, number: str, level: int) -> str | None:
        """bullet, none, or a number format; None where the paragraph is in no list."""
        list_ = self.abstract.get(number)
        return None if list_ is None or number == "0" else self.formats.get((list_, level), "decimal")

    def next(self, number: str, level: int) -> int:
        """The number of the next item: an override counts at the first item of its instance only, deeper levels begin anew."""
        list_ = self.abstract[number]
        counters = self.counters.setdefault(list_, [None] * LEVELS)
        override = self.overrides.get((number, level)) if number not in self.used else None
        if override is not None:
            counters[level] = override
        elif counters[level] is None:
            counters[level] = self.starts.get((list_, level), 1)
        else:
            counters[level] += 1
        self.used.add(number)
        counters[level + 1 :] = [None] * (LEVELS - level - 1)
        return counters[level]


class Document:
    """A document's Markdown and metadata."""

    def __init__(self, data: bytes) -> None:
        self.package = package = Package(data, "DOCX")
        main = package.main("word/document.xml")
        self.root = package.xml(main)
        if self.root is None:
            raise Unreadable("Cannot read the DOCX file")
        self.relations = package.relations(main)
        part = lambda kind: next((package.xml(t) for k, t, _ in self.relations.values() if k == kind), None)
        styles, self.notes = part("styles"), {}
        self.numbering = Numbering(part("numbering"))
        self.styles = {s.get(W + "styleId", ""): s for s in (styles.findall(W + "style") if styles is not None else ())}
        notes = part("footnotes")
        self.notes = {n.get(W + "id", ""): n for n in (notes.findall(W + "footnote") if notes is not None else ())}
        self.footnotes: list[str] = []
        own = package.properties()
        self.title, self.author = own["title"], own["creator"]
        defaults = styles.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr/{W}lang") if styles is not None else None
        self.language = own["language"] or T.clean(defaults.get(W + "val") if defaults is not None else None)

    def markdown(self) -> str:
        blocks: list[tuple[str, str]] = []
        body = self.root.find(W + "body")
        for e in body if body is not None else ():
            if e.tag == W + "p":
                blocks += self.paragraph(e)
            elif e.tag == W + "tbl":
                blocks += [("table", t) for t in [self.table(e)] if t]
            elif e.tag == W + "sdt":
                lines = [T.escape(x.strip()) for p in e.iter(W + "p") for x in self.text(p).split("\n")]
                text = "\n".join(x for x in lines if x)
                blocks += [("text", text)] if text else []
        out = []
        for k, (kind, text) in enumerate(blocks):
            out.append(("" if not k else "\n" if kind == blocks[k - 1][0] == "item" else "\n\n") + text)
        # of the notes that the text refers to; what a note refers to itself is none of these
        notes = [f"[^{k}]: " + " ".join(x for p in note.iter(W + "p") if (x := self.text(p, False).strip())) for k in self.footnotes if (note := self.notes.get(k)) is not None]
        return T.normalize(T.escape_tags_outside_links("\n\n".join(["".join(out), *notes])))

    def level(self, p) -> int:
        """1 to 6 for a heading, else 0: by the name of the style, or the id of a numbered heading or a style without a name."""
        style = _value(p, "pPr", "pStyle")
        if style is None:
            return 0
        known = self.styles.get(style)
        name = _value(known, "name") if known is not None else None
        name = style if name is None else name
        if name.lower() == "title":
            return 1
        m = _HEADING.fullmatch(name) or _HEADING.fullmatch(style)
        return min(max(int(m[1]), 1), 6) if m else 0

    def _list(self, p) -> tuple[str, int] | None:
        """The numbering instance and level of a paragraph, its own or its style's."""
        style, seen = _value(p, "pPr", "pStyle"), set()
        number, level = _value(p, "pPr", "numPr", "numId"), _value(p, "pPr", "numPr", "ilvl")
        while number is None and style and style not in seen and (known := self.styles.get(style)) is not None:
            seen.add(style)
            number, level = _value(known, "pPr", "numPr", "numId"), level or _value(known, "pPr", "numPr", "ilvl")
            style = _value(known, "basedOn")
        return None if number is None else (number, min(int(level or 0), LEVELS - 1))

    def paragraph(self, p) -> list[tuple[str, str]]:
        text = self.text(p).strip()
        if not text:
            return []
        if level := self.level(p):
            return [("heading", f"{'#' * level} {T.escape(' '.join(x.strip() for x in text.split(chr(10))))}")]
        lines = [T.escape(x) for x in text.split("\n")]
        own = self._list(p)
        kind = self.numbering.format(*own) if own else None
        if kind is None or kind == "none":
            return [("text", "\n".join(lines))]
        marker = "-" if kind == "bullet" else f"{self.numbering.next(*own)}."
        indent = " " * 4 * own[1]
        return [("item", f"\n{indent}{' ' * (len(marker) + 1)}".join([f"{indent}{marker} {lines[0]}", *lines[1:]]))]

    def table(self, e) -> str:
        rows = []
        for row in e.findall(W + "tr"):
            cells = []
            for c in row.iter(W + "tc"):
                cells.append(T.table_cell(" ".join(x for p in c.iter(W + "p") if (x := re.sub(r"\s*\n\s*", " ", self.text(p)).strip()))))
            if cells:
                rows.append(cells)
        if not rows:
            return ""
        width = max(map(len, rows))
        lines = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows]
        return "\n".join([lines[0], f"| {' | '.join(['---'] * width)} |", *lines[1:]])

    def text(self, p, marks: bool = True) -> str:
        """A paragraph's runs: links as Markdown and footnote references (both with marks only), line breaks."""
        out: list[str] = []
        for e in p:
            if e.tag == W + "hyperlink":
                kind, target, outside = self.relations.get(e.get(REL + "id", ""), ("", "", False))
                inner = self.text(e, marks)
                out.append(T.link(inner, target) if marks and outside and kind == "hyperlink" else inner)
            elif e.tag == W + "sdt":
                content = e.find(W + "sdtContent")
                out.append(self.text(content, marks) if content is not None else "")
            elif e.tag in (W + "ins", W + "smartTag", W + "fldSimple", W + "customXml"):
                out.append(self.text(e, marks))
            elif e.tag == W + "r":
                for x in e:
                    if x.tag == W + "t":
                        out.append(x.text or "")
                    elif x.tag in (W + "br", W + "cr"):
                        out.append("\n")
                    elif x.tag == W + "tab":
                        out.append("\t")
                    elif x.tag == W + "noBreakHyphen":
                        out.append("-")
                    elif x.tag == W + "footnoteReference" and marks:
                        own = x.get(W + "id", "")
                        if own not in self.footnotes:
                            self.footnotes.append(own)
                        out.append(f"[^{own}]")
        return "".join(out)


def to_markdown(data: bytes) -> tuple[str, str | None, str | None, str | None]:
    """Markdown, title, author and language of a document."""
    d = Document(data)
    return d.markdown(), d.title, d.author, d.language
