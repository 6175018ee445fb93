"""What a tagged PDF's structure tree says of its marked content: headings, and tables with their cells.

Content is known by (page from 1, mark). A tree may be deep, shared or a loop: each element is entered once, and none
below MAX_DEPTH.
"""

from __future__ import annotations

from collections.abc import Iterator

from docmd.sources.pdfobjects import File, Ref

# How deep a tree is followed, and the least rows and columns of a table (smaller ones are layout).
MAX_DEPTH, MIN_ROWS, MIN_COLUMNS = 100, 2, 2
_HEADINGS = {f"H{n}": n for n in range(1, 7)}


class Marks:
    """headings: level of content; cells: (table, row, column) of content; shapes: the cells in each row of each table;
    blank: tables that have header cells, but not all along the first row."""

    def __init__(self, file: File) -> None:
        self.file, self.entered = file, set()
        self.headings: dict[tuple[int, int], int] = {}
        self.cells: dict[tuple[int, int], tuple[int, int, int]] = {}
        self.shapes: list[list[int]] = []
        self.blank: list[bool] = []
        root = file.get(file.root.get("StructTreeRoot"))
        if isinstance(root, dict):
            roles = file.get(root.get("RoleMap"))
            self.roles = roles if isinstance(roles, dict) else {}
            self._search(root, 0, 0)

    def _kids(self, node: dict) -> list:
        kids = self.file.get(node.get("K"))
        return kids if isinstance(kids, list) else [node["K"]] if "K" in node else []

    def _page(self, node: dict, inherited: int) -> int:
        page = node.get("Pg")
        return self.file.page_numbers.get(int(page), 0) if isinstance(page, Ref) else inherited

    def _kind(self, element: dict) -> str:
        own = self.file.get(element.get("S"))
        return str(self.file.get(self.roles.get(own)) or own or "")

    def _elements(self, node: dict, page: int, depth: int) -> Iterator[tuple[dict, int]]:
        """The child elements that were not entered before, with their pages."""
        for kid in self._kids(node):
            element = self.file.get(kid)
            place = int(kid) if isinstance(kid, Ref) else ("direct", id(kid))
            if depth < MAX_DEPTH and isinstance(element, dict) and "S" in element and place not in self.entered:
                self.entered.add(place)
                yield element, self._page(element, page)

    def _content(self, node: dict, page: int, depth: int) -> Iterator[tuple[int, int]]:
        """The content of an element and of all below it."""
        for kid in self._kids(node):
            value = self.file.get(kid)
            if isinstance(value, int) and not isinstance(value, bool):
                yield page, value
            elif isinstance(value, dict) and "S" not in value and isinstance(mark := self.file.get(value.get("MCID")), int):
                yield self._page(value, page), mark
        for element, at in self._elements(node, page, depth):
            yield from self._content(element, at, depth + 1)

    def _search(self, node: dict, page: int, depth: int) -> None:
        for element, at in self._elements(node, page, depth):
            kind = self._kind(element)
            if kind == "Table":
                self._table(element, at, depth + 1)
            elif kind in _HEADINGS:
                self.headings |= dict.fromkeys(self._content(element, at, depth + 1), _HEADINGS[kind])
            else:
                self._search(element, at, depth + 1)

    def _rows(self, node: dict, page: int, depth: int) -> Iterator[list[tuple[str, list[tuple[int, int]]]]]:
        """The kind and content of the cells of each row; rows may be in groups."""
        for element, at in self._elements(node, page, depth):
            if self._kind(element) == "TR":
                yield [(self._kind(cell), list(self._content(cell, of, depth + 2))) for cell, of in self._elements(element, at, depth + 1)]
            else:
                yield from self._rows(element, at, depth + 1)

    def _table(self, element: dict, page: int, depth: int) -> None:
        rows = list(self._rows(element, page, depth))
        if len(rows) < MIN_ROWS or max(map(len, rows)) < MIN_COLUMNS:
            return
        table = len(self.shapes)
        for r, row in enumerate(rows):
            for c, (_, content) in enumerate(row):
                self.cells |= dict.fromkeys(content, (table, r, c))
        kinds = [{kind for kind, _ in row} for row in rows]
        self.shapes.append([len(row) for row in rows])
        self.blank.append(any("TH" in k for k in kinds) and not ("TH" in kinds[0] and "TD" not in kinds[0]))
