"""HTML trees as browsers build them: start tags that end others, formatting that outlives its block, text that a table
puts before itself. Linear in the markup but for bounded looks up the open elements."""

from __future__ import annotations

import codecs
import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
METADATA = frozenset("title meta link base head".split())
#: Fixed values of the HTML standard: blocks, whose start tags end an open paragraph and whose end tags end what is open in them.
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p pre search section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = BLOCKS | VOID - {"path"} | METADATA | frozenset("applet body button caption colgroup frame frameset html iframe marquee noembed noframes noscript object script select style tbody td template textarea tfoot th thead tr xmp".split())
#: What ends a look for an open element: of all kinds, of items, of paragraphs, of parts of a table.
SCOPE = frozenset("applet caption html table td th marquee object template".split())
ITEM_SCOPE, BUTTON_SCOPE, TABLE_SCOPE = SCOPE | {"ol", "ul"}, SCOPE | {"button"}, frozenset("html table template".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
ROW_GROUPS, CELLS = frozenset("tbody thead tfoot".split()), frozenset("td th".split())
TABLE_PARTS = ROW_GROUPS | CELLS | {"caption", "col", "colgroup", "tr"}
#: Open elements whose text and other elements go before their table.
FOSTERS = ROW_GROUPS | {"table", "tr"}
_MODES = TABLE_PARTS - {"col"} | {"table", "template"}
_MARKED = frozenset("applet marquee object template".split())
#: How far up a look goes, how often one end tag is resolved, how many equal formatting elements are kept.
LOOK_UP, ROUNDS, SAME = 256, 8, 3


class Element:
    """An element: its name, attributes, and children (elements and strings)."""

    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self):
        """All elements below, in document order, without recursion."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, Element):
                yield child
                stack.append(iter(child.children))

    def text(self) -> str:
        """The text below, blanks as one space, none at the ends; blocks and line breaks part words."""
        parts: list[str] = []
        stack: list = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, str):
                parts.append(child)
            else:
                if child.name == "br" or child.name in BLOCKS or child.name in ("td", "th", "tr"):
                    parts.append(" ")
                stack.append(iter(child.children))
        return " ".join(re.split(r"[ \t\n\r\f]+", "".join(parts))).strip(" ")

    def whole_text(self) -> str:
        """The text below as it is."""
        parts: list[str] = []
        stack: list = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, str):
                parts.append(child)
            else:
                if child.name == "br":
                    parts.append("\n")
                stack.append(iter(child.children))
        return "".join(parts)


class _Reader(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style", "noscript", "iframe", "xmp", "noembed", "noframes")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {}, None)
        self.head = Element("head", {}, self.root)
        self.body = Element("body", {}, self.root)
        self.root.children += [self.head, self.body]
        self.stack = [self.body]
        self.open: dict[str, int] = {}
        self.parts: list[Element] = []  # the open elements that say how a table is read
        self.active: list[Element | None] = []  # formatting that is in force; None bounds what a cell or an object has

    # The open elements

    @property
    def mode(self) -> str:
        return self.parts[-1].name if self.parts else "body"

    def push(self, e: Element) -> None:
        self.stack.append(e)
        self.open[e.name] = self.open.get(e.name, 0) + 1
        if e.name in _MODES:
            self.parts.append(e)

    def pop(self) -> Element:
        e = self.stack.pop()
        self.open[e.name] -= 1
        if self.parts and self.parts[-1] is e:
            self.parts.pop()
        return e

    def pop_to(self, index: int) -> None:
        while len(self.stack) > max(index, 1):
            self.pop()

    def where(self, names, bounds=SCOPE) -> int:
        """The place of the innermost open element of these names, within the bounds; 0 for none."""
        if any(self.open.get(n) for n in names):
            for k in range(len(self.stack) - 1, max(0, len(self.stack) - 1 - LOOK_UP), -1):
                if self.stack[k].name in names:
                    return k
                if self.stack[k].name in bounds:
                    break
        return 0

    def end(self, names, bounds=SCOPE) -> bool:
        """Ends the innermost of these elements and all in it."""
        k = self.where(names, bounds)
        if k:
            self.pop_to(k)
        return k > 0

    def end_implied(self, but: str = "") -> None:
        while self.stack[-1].name in IMPLIED and self.stack[-1].name != but and len(self.stack) > 1:
            self.pop()

    def end_item(self, names: tuple[str, ...]) -> None:
        """Ends an open item, unless another block than a division or paragraph is open in it."""
        for k in range(len(self.stack) - 1, max(0, len(self.stack) - 1 - LOOK_UP), -1):
            own = self.stack[k].name
            if own in names:
                self.pop_to(k)
            if own in names or (own in SPECIAL and own not in ("address", "div", "p")):
                return

    # Where nodes go

    def add(self, node: Element | str, target: Element | None = None) -> None:
        """Puts a node at the end of the target, by default the innermost element; of a table, before it."""
        parent = target or self.stack[-1]
        before = None
        if parent.name in FOSTERS and not (isinstance(node, Element) and (node.name in TABLE_PARTS or node.name in ("script", "style"))):
            table = next((e for e in reversed(self.stack) if e.name == "table"), None)
            if table is not None and table.parent is not None:
                parent, before = table.parent, table
        if isinstance(node, Element):
            node.parent = parent
        if before is None:
            parent.children.append(node)
        else:
            at = len(parent.children) - 1
            while at > 0 and parent.children[at] is not before:
                at -= 1
            if isinstance(node, str) and at and isinstance(parent.children[at - 1], str):
                parent.children[at - 1] += node
            else:
                parent.children.insert(at, node)

    def insert(self, tag: str, attrs: dict[str, str], formatting: bool = False) -> Element:
        e = Element(tag, attrs, None)
        self.add(e)
        self.push(e)
        if formatting:
            self.keep(e)
        return e

    # Formatting

    def keep(self, e: Element) -> None:
        alike = []
        for x in reversed(self.active):
            if x is None:
                break
            if x.name == e.name and x.attrs == e.attrs:
                alike.append(x)
        if len(alike) >= SAME:
            self.active.remove(alike[-1])
        self.active.append(e)

    def bound(self) -> None:
        """Ends the formatting since the last bound."""
        while self.active and self.active.pop() is not None:
            pass

    def is_open(self, e: Element) -> bool:
        return bool(self.open.get(e.name)) and any(x is e for x in reversed(self.stack))

    def restore(self) -> None:
        """Opens formatting again that a block's end has closed."""
        first = len(self.active)
        while first and self.active[first - 1] is not None and not self.is_open(self.active[first - 1]):
            first -= 1
        for k in range(first, len(self.active)):
            self.active[k] = self.insert(self.active[k].name, self.active[k].attrs)

    def forget(self, e: Element) -> None:
        self.active = [x for x in self.active if x is not e]

    def end_formatting(self, tag: str) -> None:
        """Ends formatting. A block that is open in it is taken out and formatted anew inside, so that both ends hold."""
        top = self.stack[-1]
        if top.name == tag and not any(x is top for x in self.active):
            self.pop()
            return
        for _ in range(ROUNDS):
            since = next((k + 1 for k in range(len(self.active) - 1, -1, -1) if self.active[k] is None), 0)
            of = next((x for x in reversed(self.active[since:]) if x.name == tag), None)
            if of is None:
                self.end_other(tag)
                return
            at = next((k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k] is of), 0)
            if not at:
                self.forget(of)
                return
            if any(e.name in SCOPE for e in self.stack[at + 1 :]):
                return
            deep = next((k for k in range(at + 1, len(self.stack)) if self.stack[k].name in SPECIAL), 0)
            if not deep:
                self.pop_to(at)
                self.forget(of)
                return
            self.take_out(of, at, deep)

    def take_out(self, of: Element, at: int, deep: int) -> None:
        block, outer = self.stack[deep], self.stack[at - 1]
        mark = next(k for k, x in enumerate(self.active) if x is of)
        last = block
        for n, node in enumerate(reversed(self.stack[at + 1 : deep]), 1):
            held = any(x is node for x in self.active)
            if held and n > 3:
                self.forget(node)
            if not held or n > 3:
                self._drop(node)
                continue
            copy = Element(node.name, node.attrs, node.parent)
            k = next(i for i, x in enumerate(self.active) if x is node)
            self.active[k] = copy
            self.stack[next(i for i, x in enumerate(self.stack) if x is node)] = copy
            mark = k + 1 if last is block else mark
            self._move(last, copy)
            last = copy
        _detach(last)
        self.add(last, outer)
        inside = Element(of.name, of.attrs, block)
        inside.children, block.children = block.children, [inside]
        for c in inside.children:
            if isinstance(c, Element):
                c.parent = inside
        old = next((k for k, x in enumerate(self.active) if x is of), None)
        self.active.insert(min(mark, len(self.active)), inside)
        if old is not None:
            self.forget(of)
        self._drop(of)
        self.stack.insert(next(i for i, x in enumerate(self.stack) if x is block) + 1, inside)
        self.open[inside.name] = self.open.get(inside.name, 0) + 1

    def _drop(self, e: Element) -> None:
        """Takes an element off the open ones, wherever it is among them."""
        k = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i] is e), 0)
        if k:
            del self.stack[k]
            self.open[e.name] -= 1

    @staticmethod
    def _move(node: Element, to: Element) -> None:
        _detach(node)
        node.parent = to
        to.children.append(node)

    # Tokens

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        if tag in ("html", "body", "head"):
            target = {"html": self.root, "body": self.body, "head": self.head}[tag].attrs
            for k, v in own.items():
                target.setdefault(k, v)
            return
        if tag == "title" and self.open.get("svg"):
            tag = "svg-title"
        if tag in METADATA:
            e = Element(tag, own, self.head)
            self.head.children.append(e)
            if tag == "title":
                self.push(e)
            return
        if self.open.get("select") and not self.in_select(tag):
            return
        if (self.parts or tag in TABLE_PARTS) and self.part_of_table(tag, own):
            return
        self.in_body(tag, own)

    def in_select(self, tag: str) -> bool:
        """Whether a start tag is read on while a list of options is open."""
        if tag in ("input", "textarea", "select") or (self.parts and tag in TABLE_PARTS | {"table"}):
            self.end(("select",), TABLE_SCOPE)
            return tag != "select"
        return tag in ("option", "optgroup", "script", "template", "hr")

    def part_of_table(self, tag: str, attrs: dict[str, str]) -> bool:
        """Reads a start tag as a part of the innermost table; False where it is none. What is open in a smaller part ends."""
        while True:
            mode = self.mode
            if mode in ("body", "template"):
                # a part without a table is no element
                return tag in TABLE_PARTS and mode == "body"
            if mode in CELLS or mode == "caption":
                if tag not in TABLE_PARTS:
                    return False
                self.close_part()
                continue
            if mode == "colgroup":
                if tag == "col":
                    self.insert(tag, attrs)
                    self.pop()
                    return True
                self.close_part()
                continue
            if tag == "table":
                self.pop_to(self.where(("table",), TABLE_SCOPE))
                continue
            if tag not in TABLE_PARTS:
                return False
            self.clear()
            if tag in CELLS:
                if mode == "tr":
                    self.insert(tag, attrs)
                    self.active.append(None)
                    return True
                self.insert("tr" if mode in ROW_GROUPS else "tbody", {})
            elif tag == "tr" and mode != "tr":
                if mode in ROW_GROUPS:
                    self.insert(tag, attrs)
                    return True
                self.insert("tbody", {})
            elif mode != "table":
                self.pop()
            elif tag == "col":
                self.insert("colgroup", {})
            else:
                self.insert(tag, attrs)
                if tag == "caption":
                    self.active.append(None)
                return True

    def clear(self) -> None:
        """Ends what is open in the innermost part of a table."""
        while len(self.stack) > 1 and self.stack[-1] is not self.parts[-1]:
            self.pop()

    def close_part(self) -> None:
        part = self.parts[-1]
        self.clear()
        self.pop()
        if part.name in CELLS or part.name == "caption":
            self.bound()

    def in_body(self, tag: str, attrs: dict[str, str]) -> None:
        if self.open.get("svg") or self.open.get("math"):
            if tag in BLOCKS or tag in FORMATTING or tag in ("br", "span", "img", "ruby", "sub", "sup"):
                self.end(("svg", "math"))
        if tag in BLOCKS:
            if tag == "li":
                self.end_item(("li",))
            elif tag in ("dd", "dt"):
                self.end_item(("dd", "dt"))
            self.end(("p",), BUTTON_SCOPE)
            if tag in HEADINGS and self.stack[-1].name in HEADINGS:
                self.pop()
            self.insert(tag, attrs)
        elif tag in FORMATTING:
            if tag in ("a", "nobr"):
                for x in reversed(self.active):
                    if x is None:
                        break
                    if x.name == tag:
                        self.end_formatting(tag)
                        self.forget(x)
                        self._drop(x)
                        break
            self.restore()
            self.insert(tag, attrs, formatting=True)
        else:
            if tag == "button":
                self.end(("button",))
            elif tag in ("option", "optgroup") and self.stack[-1].name == "option":
                self.pop()
            elif tag in ("rb", "rp", "rt", "rtc") and self.where(("ruby",)):
                self.end_implied("rtc" if tag in ("rp", "rt") else "")
            if tag not in ("script", "style", "template", "noscript"):
                self.restore()
            self.insert(tag, attrs)
            if tag in _MARKED:
                self.active.append(None)
        if tag in VOID:
            self.pop()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        before = len(self.stack)
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML, but in drawings and formulas
        if len(self.stack) == before + 1 and (self.open.get("svg") or self.open.get("math")) and self.stack[-1].name == tag:
            self.pop()

    def handle_endtag(self, tag: str) -> None:
        if self.open.get("select") and tag not in ("option", "optgroup", "select", "script", "template") and not (self.parts and tag in TABLE_PARTS | {"table"}):
            return
        if self.parts and (tag == "table" or tag in TABLE_PARTS):
            self.end_part(tag)
        elif tag in ("body", "html", "head") or tag in TABLE_PARTS:
            return
        elif tag == "br":
            self.in_body("br", {})
        elif tag == "p":
            if not self.where(("p",), BUTTON_SCOPE):
                self.insert("p", {})
            self.end(("p",), BUTTON_SCOPE)
        elif tag in FORMATTING:
            self.end_formatting(tag)
        elif tag in HEADINGS:
            self.end(HEADINGS)
        elif tag == "li":
            self.end(("li",), ITEM_SCOPE)
        elif tag in BLOCKS or tag == "button" or tag in _MARKED or tag == "select":
            if self.end((tag,), TABLE_SCOPE if tag == "select" else SCOPE) and tag in _MARKED:
                self.bound()
        else:
            self.end_other(tag)

    def end_part(self, tag: str) -> None:
        """Ends a part of the innermost table, and the smaller ones in it; one that isn't open ends nothing."""
        if tag not in ("col", "template") and any(p.name == tag for p in self._table()):
            while self.parts and self.parts[-1].name != tag:
                self.close_part()
            self.close_part()

    def _table(self) -> list[Element]:
        """The open parts of the innermost table, from the inside."""
        own = []
        for p in reversed(self.parts):
            if p.name == "template":
                break
            own.append(p)
            if p.name == "table":
                break
        return own

    def end_other(self, tag: str) -> None:
        if self.open.get(tag):
            for k in range(len(self.stack) - 1, max(0, len(self.stack) - 1 - LOOK_UP), -1):
                if self.stack[k].name == tag:
                    self.pop_to(k)
                    return
                if self.stack[k].name in SPECIAL:
                    return

    def handle_data(self, data: str) -> None:
        if self.mode == "colgroup" and data.strip():
            self.close_part()
        top = self.stack[-1]
        if top.name in FOSTERS and not data.strip():
            top.children.append(data)
            return
        if self.active:
            self.restore()
        self.add(data)


def _detach(e: Element) -> None:
    own = e.parent.children if e.parent is not None else []
    for k in range(len(own) - 1, -1, -1):
        if own[k] is e:
            del own[k]
            return


def read(html: str) -> tuple[Element, Element, Element]:
    """The root, head and body of a page."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.root, reader.head, reader.body


_META_CHARSET = re.compile(rb"<meta[^>]*?charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)


def decode(data: bytes) -> str:
    """The text of a page: by its byte order mark, its first meta charset, else UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    if m := _META_CHARSET.search(data[:8192]):
        try:
            return data.decode(codecs.lookup(m[1].decode()).name, "replace")
        except LookupError:
            pass
    return data.decode("utf-8", "replace")
