"""HTML pages as Markdown blocks: furniture out, structure kept, links absolute."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

from docmd.functions import text as T
from docmd.sources.htmltree import METADATA, Element, decode, read

# What counts as page furniture, inline text, data tables, and the limits of hostile pages.
FURNITURE = frozenset("script style noscript template svg canvas iframe object embed img picture video audio map input select textarea button nav".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
LAYOUT = frozenset("table ul ol dl pre blockquote h1 h2 h3 h4 h5 h6".split())
PERMALINKS = frozenset("¶§#🔗")
SUPERSCRIPT = dict(zip("0123456789+-=()ni", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ", strict=True))
SUBSCRIPT = dict(zip("0123456789+-=()", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎", strict=True))
MAX_DEPTH, MAX_NESTING, MAX_TABLE_CELLS, MAX_SPAN, MIN_LANGUAGES = 200, 10, 100_000, 50, 3

_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SKIP = re.compile(r"skip\b", re.I)
_SPACES = re.compile(r"\s+")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n")
_TAG = re.compile(r"(\\*)<(?=[A-Za-z/!?]|$)")
_BACKSLASHES = re.compile(r"(\\+)\Z")
_LANGUAGE = re.compile(r"(?:^|\s)(?:lang(?:uage)?-|highlight-|brush:\s*)([\w+#-]+)")
_SCOPE = re.compile(r"(?:source|text)-([^-]+)")


def _is_section(e: Element) -> bool:
    return e.name in ("article", "main", "section") or e.attrs.get("role", "").lower() == "main"


def _is_furniture(e: Element) -> bool:
    a = e.attrs
    return (
        e.name in FURNITURE or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in FURNITURE_ROLES
        or a.get("aria-label", "").lower() == "advertisement" or bool(_HIDDEN.search(a.get("style", "")))
        or (e.name == "span" and "mw-editsection" in a.get("class", "").split())
    )


def _prune(body: Element) -> None:
    """Takes furniture out of the tree, then what can be told only from what is left."""
    stack: list[tuple[Element, bool]] = [(body, False)]
    while stack:
        e, inside = stack.pop()
        inside = inside or _is_section(e)
        e.children = [c for c in e.children if isinstance(c, str) or not (_is_furniture(c) or (not inside and c.name in ("header", "footer", "aside")))]
        stack += [(c, inside) for c in e.children if isinstance(c, Element)]
    stack = [(body, False)]
    while stack:
        e, _ = stack.pop()
        e.children = [c for c in e.children if isinstance(c, str) or not (_is_language_list(c) or _is_page_link(c))]
        stack += [(c, False) for c in e.children if isinstance(c, Element)]


#: What makes an address a syntax error: characters, half escapes, brackets in the path.
_SYNTAX = re.compile(r'[\s<>"{}|\\^`]|%(?![0-9A-Fa-f]{2})|^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?[^?#]*[\[\]]')


def _is_language_list(e: Element) -> bool:
    if e.name not in ("ul", "ol"):
        return False
    items = [c for c in e.children if isinstance(c, Element)]

    def is_link(item: Element) -> bool:
        inner = [c for c in item.children if isinstance(c, Element)]
        return len(inner) == 1 and inner[0].name == "a" and "hreflang" in inner[0].attrs and not "".join(c for c in item.children if isinstance(c, str)).strip()

    return len(items) >= MIN_LANGUAGES and all(map(is_link, items))


def _is_page_link(e: Element) -> bool:
    if e.name != "a" or "#" not in (href := e.attrs.get("href", "")):
        return False
    return e.text() in PERMALINKS or (href.startswith("#") and bool(_SKIP.match(e.text())))


def _absolute(url: str | None) -> str | None:
    try:
        return url if url and urlsplit(url).scheme.lower() in ("http", "https") and len(url.split("://", 1)[-1]) > 0 and "://" in url else None
    except ValueError:
        return None


def _join(base: str, url: str) -> str | None:
    try:
        return urljoin(base, url)
    except ValueError:
        return None


def _without_user(url: str | None) -> str | None:
    """The address without user and password; where there are some, also without its fragment."""
    try:
        parts = urlsplit(url or "")
        if "@" not in parts.netloc:
            return url
        return parts._replace(netloc=parts.netloc.rpartition("@")[2], fragment="").geturl()
    except ValueError:
        return None


def base_address(root: Element, source: str | None) -> str | None:
    """The first absolute address of: every <base>, the page's own, every canonical link, every og:url."""
    source = _absolute(_without_user(source))
    given: dict[str, list[str]] = {"base": [], "link": [], "meta": []}
    for e in root.walk():
        own = e.attrs
        if e.name == "base" and "href" in own:
            href = own["href"].strip()
            given["base"].append(_join(source, href) or href if source and not _SYNTAX.search(href) else href)
        elif e.name == "link" and own.get("rel", "").strip().lower() == "canonical" and "href" in own:
            given["link"].append(own["href"])
        elif e.name == "meta" and own.get("property", "").lower() == "og:url" and "content" in own:
            given["meta"].append(own["content"])
    every = [*given["base"], *([source] if source else []), *given["link"], *given["meta"]]
    return next((x.strip() for x in every if _absolute(x.strip()) and not _SYNTAX.search(x.strip())), None)


class Page:
    """A page's metadata and Markdown."""

    def __init__(self, html: str, source: str | None = None) -> None:
        root, head, body = read(html)
        elements = [e for e in head.children if isinstance(e, Element)]
        self.title = T.clean(next((e.text() for e in elements if e.name == "title"), None))
        self.author = T.clean(next((e.attrs.get("content") for e in elements if e.name == "meta" and e.attrs.get("name", "").lower() == "author"), None))
        self.language = T.clean(root.attrs.get("lang"))
        self.base = base_address(root, source)
        _prune(body)
        mains = [e for e in body.walk() if e.name == "main" or e.attrs.get("role", "").lower() == "main"]
        self.content = mains[0] if len(mains) == 1 else body
        self.nesting = 0

    def markdown(self) -> str:
        blocks = self.blocks(self.content, 0)
        if self.title and not any(e.name == "h1" for e in self.content.walk()):
            blocks.insert(0, "# " + T.escape(T.escape_tags(self.title)))
        return T.normalize("\n\n".join(without_empty_headings(blocks)))

    def blocks(self, e: Element, depth: int) -> list[str]:
        """The blocks of an element's children."""
        if depth > MAX_DEPTH:
            return _paragraphs(e.text())
        out: list[str] = []
        run: list = []

        def flush() -> None:
            out.extend(_paragraphs(self.inline(run, depth)))
            run.clear()

        for child in e.children:
            if isinstance(child, str) or child.name in INLINE:
                run.append(child)
            elif child.name not in METADATA:
                flush()
                out += self.block(child, depth + 1)
        flush()
        return out

    def block(self, e: Element, depth: int) -> list[str]:
        name = e.name
        if len(name) == 2 and name[0] == "h" and name[1] in "123456":
            line = _one_line(self.inline(e.children, depth))
            return [f"{'#' * int(name[1])} {T.escape(line)}"] if line else []
        if name in ("ul", "ol", "menu", "blockquote"):
            if self.nesting >= MAX_NESTING:
                return self.blocks(e, depth)
            self.nesting += 1
            try:
                return self.quote(e, depth) if name == "blockquote" else self.list(e, depth)
            finally:
                self.nesting -= 1
        if name == "pre":
            return code_block(e)
        if name == "table":
            return self.table(e, depth)
        return [] if name == "hr" else self.blocks(e, depth)

    def quote(self, e: Element, depth: int) -> list[str]:
        text = "\n\n".join(self.blocks(e, depth))
        return ["\n".join(f"> {x}" if x else ">" for x in text.split("\n"))] if text else []

    def list(self, e: Element, depth: int) -> list[str]:
        try:
            number = int(e.attrs.get("start", "1").strip()) if e.name == "ol" else None
        except ValueError:
            number = 1
        items = []
        for item in e.children:
            content = self.blocks(item, depth + 1) if isinstance(item, Element) and item.name == "li" else []
            if content:
                marker = "-" if number is None else f"{number}."
                number = None if number is None else number + 1
                lines = [f"{marker} " + content[0].replace("\n", "\n" + " " * (len(marker) + 1))]
                lines += ["    " + line for block in content[1:] for line in block.split("\n")]
                items.append("\n".join(lines))
        return ["\n".join(items)] if items else []

    def table(self, e: Element, depth: int) -> list[str]:
        sections = [c for c in e.children if isinstance(c, Element)]
        own_rows = [r for s in sections for r in ([s] if s.name == "tr" else s.children if s.name in ("thead", "tbody", "tfoot") else []) if isinstance(r, Element) and r.name == "tr"]
        grid = [[(c, self._span(c)) for c in r.children if isinstance(c, Element) and c.name in ("td", "th")] for r in own_rows]
        grid = [row for row in grid if row]
        if not grid:
            return [b for s in sections for b in (_paragraphs(self.inline(s.children, depth)) if s.name == "caption" else self.blocks(s, depth + 1))]
        cells = [c for row in grid for c, _ in row]
        width = max(sum(n for _, n in row) for row in grid)
        is_layout = 2 * sum(not c.text() for c in cells) > len(cells) or any(map(_is_layout, cells)) or width * len(grid) > MAX_TABLE_CELLS
        if is_layout:
            return [b for c in cells for b in self.blocks(c, depth + 1)]

        def line(row: list) -> str:
            shown = [x for c, n in row for x in (T.table_cell(_one_line(self.inline(c.children, depth, flat=True))), *[""] * (n - 1))]
            return f"| {' | '.join(shown + [''] * (width - len(shown)))} |"

        head, *rest = map(line, grid)
        captions = [b for s in sections if s.name == "caption" for b in _paragraphs(self.inline(s.children, depth))]
        return [*captions, "\n".join([head, f"| {' | '.join(['---'] * width)} |", *rest])]

    @staticmethod
    def _span(cell: Element) -> int:
        try:
            return min(max(int(cell.attrs.get("colspan", "1").strip()), 1), MAX_SPAN)
        except ValueError:
            return 1

    def inline(self, nodes: list, depth: int, flat: bool = False) -> str:
        """The inline Markdown of some nodes."""
        out: list[str] = []
        before: Element | None = None
        for node in nodes:
            if isinstance(node, str):
                out.append(_BACKSLASHES.sub(r"\1\1", _TAG.sub(r"\1\1\\<", _SPACES.sub(" ", node))))
                before = None
                continue
            if node.name in METADATA:
                continue
            if flat and node.name not in INLINE and out and not out[-1].endswith((" ", "\n")):
                out.append(" ")
            if before is not None and "a" in (node.name, before.name) and out and out[-1] and not out[-1][-1].isspace():
                left, right = before.text(), node.text()
                if left and right and left[-1].isalnum() and right[0].isalnum():
                    out.append(" ")
            out.append(self.element(node, depth, flat))
            before = node
        return "".join(out)

    def element(self, e: Element, depth: int, flat: bool) -> str:
        if depth > MAX_DEPTH:
            return e.text()
        if e.name == "br":
            return "\n"
        if e.name in ("code", "kbd", "samp"):
            return code_span(e.text())
        inner = self.inline(e.children, depth + 1, flat)
        if e.name == "a":
            return T.link(_SPACES.sub(" ", inner), self.resolve(e.attrs.get("href", "")), True)
        if e.name in ("sup", "sub"):
            table = SUPERSCRIPT if e.name == "sup" else SUBSCRIPT
            plain = inner.strip().replace("−", "-")
            return "".join(table[c] for c in plain) if all(c in table for c in plain) else inner
        return inner

    def resolve(self, href: str) -> str | None:
        """A link's absolute address; None for fragments and for relative ones of a page without an address."""
        href = href.strip()
        if not href or href.startswith("#"):
            return None
        if _SYNTAX.search(href):
            return None
        try:
            if urlsplit(href).scheme:
                return href
        except ValueError:
            return None
        if href.startswith("?") and self.base:
            # a query alone replaces the last part of the path as well
            parts = urlsplit(self.base)
            return parts._replace(path=parts.path.rpartition("/")[0] + "/", query=href[1:].partition("#")[0], fragment=href.partition("#")[2]).geturl()
        return _join(self.base, href) if self.base else None


def _is_layout(cell: Element) -> bool:
    for e in cell.walk():
        if e.name in LAYOUT:
            return True
        if e.name == "p" and e.parent is not None:
            siblings = [c for c in e.parent.children if isinstance(c, Element)]
            if any(x.name == y.name == "p" for x, y in zip(siblings, siblings[1:], strict=False)):
                return True
    return False


def _one_line(text: str) -> str:
    return _SPACES.sub(" ", text).strip()


def _paragraphs(text: str) -> list[str]:
    out = []
    for part in _BLANK_LINE.split(text):
        lines = [_one_line(x) for x in part.split("\n")]
        if own := [T.escape(x) for x in lines if x]:
            out.append("\n".join(own))
    return out


def _fence(text: str, least: int) -> str:
    return "`" * max(least, 1 + max((len(m) for m in re.findall(r"`+", text)), default=0))


def code_span(text: str) -> str:
    """Code inside a line, in a fence longer than any run of backticks in it."""
    if not text:
        return ""
    fence = _fence(text, 1)
    pad = " " if text[0] == "`" or text[-1] == "`" else ""
    return fence + pad + text + pad + fence


def code_block(e: Element) -> list[str]:
    """A fenced block, with the language that a highlighter's class names."""
    text = e.whole_text()
    text = (text[1:] if text.startswith("\n") else text[2:] if text.startswith("\r\n") else text).rstrip()
    code = next((x for x in e.walk() if x.name == "code"), None)
    language = ""
    for owner in (e, code, e.parent, e.parent and e.parent.parent):
        if owner is not None and (m := _LANGUAGE.search(owner.attrs.get("class", ""))):
            name = m[1].lower()
            scope = _SCOPE.match(name)
            language = scope[1] if scope else name
            break
    fence = _fence(text, 3)
    return [f"{fence}{language}\n{text}\n{fence}"]


def _level(block: str) -> int:
    """The level of a heading block, 0 for another block."""
    n = len(block) - len(block.lstrip("#"))
    return n if 1 <= n <= 6 and block[n : n + 1] == " " else 0


def without_empty_headings(blocks: list[str]) -> list[str]:
    """Blocks without headings below level 1 that nothing of their own follows."""
    kept: list[str] = []
    after = 1  # the level of the kept block after this one; as if a title followed the last
    for block in reversed(blocks):
        level = _level(block)
        if level > 1 and (not kept or 0 < after < level):
            continue
        kept.append(block)
        after = level
    return kept[::-1]


def to_markdown(data: bytes | str, source: str | None = None) -> tuple[str, str | None, str | None, str | None]:
    """Markdown, title, author and language of a page."""
    page = Page(decode(data) if isinstance(data, bytes) else data, source)
    return page.markdown(), page.title, page.author, page.language
