"""Python twins of the column functions, for parsers that write Markdown while they walk a document."""

from __future__ import annotations

import re

from docmd.functions import patterns as P

_RULE, _MARKER = re.compile(P.RULE_LINE, re.A), re.compile(P.BLOCK_MARKER, re.A)
_TAG, _PIPE = re.compile(P.TAG_START), re.compile(P.PIPE)
_SAFE, _EMAIL = re.compile(P.SAFE_URL, re.A), re.compile(P.EMAIL)
_NO_AUTOLINK, _LINKS = re.compile(P.NOT_IN_AUTOLINK, re.A), re.compile(P.LINK_SYNTAX, re.A)
_ADDRESS, _ADDRESS_END = re.compile(P.ADDRESS_LIKE), re.compile(P.ADDRESS_END)
_ANGLE, _URL_END, _BREAKS = re.compile(r"[\s()<>]", re.A), re.compile(r"(?:\s|%20)+\Z", re.A), re.compile(r"[\r\n]+")
_LINE_END, _TRAILING, _BLANKS, _EDGES = re.compile(r"\r\n?"), re.compile(P.WS + r"+(\n|\Z)"), re.compile(r"\n{3,}"), re.compile(r"\A\n+|\n+\Z")


def escape(line: str) -> str:
    """A line that no renderer takes for block syntax."""
    if _RULE.match(line):
        blank = len(line) - len(line.lstrip(" \t\n\x0b\f\r"))
        return line[:blank] + "\\" + line[blank:]
    return _MARKER.sub(r"\1\\\2", line)


def escape_tags(text: str) -> str:
    """Text in which nothing reads as a tag."""
    return _TAG.sub(r"\1\1\\<", text)


def escape_tags_outside_links(markdown: str) -> str:
    """The same, but for link targets and addresses in angle brackets."""
    out, at = [], 0
    for m in _LINKS.finditer(markdown):
        out += [escape_tags(markdown[at : m.start()]), m[0]]
        at = m.end()
    # a tag's lookahead must not see beyond a kept link, and can't: links begin with "]" or "<"
    return "".join([*out, escape_tags(markdown[at:])])


def table_cell(text: str) -> str:
    """Text whose pipes don't end a cell."""
    return _PIPE.sub(r"\1\1\\|", text)


def encode_controls(url: str) -> str:
    """Control characters as percent-encoded UTF-8."""
    return "".join("".join(f"%{b:02X}" for b in c.encode()) if ord(c) < 32 or 127 <= ord(c) < 160 else c for c in url)


def is_part_of_address(label: str, url: str) -> bool:
    """Whether a label is a piece of the address, as of one printed over two lines."""
    label = _ADDRESS_END.sub("", label)
    if not label or " " in label:
        return False
    return (bool(_ADDRESS.search(label)) and label in url) or ("." in label and url.endswith(label))


def link(text: str, url: str | None, whole: bool = False) -> str:
    """A Markdown link, an autolink, or the text alone where a link would add nothing or be unsafe."""
    label = text.strip()
    target = _URL_END.sub("", (url or "").strip())
    if not label or url is None:
        return text
    before, after = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    if label == target or f"mailto:{label}".lower() == target.lower():
        fits = not _NO_AUTOLINK.search(label) and (_SAFE.match(label) or _EMAIL.fullmatch(label))
        return f"{before}<{label}>{after}" if fits else text
    if not _SAFE.match(target) or (not whole and is_part_of_address(label, target)):
        return text
    target = encode_controls(target)
    if _ANGLE.search(target):
        target = "<" + target.replace("<", "%3C").replace(">", "%3E") + ">"
    label = _BREAKS.sub(" ", label).replace("[", "\\[").replace("]", "\\]")
    return f"{before}[{label}]({target}){after}"


def normalize(text: str) -> str:
    """One kind of line end, no blanks at line ends, at most one blank line, one line end at the end."""
    text = _LINE_END.sub("\n", text)
    text = _TRAILING.sub(r"\1", text)
    text = _EDGES.sub("", _BLANKS.sub("\n\n", text))
    return text + "\n" if text else ""


def clean(value: str | None) -> str | None:
    """A metadata value: blanks as one space, none at the ends, null when empty."""
    return re.sub(r"\s+", " ", value, flags=re.A).strip() or None if value is not None else None
