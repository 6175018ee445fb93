"""Markdown text functions as native column expressions. Nulls stay null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmd.functions import patterns as P

_STRIP = P.WS[:-1] + r"\n\r]"
# the same as P.WS; one look at a character's range rules most out
_WS = rf"[\x00-\x20\u1680-\u3000&&{P.WS}]"


def escape(line: Column) -> Column:
    """A line that no renderer takes for block syntax."""
    return F.when(line.rlike(P.RULE_LINE), F.regexp_replace(line, r"^(\s*)", r"$1\\")).otherwise(F.regexp_replace(line, P.BLOCK_MARKER, r"$1\\$2"))


def escape_tags(text: Column) -> Column:
    """Text in which nothing reads as a tag."""
    return F.regexp_replace(text, P.TAG_START, r"$1$1\\<")


def escape_tags_outside_links(markdown: Column) -> Column:
    """The same, but for link targets and addresses in angle brackets: the parts between them are escaped."""
    between = F.transform(F.split(markdown, P.LINK_SYNTAX), escape_tags)
    kept = F.concat(F.regexp_extract_all(markdown, F.lit(f"({P.LINK_SYNTAX})"), F.lit(1)), F.array(F.lit("")))
    return F.when(F.contains(markdown, F.lit("<")), F.array_join(F.zip_with(between, kept, lambda a, b: F.concat(a, b)), "")).otherwise(markdown)


def table_cell(text: Column) -> Column:
    """Text whose pipes don't end a cell."""
    return F.regexp_replace(text, P.PIPE, r"$1$1\\|")


def encode_controls(url: Column) -> Column:
    """Control characters as percent-encoded UTF-8."""
    coded = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"^[\x00-\x1F\x7F-\x9F]$"), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c))
    return F.when(url.rlike(r"[\x00-\x1F\x7F-\x9F]"), F.array_join(coded, "")).otherwise(url)


def is_part_of_address(label: Column, url: Column) -> Column:
    """Whether a label is a piece of the address, as of one printed over two lines."""
    own = F.regexp_replace(label, P.ADDRESS_END, "")
    return (own != "") & ~F.contains(own, F.lit(" ")) & ((own.rlike(P.ADDRESS_LIKE) & F.contains(url, own)) | (F.contains(own, F.lit(".")) & F.endswith(url, own)))


def strip(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.btrim(text, F.lit(P.BLANKS))


def autolink(label: Column, otherwise: Column) -> Column:
    """<label>, where that is an address that an autolink can hold."""
    fits = ~label.rlike(P.NOT_IN_AUTOLINK) & (label.rlike("^" + P.SAFE_URL) | label.rlike(f"^{P.EMAIL}$"))
    return F.when(fits, F.concat(F.lit("<"), label, F.lit(">"))).otherwise(otherwise)


def link(text: Column, url: Column, whole: bool = False) -> Column:
    """A Markdown link, an autolink, or the text alone where a link would add nothing or be unsafe."""
    label, target = strip(text), F.regexp_replace(strip(url), r"(?:\s|%20)+\z", "")
    before, after = F.regexp_extract(text, rf"\A({_STRIP}*)", 1), F.regexp_extract(text, rf"({_STRIP}*)\z", 1)
    coded = encode_controls(target)
    written = F.when(coded.rlike(r"[\s()<>]"), F.concat(F.lit("<"), F.replace(F.replace(coded, F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E")), F.lit(">"))).otherwise(coded)
    shown = F.regexp_replace(F.regexp_replace(label, r"[\r\n]+", " "), r"([\[\]])", r"\\$1")
    plain = ~target.rlike("^" + P.SAFE_URL) | (F.lit(False) if whole else is_part_of_address(label, target))
    return (
        F.when(url.isNull() | (label == ""), text)
        .when((label == target) | (F.lower(F.concat(F.lit("mailto:"), label)) == F.lower(target)), F.concat(before, autolink(label, label), after))
        .when(plain, text)
        .otherwise(F.concat(before, F.lit("["), shown, F.lit("]("), written, F.lit(")"), after))
    )


def normalize(text: Column) -> Column:
    """One kind of line end, no blanks at line ends, at most one blank line, one line end at the end."""
    own = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    own = F.regexp_replace(own, _WS + r"+(\n|\z)", "$1")
    own = F.btrim(F.when(F.contains(own, F.lit("\n\n\n")), F.regexp_replace(own, r"\n{3,}", "\n\n")).otherwise(own), F.lit("\n"))
    return F.when(own == "", own).otherwise(F.concat(own, F.lit("\n")))


def clean(value: Column) -> Column:
    """A metadata value: blanks as one space, none at the ends, null when empty."""
    return F.nullif(strip(F.regexp_replace(value, r"\s+", " ")), F.lit(""))


def render_txt(text: Column) -> Column:
    """Plain text as Markdown: every line's tags and block syntax escaped."""
    lines = F.split(text, r"\r\n|\r|\n")
    return normalize(F.array_join(F.transform(lines, lambda x: escape(escape_tags(x))), "\n"))


def cell_text(value: Column) -> Column:
    """A table cell: line breaks as spaces, pipes and tags escaped."""
    return escape_tags(table_cell(strip(F.regexp_replace(value, r"\s*[\r\n]+\s*", " "))))


def render_table(rows: Column) -> Column:
    """A Markdown table of an array of rows (arrays of finished cells): the first row is the header, padded to
    the widest row; later rows are as long as they are. No rows: an empty string."""
    width = F.array_max(F.transform(rows, F.size))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |\n"))
    head = F.concat(rows[0], F.array_repeat(F.lit(""), (width - F.size(rows[0])).cast("int")))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when(F.size(rows) == 0, F.lit("")).otherwise(F.concat(line(head), line(F.array_repeat(F.lit("---"), width)), F.array_join(body, "")))
