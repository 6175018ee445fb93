"""CSV and TSV text as records, by the rules of the format's common writers."""

from __future__ import annotations

import re

SEPARATORS = ",;\t"


def separator(text: str) -> str:
    """The separator that is most frequent outside quotes in the first record; the earlier of equal ones; a comma without any."""
    inside = False
    counts = dict.fromkeys(SEPARATORS, 0)
    for m in re.finditer(r'["\r\n,;\t]', text):
        c = m[0]
        if c == '"':
            inside = not inside
        elif not inside:
            if c in "\r\n":
                if any(counts.values()) or text[: m.start()].strip("\r\n"):
                    break
            else:
                counts[c] += 1
    return max(SEPARATORS, key=lambda c: counts[c])


def records(text: str, sep: str) -> list[list[str]]:
    """The records: blank lines are none; a quoted field may hold separators, line ends and doubled quotes.

    A quote opens a field only where the field is blank so far (blanks before it go); text after the closing
    quote is added; other quotes are text; an unclosed quote takes the rest.
    """
    own = re.escape(sep)
    opening = re.compile(rf'[^\S\r\n{own}]*"')
    inside = re.compile(r'[^"]*(?:""[^"]*)*')
    plain = re.compile(rf"[^{own}\r\n]*")
    out: list[list[str]] = []
    row: list[str] = []
    at, n = 0, len(text)
    while at < n:
        if m := opening.match(text, at):
            body = inside.match(text, m.end())
            rest = plain.match(text, min(body.end() + 1, n))
            row.append(body[0].replace('""', '"') + rest[0])
        else:
            rest = plain.match(text, at)
            if not row and not rest[0] and rest.end() < n and text[rest.end()] in "\r\n":
                at = rest.end() + (2 if text.startswith("\r\n", rest.end()) else 1)
                continue
            row.append(rest[0])
        at = rest.end()
        if at < n and text[at] == sep:
            at += 1
            if at == n or text[at] in "\r\n":
                row.append("")
            else:
                continue
        out.append(row)
        row = []
        at += 2 if text.startswith("\r\n", at) else 1
    if row:
        out.append(row)
    return out


def parse(text: str, tabs: bool = False) -> list[list[str]]:
    return records(text, "\t" if tabs else separator(text))
