"""Workbooks: the shown text of the cells of visible sheets."""

from __future__ import annotations

import datetime
import math
import operator
import re
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from fractions import Fraction
from typing import NamedTuple

from docmd.sources.opc import REL, Package, Unreadable

M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
MAX_SPARSE, SPARSE_TIMES = 1_000_000, 10
#: The first serial number after 9999-12-31, and how much earlier it is in the calendar from 1904.
MAX_SERIAL, LATER = 2_958_466, 1462
#: The built-in number formats.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM",
    19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0;(#,##0)", 38: "#,##0;(#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;(#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "0.0E+0", 49: "@",
}
_DATE_TOKEN = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]|AM/PM|A/P|yyyy|yy|mmmmm|mmmm|mmm|mm|m|dddd|ddd|dd|d|hh|h|ss|s|\.0+|.', re.I | re.S)


class TooSparse(Exception):
    """A sheet whose table would be nearly all empty cells."""


def general(v: float) -> str:
    """A number without a format."""
    if not math.isfinite(v):
        return str(v)
    if v == int(v) and abs(v) < 1e15:
        return str(int(v))
    if abs(v) >= 1e11 or abs(v) < 1e-9:
        mantissa, _, power = f"{v:.5E}".partition("E")
        return f"{mantissa.rstrip('0').rstrip('.')}E{power[0]}{power[1:].zfill(2)}"
    return f"{v:.10f}".rstrip("0").rstrip(".")


def is_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|_.|\*.', "", code, flags=re.I)
    return bool(re.search(r"[ymdhs]", bare, re.I)) and not re.search(r"general", bare, re.I)


def date_text(v: float, code: str, from_1904: bool) -> str:
    """A serial number as the date or time that the format shows; one beyond the year 9999 as a number."""
    if not v < MAX_SERIAL - LATER * from_1904 - 1e-4:
        return general(v)
    days = int(v)
    start = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 31) if days < 60 else datetime.datetime(1899, 12, 30)
    t = start + datetime.timedelta(days=days, milliseconds=round((v - days) * 86_400_000))
    if "." not in code:
        t = (t + datetime.timedelta(milliseconds=500)).replace(microsecond=0)
    tokens = [m[0] for m in _DATE_TOKEN.finditer(code.split(";")[0])]
    noon = any(x.upper() in ("AM/PM", "A/P") for x in tokens)
    hour = (t.hour % 12 or 12) if noon else t.hour
    out = []
    for k, x in enumerate(tokens):
        low = x.lower()
        if low in ("m", "mm"):
            before = next((y.lower() for y in reversed(tokens[:k]) if re.match(r"[ymdhs\[]", y, re.I)), "")
            after = next((y.lower() for y in tokens[k + 1 :] if re.match(r"[ymdhs]", y, re.I)), "")
            value = t.minute if before[:1] in ("h", "[") or after[:1] == "s" else t.month
            out.append(f"{value:0{len(low)}d}")
            continue
        total = int((v * 86_400) + 0.5)
        out.append(
            {
                "yyyy": f"{t.year:04d}", "yy": f"{t.year % 100:02d}", "mmm": t.strftime("%b"), "mmmm": t.strftime("%B"), "mmmmm": t.strftime("%B")[0], "d": str(t.day), "dd": f"{t.day:02d}",
                "ddd": t.strftime("%a"), "dddd": t.strftime("%A"), "h": str(hour), "hh": f"{hour:02d}", "s": str(t.second), "ss": f"{t.second:02d}", "am/pm": "AM" if t.hour < 12 else "PM",
                "a/p": "A" if t.hour < 12 else "P", "[h]": str(total // 3600), "[hh]": f"{total // 3600:02d}", "[mm]": str(total // 60), "[ss]": str(total),
            }.get(low, x[1:-1] if x[0] == '"' else x[1:] if x[0] == "\\" else f"{t.microsecond / 1e6:.{len(x) - 1}f}"[1:] if x[0] == "." and len(x) > 1 else "" if x[0] == "[" else x)
        )
    return "".join(out)


_CODE = re.compile(r'"([^"]*)"|\\(.)|_.|\*.|(\[[^\]]*\])|(General)|(;)|(E[+-]0+)|(/ ?[0-9]+|[0#?.,/%]|.)', re.I | re.S)
_CONDITION = re.compile(r"\[\s*(<=|>=|<>|<|>|=)\s*(-?[0-9.]+)\s*\]")
_TESTS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "=": operator.eq, "<>": operator.ne}


class Section(NamedTuple):
    """A part of a number format: its condition, and its tokens. A token is what it means - text, general, power, place - and
    its characters."""

    condition: tuple[str, float] | None
    tokens: list[tuple[str, str]]

    def holds(self, v: float) -> bool:
        return self.condition is None or _TESTS[self.condition[0]](v, self.condition[1])


def sections(code: str) -> list[Section]:
    """The sections of a number format."""
    out = [Section(None, [])]
    for m in _CODE.finditer(code):
        quoted, escaped, bracket, general_, end, power, other = m.groups()
        if end:
            out.append(Section(None, []))
        elif bracket:
            if c := _CONDITION.fullmatch(bracket):
                out[-1] = out[-1]._replace(condition=(c[1], float(c[2])))
            elif money := re.match(r"\[\$([^\]-]+)", bracket):
                out[-1].tokens.append(("text", money[1]))
        elif quoted is not None or escaped is not None:
            out[-1].tokens.append(("text", quoted if quoted is not None else escaped))
        elif general_:
            out[-1].tokens.append(("general", general_))
        elif power:
            out[-1].tokens.append(("power", power))
        elif other:
            out[-1].tokens.append(("place" if other[0] in "0#?.,/" else "text", other))
    return out


def _section(parts: list[Section], v: float) -> tuple[Section, bool]:
    """The section that shows a number, and whether it shows a minus sign itself."""
    if any(p.condition for p in parts):
        own = next((p for p in parts if p.holds(v)), parts[-1])
        return own, v < 0
    if v < 0 and len(parts) > 1:
        return parts[1], False
    # a zero below zero keeps its sign, as a number that rounds to zero does
    return parts[2] if v == 0 and len(parts) > 2 else parts[0], v < 0 or (len(parts) == 1 and math.copysign(1, v) < 0)


def _fraction(value: Decimal, shape: str) -> str:
    """A number in the shape of a fraction, such as `# ?/?`: a whole part where there is one, and the nearest fraction."""
    above, _, below = shape.partition("/")
    whole = len(above.split()) > 1
    below = below.strip()
    exact = Fraction(value)
    count = int(exact) if whole else 0
    rest = exact - count
    if below[:1] in "123456789":
        over = int(below)
        up = int(rest * over + Fraction(1, 2))
    else:
        near = rest.limit_denominator(10 ** len(below) - 1)
        up, over = near.numerator, near.denominator
    if whole and up == over:
        count, up = count + 1, 0
    shown = f"{up}/{over}" if up or not whole else ""
    return " ".join(x for x in (str(count) if count or (whole and not up) else "", shown) if x)


def number_text(v: float, code: str) -> str:
    """A number as the format shows it: by the section whose condition holds, or that of its sign."""
    if not math.isfinite(v) or code.lower() in ("general", "@", ""):
        return general(v)
    section, negative = _section(sections(code), v)
    tokens, sign = section.tokens, "-" if negative else ""
    places = [k for k, (kind, x) in enumerate(tokens) if kind == "place" and x[0] in "0#?"]
    if not places:
        shown = "".join(general(abs(v)) if kind == "general" else x for kind, x in tokens if kind != "place")
        return (sign if any(kind == "general" for kind, _ in tokens) or len(sections(code)) == 1 else "") + shown
    # a dot before the first digit and all places after it belong to the number; text among them stays behind it
    first, last = places[0], places[-1]
    while first and tokens[first - 1] == ("place", "."):
        first -= 1
    while last + 1 < len(tokens) and (tokens[last + 1][0] in ("place", "power")):
        last += 1
    own = tokens[first : last + 1]
    shape = "".join(x for kind, x in own if kind != "text" or x == " ")
    inside = "".join(x for kind, x in own if kind == "text" and x != " ")
    try:
        value = Decimal(repr(abs(v))) * 100 ** sum(x == "%" for kind, x in tokens if kind == "text")
    except InvalidOperation:
        return general(v)
    if "/" in shape:
        text = _fraction(value, shape)
    elif power := next((x for kind, x in own if kind == "power"), ""):
        figures = len(shape.partition("E")[0].partition("e")[0].partition(".")[2])
        mantissa, _, exponent = f"{value:.{figures}E}".partition("E")
        text = f"{mantissa}E{exponent[0] if exponent[0] == '-' or '+' in power else ''}{exponent.lstrip('+-').zfill(len(power) - 2)}"
    elif inside and not {".", ","} & set(shape):
        # text between digits, as in 000-0000: these are dealt out from the right
        digits, text, inside = f"{value:.0f}".zfill(shape.count("0")), "", ""
        for kind, x in reversed(own):
            text, digits = (x + text, digits) if kind == "text" else (digits[-1:] + text, digits[:-1])
        text = digits + text
    else:
        text = _decimal(value, shape.replace(" ", ""))
    before, after = ("".join(x for kind, x in part if kind == "text") for part in (tokens[:first], tokens[last + 1 :]))
    return sign + before + text + inside + after


def _decimal(value: Decimal, shape: str) -> str:
    """A number in the shape of digits: each comma after the last digit divides by a thousand, one between digits groups."""
    whole, _, fraction = shape.partition(".")
    scale = len(whole) - len(whole.rstrip(",")) + fraction.count(",")
    whole, fraction = whole.rstrip(","), fraction.replace(",", "")
    value = (value / 1000**scale).quantize(Decimal(1).scaleb(-len(fraction)), ROUND_HALF_UP)
    digits, _, after = f"{value:f}".partition(".")
    digits = digits.lstrip("0").zfill(whole.replace(",", "").count("0"))
    if "," in whole:
        digits = f"{int(digits or 0):,}" if digits else digits
    while after and fraction[len(after) - 1] == "#" and after[-1] == "0":
        after = after[:-1]
    return digits + ("." + after if after or (fraction == "" and "." in shape) else "")


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _text(e) -> str:
    """The runs of a string item, without phonetic hints."""
    return "".join(t.text or "" for child in e for t in ([child] if child.tag == M + "t" else child.findall(M + "t") if child.tag == M + "r" else []))


def read(data: bytes) -> tuple[list[tuple[str, list[list[tuple[int, str]]]]], dict[str, str | None]]:
    """(name, rows of (column, text)) of every visible sheet with text, and the core properties."""
    package = Package(data, "XLSX")
    main = package.main("xl/workbook.xml")
    book, relations = package.xml(main), package.relations(main)
    if book is None:
        raise Unreadable("Cannot read the XLSX file")
    part = lambda kind: next((package.xml(t) for k, t, _ in relations.values() if k == kind), None)
    shared_part, styles = part("sharedStrings"), part("styles")
    shared = [_text(e) for e in shared_part] if shared_part is not None else []
    formats, codes = [], dict(BUILT_IN)
    if styles is not None:
        codes |= {int(e.get("numFmtId", 0)): e.get("formatCode", "General") for e in styles.iter(M + "numFmt")}
        own = styles.find(M + "cellXfs")
        formats = [codes.get(int(e.get("numFmtId", 0)), "General") for e in (own if own is not None else ())]
    properties = book.find(M + "workbookPr")
    from_1904 = properties is not None and properties.get("date1904") in ("1", "true")
    sheets = []
    for sheet in book.iter(M + "sheet"):
        kind, target, _ = relations.get(sheet.get(REL + "id", ""), ("", "", False))
        root = package.xml(target) if kind == "worksheet" and sheet.get("state", "visible") == "visible" else None
        rows = []
        for row in root.iter(M + "row") if root is not None else ():
            cells, at = [], -1
            for c in row.findall(M + "c"):
                at = _column(c.get("r")) if c.get("r") else at + 1
                if text := _cell(c, shared, formats, from_1904):
                    cells.append((at, text))
            if cells:
                rows.append(cells)
        columns = {k for r in rows for k, _ in r}
        count = sum(map(len, rows))
        if len(rows) * len(columns) > MAX_SPARSE and len(rows) * len(columns) > SPARSE_TIMES * count:
            raise TooSparse(f"The sheet {sheet.get('name')} has {len(rows)} rows and {len(columns)} columns, nearly all of them empty")
        if rows:
            sheets.append((sheet.get("name", ""), rows))
    return sheets, package.properties()


def _cell(c, shared: list[str], formats: list[str], from_1904: bool) -> str:
    kind, v = c.get("t", "n"), c.find(M + "v")
    value = v.text if v is not None and v.text is not None else ""
    if kind == "s":
        return shared[int(value)] if value.strip().isdigit() and int(value) < len(shared) else ""
    if kind == "inlineStr":
        inner = c.find(M + "is")
        return _text(inner) if inner is not None else ""
    if kind == "b":
        return {"1": "TRUE", "0": "FALSE"}.get(value.strip(), "")
    if kind != "n" or not value:
        return value
    try:
        number = float(value)
    except ValueError:
        return value
    style = int(c.get("s", 0))
    code = formats[style] if style < len(formats) else "General"
    return date_text(number, code, from_1904) if is_date(code) and number >= 0 else number_text(number, code)
