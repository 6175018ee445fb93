"""The text functions: expected values, and column expressions against their Python twins."""

import random

import pytest
from pyspark.sql import functions as F

from docmd.functions import markdown as M
from docmd.functions import text as T

ESCAPE = {
    "-": "\\-", "-----": "\\-----", "-  -": "\\-  -", "*": "\\*", "* *": "* *", "****": "\\****", "_": "_", "____": "\\____", "= =": "\\= =", "=": "\\=", "> 3 g": "\\> 3 g", "## 3": "\\## 3", "``` x": "\\``` x",
    "~~~": "\\~~~", "- rye": "- rye", "* rye": "* rye", "7. rye": "7. rye", "-- rye --": "-- rye --", "rye *dark* > oat": "rye *dark* > oat", "E# minor": "E# minor", "\t> x": "\t\\> x", "   #": "   \\#",
}
TAGS = {"</i>": "\\</i>", "\\\\<i>": "\\\\\\\\\\<i>", "a<b c < d <!x <?y <9": "a\\<b c < d \\<!x \\<?y <9"}
OUTSIDE = {
    "Bag<Rye> <https://mill.test/rye> <baker@mill.test>": "Bag\\<Rye> <https://mill.test/rye> <baker@mill.test>", "[a](<i>b</i>)": "[a](\\<i>b\\</i>)", "<https://mill.test a=b>": "\\<https://mill.test a=b>",
}
CELLS = {"rye|oat": "rye\\|oat", "\\|": "\\\\\\|", "D:\\rye": "D:\\rye", "||": "\\|\\|"}
NORMAL = {
    "rye\r\n\r\noat": "rye\n\noat\n", "rye\roat": "rye\noat\n", "rye\t \noat ": "rye\noat\n", "rye\n \n\t\n\noat": "rye\n\noat\n", "\n \n  rye": "  rye\n", " \r\n ": "", "\n\n": "", "x": "x\n", "x\r": "x\n", "x\n\r\n\r": "x\n",
    "x\r\r\ny": "x\n\ny\n", "x\n\r\ry": "x\n\ny\n",
}
LINKS = [
    ("  dark rye ", "https://mill.test/r", "  [dark rye](https://mill.test/r) "), ("rye [2]", "https://mill.test/r_(2)", "[rye \\[2\\]](<https://mill.test/r_(2)>)"), ("\t", "https://mill.test/", "\t"), ("rye", "vbscript:x", "rye"),
    ("rye", "ftp://mill.test/", "rye"), ("rye", None, "rye"), ("https://mill.test/r", "https://mill.test/r", "<https://mill.test/r>"), (" https://mill.test/r", "https://mill.test/r", " <https://mill.test/r>"),
    ("baker@mill.test", "mailto:baker@mill.test", "<baker@mill.test>"), ("mailto:baker@mill.test", "mailto:baker@mill.test", "<mailto:baker@mill.test>"), ("https://mill.test/r<s", "https://mill.test/r<s", "https://mill.test/r<s"),
    ("baker at@mill", "mailto:baker at@mill", "baker at@mill"), ("mill.test/rye", "https://mill.test/rye", "mill.test/rye"), ("rye", "https://mill.test/a\n## b", "[rye](<https://mill.test/a%0A## b>)"),
    ("dark\nrye", "https://mill.test/", "[dark rye](https://mill.test/)"), ("rye-7.pdf", "https://mill.test/files/rye-7.pdf", "rye-7.pdf"), ("Rye", "https://mill.test/wiki/Rye", "[Rye](https://mill.test/wiki/Rye)"),
]
FUNCTIONS = {"escape": ESCAPE, "escape_tags": TAGS, "escape_tags_outside_links": OUTSIDE, "table_cell": CELLS, "normalize": NORMAL}


@pytest.mark.parametrize("name", FUNCTIONS)
def test_python(name):
    for given, expected in FUNCTIONS[name].items():
        assert getattr(T, name)(given) == expected, given


def test_python_links():
    for label, url, expected in LINKS:
        assert T.link(label, url) == expected
    assert T.link("rye/dark.txt", "https://mill.test/rye/dark.txt", True) == "[rye/dark.txt](https://mill.test/rye/dark.txt)"


def _hostile(n: int) -> list[str]:
    r = random.Random(4)
    alphabet = list("<>|\\-=*_#`~ ab/!?.@:\t") + ["http://", "](<", ">)", "mailto:", "\u2003", "é", "[", "]", "(", ")"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("name", FUNCTIONS)
def test_columns_equal_python(spark, name):
    texts = [*FUNCTIONS[name], *_hostile(1500), None]
    if name == "normalize":
        texts = [None if t is None else t.replace("a", "\n").replace("b", "\r") for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", getattr(M, name)(F.col("t")).alias("x")).collect()
    for r in rows:
        assert r.x == (None if r.t is None else getattr(T, name)(r.t)), repr(r.t)


def test_link_columns_equal_python(spark):
    r = random.Random(5)
    pairs = [(a, b) for a, b, _ in LINKS] + [(a, r.choice(["https://x.org/", "", "mailto:"]) + r.choice(_hostile(40))) for a in _hostile(600)]
    for whole in (False, True):
        rows = spark.createDataFrame(pairs, "t string, u string").select("t", "u", M.link(F.col("t"), F.col("u"), whole).alias("x")).collect()
        for row in rows:
            assert row.x == T.link(row.t, row.u, whole), (row.t, row.u)


def test_clean(spark):
    cases = {" a \n b ": "a b", "": None, " \t": None, "x": "x"}
    for given, expected in cases.items():
        assert T.clean(given) == expected
        assert spark.range(1).select(M.clean(F.lit(given)).alias("x")).first().x == expected


def test_txt(spark):
    cases = {
        "Rye\r\noat\r\r\r\rspelt": "Rye\noat\n\nspelt\n", "> rye\n# oat\n~~~\n===\n+ spelt": "\\> rye\n\\# oat\n\\~~~\n\\===\n+ spelt\n", "Bag<Rye> </bag>\n9 <10": "Bag\\<Rye> \\</bag>\n9 <10\n",
        "rye:\n\n  500 g \n": "rye:\n\n  500 g\n", "": "", "\t\n\r": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", M.render_txt(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == cases
