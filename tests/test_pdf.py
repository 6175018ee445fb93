"""Tagged and ruled tables, tagged headings, figures, clips, raised digits and powers of PDF pages."""

import hashlib
import re

import numpy as np
import pytest

from docmd.operators.boxes import cluster_groups
from docmd.sources import pdfblocks, pdfcrypt, pdftext
from tests.test_convert import convert, pdf, shown

BODY = "This is the body of the document with enough words in it"


def content(mark: int, x: float, y: float, text: str, size: int = 10) -> bytes:
    return b"/P << /MCID %d >> BDC " % mark + shown((x, y, text, size, "F1")) + b" EMC "


def tagged(page: bytes, tree: str) -> bytes:
    """A one-page file (page object 10) with elements below the root of its structure tree."""
    return pdf([page], extra=f"/StructTreeRoot << /Type /StructTreeRoot /RoleMap << /Cell /TD >> /K [{tree}] >>")


def element(kind: str, *kids: str, page: str = "") -> str:
    return f"<< /S /{kind} {page} /K [{' '.join(kids)}] >>"


def read(data: bytes):
    lines, _, tables = pdftext.read(data)
    return [x["text"] for x in lines], tables


PAGE = "/Pg 10 0 R"


def test_tagged_table_and_heading(spark):
    page = content(0, 72, 720, "Prices") + shown((72, 700, BODY, 10, "F1")) + b"".join(content(1 + k, 72 + 100 * (k % 2), 680 - 20 * (k // 2), t) for k, t in enumerate(("Loaf", "Price", "rye", "4 | 5", "oat", "6")))
    page += shown((72, 600, BODY + " again.", 10, "F1"))
    rows = [element("TR", *(element(kind, str(k)) for k in ks)) for kind, ks in (("TH", (1, 2)), ("Cell", (3, 4)), ("TD", (5, 6)))]
    data = tagged(page, element("H2", "0", page=PAGE) + element("Table", element("THead", rows[0]), *rows[1:], page=PAGE))
    lines, tables = read(data)
    assert lines == ["Prices", BODY, "", BODY + " again."]
    assert tables == [{"table_id": 0, "rows": [["Loaf", "Price"], ["rye", "4 | 5"], ["oat", "6"]], "blank": False}]
    shown_ = f"# Prices\n\n{BODY}\n\n| Loaf | Price |\n| --- | --- |\n| rye | 4 \\| 5 |\n| oat | 6 |\n\n{BODY} again.\n"
    assert [r.markdown for r in convert(spark, [("a.pdf", data, None), ("b.pdf", data, None)])] == [shown_, shown_]


def test_tagged_tables_that_are_special(spark):
    page = b"".join(content(k, 72 + 100 * (k % 2), 700 - 20 * (k // 2), t) for k, t in enumerate(("Flour", "rye", "", "", "Hours", "2")))
    rows = [element("TR", element("TH", str(2 * k)), element("TD", str(2 * k + 1))) for k in range(3)]
    data = tagged(page, element("Table", *rows, page=PAGE))
    assert read(data)[1] == [{"table_id": 0, "rows": [["Flour", "rye"], ["", ""], ["Hours", "2"]], "blank": True}]
    assert convert(spark, [("a.pdf", data, None)])[0].markdown == "|  |  |\n| --- | --- |\n| Flour | rye |\n| Hours | 2 |\n"
    # one row, or one column, is layout; a tree that loops ends
    assert read(tagged(page, element("Table", rows[0], page=PAGE)))[1] == []
    assert read(tagged(page, element("Table", *(element("TR", element("TD", str(k))) for k in range(3)), page=PAGE)))[1] == []
    loop = pdf([page], extra="/StructTreeRoot << /K 50 0 R >>").replace(b"trailer", b"50 0 obj\n<< /S /Div /K [50 0 R 50 0 R] >>\nendobj\ntrailer")
    assert read(loop)[1] == []


def rules(xs, ys) -> bytes:
    return b"".join(b"%g %g m %g %g l S " % (xs[0], y, xs[-1], y) for y in ys) + b"".join(b"%g %g m %g %g l S " % (x, ys[0], x, ys[-1]) for x in xs)


CELLS = [(80, 690, "Loaf"), (180, 690, "Price"), (80, 670, "rye"), (180, 670, "4"), (80, 650, "oat"), (180, 650, "6")]


def test_ruled_table(spark):
    texts = shown(*((x, y, t, 10, "F1") for x, y, t in CELLS), (72, 630, "Table 1: Prices of bread.", 10, "F1"), (72, 590, BODY, 10, "F1"))
    data = pdf([rules((70, 170, 270), (705, 685, 645)) + texts])
    lines, tables = read(data)
    assert lines == ["", "Table 1: Prices of bread.", BODY]
    assert tables == [{"table_id": 0, "rows": [["Loaf", "Price"], ["rye", "4"], ["oat", "6"]], "blank": False}]
    assert convert(spark, [("a.pdf", data, None)])[0].markdown == f"| Loaf | Price |\n| --- | --- |\n| rye | 4 |\n| oat | 6 |\n\nTable 1: Prices of bread.\n\n{BODY}\n"
    # without a caption, without a vertical rule, or with text across its edge it stays text
    assert read(pdf([rules((70, 170, 270), (705, 685, 645)) + shown(*((x, y, t, 10, "F1") for x, y, t in CELLS))]))[1] == []
    assert read(pdf([b"".join(b"70 %d m 270 %d l S " % (y, y) for y in (705, 685, 645)) + texts]))[1] == []
    wide = shown((72, 630, "Table 1: Prices of bread.", 10, "F1"), (240, 670, "sold only here", 10, "F1"))
    assert read(pdf([rules((70, 170, 270), (705, 685, 645)) + wide]))[1] == []


def test_ruled_table_with_merged_cells_and_joined_lines():
    texts = shown((80, 690, "Bread", 10, "F1"), (180, 690, "of rye", 10, "F1"), (80, 670, "long", 10, "F1"), (180, 670, "first", 10, "F1"), (180, 658, "second", 10, "F1"), (72, 630, "Table 2. Bread", 10, "F1"))
    across = b"".join(b"70 %d m 270 %d l S " % (y, y) for y in (705, 685, 645))
    page = across + b"70 645 m 70 705 l S 270 645 m 270 705 l S 170 645 m 170 685 l S " + texts
    assert read(pdf([page]))[1][0]["rows"] == [["Bread of rye", ""], ["long", "first second"]]


def test_figures():
    caption = shown((72, 500, "Figure 1: How bread rises over time in a warm oven.", 10, "F1"), (72, 460, BODY, 10, "F1"))
    labels = shown((100, 600, "20 C", 8, "F1"), (80, 530, "minutes", 8, "F1"), (400, 600, "far label", 8, "F1"), (90, 560, "The crust is dark when the oven was hot for long", 8, "F1"))
    drawing = b"90 520 200 150 re f "
    assert read(pdf([drawing + labels + caption]))[0] == ["far label", "The crust is dark when the oven was hot for long", "Figure 1: How bread rises over time in a warm oven.", BODY]
    # no caption, and a drawing in the next column
    assert "20 C" in read(pdf([drawing + labels]))[0] and "20 C" in read(pdf([b"400 520 100 100 re f " + labels + caption]))[0]


def test_clips():
    cut = b"q 72 690 60 30 re W n " + shown((72, 700, "in", 10, "F1"), (300, 700, "out", 10, "F1")) + b" Q " + shown((300, 650, "after", 10, "F1"), (900, 600, "beyond", 10, "F1"))
    assert read(pdf([cut]))[0] == ["in", "after"]


@pytest.mark.parametrize(("glyphs", "text"), [
    (((72, 700, "bread", 10), (97, 704, "12", 7), (104.5, 700, ", where", 10)), "bread¹², where"), (((72, 704, "3", 7), (75.6, 700, "Rye", 10)), "³Rye"),
    (((72, 700, "bread", 10), (97, 700, "12", 7)), "bread12"), (((72, 700, "bread", 10), (97, 704, "1234", 7)), "bread1234"),
    (((72, 700, "3.5\327", 10), (92, 700, "10", 10), (102, 704, "18", 7)), "3.5×10¹⁸"), (((72, 700, "3.5\327", 10), (94, 700, "10", 10), (104, 704, "18", 7)), "3.5×10¹⁸"),
    (((72, 700, "see", 10), (92, 700, "10", 10), (102, 704, "18", 7)), "see 1018"),
])
def test_raised_digits(glyphs, text):
    assert read(pdf([shown(*((x, y, t.replace("\327", "\\327"), size, "F1") for x, y, t, size in glyphs))]))[0] in ([text], [text.replace("×10", "× 10")])


def test_spaces_over_letters_and_stamps():
    over = shown((72, 700, "http", 10, "F1"), (92, 700, "s", 10, "F1"), (92, 700, " ", 10, "F1"), (97, 700, "rest", 10, "F1"))
    assert read(pdf([over]))[0] == ["httpsrest"]
    stamp = b"BT /F1 20 Tf 0 1 -1 0 30 200 Tm (arXiv:2001.00001v1 ) Tj ([cs.CL] ) Tj (1 Jan 2020) Tj ET "
    assert read(pdf([stamp]))[0] == ["arXiv:2001.00001v1 [cs.CL] 1 Jan 2020"]


def test_clusters_of_many_boxes():
    assert set(cluster_groups(np.tile([0.0, 0.0, 10.0, 10.0], (5000, 1)))) == {0} and cluster_groups(np.zeros((0, 4))).size == 0
    apart = np.array([[20.0 * k, 0.0, 20.0 * k + 10, 10.0] for k in range(50)])
    assert list(cluster_groups(apart)) == list(range(50))
    # a box between the extents of two clusters joins them, though it is near to no box of one
    assert len(set(cluster_groups(np.array([[0.0, 0, 1, 100], [0, 0, 100, 1], [60, 60, 61, 61]])))) == 1
    assert pdfblocks.without_figures([], {}) == [] and pdfblocks.with_ruled_tables([], {}, 0) == ([], [])


def test_ciphers():
    key, text = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert pdfcrypt.encrypt_chain(key, bytes(16), text).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert pdfcrypt.encrypt_chain(bytes(range(32)), bytes(16), text).hex() == "8ea2b7ca516745bfeafc49904b496089"
    for k in (key, bytes(range(32))):
        assert pdfcrypt.decrypt_chain(k, key, pdfcrypt.encrypt_chain(k, key, text * 3)) == text * 3
    assert pdfcrypt.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3" and pdfcrypt.decrypt_chain(key, key, b"short") == b""


def locked(kind: str, opens: bool = True) -> bytes:
    """The page in an encrypted file; the user's password is empty where it opens."""
    data = pdf([shown((72, 700, "rye bread", 10, "F1"))], info="<< /Title <41> >>")
    ident, owner, user = b"0123456789abcdef", b"o" * 32, b""
    filters = lambda m: f"/CF << /StdCF << /CFM /{m} >> >> /StmF /StdCF /StrF /StdCF"
    if kind == "AESV3":
        key, salts = bytes(range(32)), b"validati" + b"keysalts"
        user = pdfcrypt._hash(salts[:8], 6) + salts
        head = f"/V 5 /R 6 {filters(kind)} /UE <{pdfcrypt.encrypt_chain(pdfcrypt._hash(salts[8:], 6), bytes(16), key).hex()}>"
        owner = b"o" * 48
    else:
        key = hashlib.md5(pdfcrypt.PADDING + owner + (-4 & 0xFFFFFFFF).to_bytes(4, "little") + ident).digest()
        for _ in range(50):
            key = hashlib.md5(key).digest()
        user = hashlib.md5(pdfcrypt.PADDING + ident).digest()
        for k in range(20):
            user = pdfcrypt.rc4(bytes(b ^ k for b in key), user)
        user += bytes(16)
        head = "/V 2 /R 3 /Length 128" if kind == "V2" else f"/V 4 /R 4 /Length 128 {filters(kind)}"

    def hidden(plain: bytes, number: int) -> bytes:
        own = key if kind == "AESV3" else hashlib.md5(key + number.to_bytes(3, "little") + bytes(2) + (b"sAlT" if kind == "AESV2" else b"")).digest()
        pad = 16 - len(plain) % 16
        return pdfcrypt.rc4(own, plain) if kind == "V2" else b"i" * 16 + pdfcrypt.encrypt_chain(own, b"i" * 16, plain + bytes([pad]) * pad)

    body = re.search(rb"11 0 obj.*?stream\n(.*?)\nendstream", data, re.S)[1]
    data = data.replace(body, hidden(body, 11)).replace(b"<41>", b"<" + hidden(b"Rye", 5).hex().encode() + b">")
    data = re.sub(rb"/Length \d+ ", b"", data, count=1)
    user = user if opens else b"x" * len(user)
    return data.replace(b"/Info 5 0 R", f"/Info 5 0 R /ID [<{ident.hex()}> <00>] /Encrypt << /Filter /Standard {head} /P -4 /O <{owner.hex()}> /U <{user.hex()}> >>".encode())


@pytest.mark.parametrize("kind", ["V2", "AESV2", "AESV3"])
def test_encrypted_without_a_password(kind):
    lines, own, _ = pdftext.read(locked(kind))
    assert [x["text"] for x in lines] == ["rye bread"] and own["title"] == "Rye"
    with pytest.raises(pdftext.Unreadable, match="encrypted"):
        pdftext.read(locked(kind, opens=False))


def test_gaps_and_sizes():
    # a gap and the blanks at both its sides are one blank; blanks without a gap stay
    page = shown((72, 700, "rye ", 10, "F1"), (110, 700, "  oat", 10, "F1"), (72, 680, "a  b", 10, "F1"))
    assert read(pdf([page]))[0] == ["rye oat", "a  b"]
    lines, _, _ = pdftext.read(pdf([b"BT /F1 9.96 Tf 72 700 Td (rye) Tj ET BT /F1 11.5 Tf 72 600 Td (oat) Tj ET BT /F1 0.4 Tf 72 500 Td (dot) Tj ET"]))
    assert [x["font_size"] for x in lines] == [9.0, 11.0, 0.4]


def linked(page: bytes, *boxes: tuple[float, float]) -> list[str]:
    """The texts of a page with links to https://oven.test/ over (left, right) of its line at 700."""
    notes = " ".join(f"<< /Subtype /Link /Rect [{a} 690 {b} 715] /A << /S /URI /URI (https://oven.test/) >> >>" for a, b in boxes)
    data = pdf([page], packed=False)
    return read(data.replace(b"/Type /Page ", b"/Type /Page /Annots [" + notes.encode() + b"] "))[0]


def test_links_end_at_words():
    page = shown((72, 700, "see rye, and oat", 10, "F1"))
    assert linked(page, (90, 107)) == ["see [rye](https://oven.test/), and oat"]
    assert linked(page, (90, 101)) == ["see [rye](https://oven.test/), and oat"] and linked(page, (97, 107)) == ["see rye, and oat"]
    assert linked(shown((72, 700, "at <https://oven.test/>.", 10, "F1")), (91, 182)) == ["at <https://oven.test/>."]
