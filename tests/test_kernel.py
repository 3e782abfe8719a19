"""The kernel against the format's known vectors and against itself: what the writer writes, the reader reads."""

import random
import zlib
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelake.kernel import draw, fonts, text
from pagelake.kernel.emit import Emitter, Name, Ref, Writer, name, real, record, string, syntax, text_string, xref_stream_document
from pagelake.kernel.errors import PdfError
from pagelake.kernel.flate import inflate, paeth, unpredict
from pagelake.kernel.layout import Bookmark, Bullet, Doc, Frame, Paragraph, Preformatted, Rule, Spacer, Stack, Style, StyleOp, Table, atoms, columns, covers, height, outline, pdf_date, wrap
from pagelake.kernel.lexer import line_and_column, token, tokens
from pagelake.kernel.objects import Document, Limits, Parser


def test_tokens_and_offsets():
    got = [(t.kind, t.pos, t.literal) for t in tokens(rb"<</Type/Page/N 3/F 3.14/S(a\)b)/H<4142>/A[1 0 R]>>")]
    assert [(k, p) for k, p, _ in got] == [("<<", 0), ("name", 2), ("name", 7), ("name", 12), ("integer", 15), ("name", 16), ("real", 19), ("name", 23), ("string", 25), ("name", 31), ("hexstring", 33), ("name", 39), ("[", 41), ("integer", 42), ("integer", 44), ("R", 46), ("]", 47), (">>", 48), ("EOF", 50)]
    assert got[8][2] == b"a)b" and got[10][2] == b"AB"


@pytest.mark.parametrize(
    ("raw", "value"),
    [(rb"(\n\r\t\b\f\(\)\\)", b"\n\r\t\b\f()\\"), (rb"(\101\12\0)", b"A\n\0"), (b"(a\\\nb)", b"ab"), (b"(a\\\r\nb)", b"ab"), (b"(a\r\nb)", b"a\nb"), (b"(a\rb)", b"a\nb"), (rb"(\q)", b"q"), (b"<4 16\nf>", b"\x41\x6f"), (b"<BEE>", b"\xbe\xe0"), (b"<48656C6C6F7>", b"Hellop"), (b"/Adobe#20Green", b"Adobe Green"), (b"/A#2FB", b"A/B"), (b"(a (b) c)", b"a (b) c"), (rb"(\777)", b"\xff")],
)
def test_escapes(raw, value):
    assert token(raw).literal == value


def test_odd_tokens():
    assert [t.kind for t in tokens(b". + - +5 1.2.3 ) > R /a#zz <4x> % c\n(abc")] == ["real", "illegal", "illegal", "integer", "real", "real", "illegal", "illegal", "R", "illegal", "illegal", "illegal", "EOF"]
    assert token(b"(abcdefgh)", 0, 4).kind == "illegal" and [t.pos for t in tokens(b"  12 /N\n(s)")] == [2, 5, 8, 11]
    assert line_and_column(b"ab\ncd\n\nx", 4) == (2, 2, 2) and line_and_column(b"ab\ncd\n\nx", 7) == (4, 1, 1)


def test_values():
    v = Parser(b"[1 0 R 42 (s) [7 8] <</K 1/K 2>> /N 5 7 -3 2.5 true null]").value()
    assert [x.kind for x in v.v] == ["ref", "int", "string", "array", "dict", "name", "int", "int", "int", "real", "bool", "null"]
    assert v.v[4].get(b"K").v == 1 and v.v[4].get(b"Z").kind == "null"
    for bad in (b"[1 2 3", b"<<1 2>>", b"[" * 70, b"99999999999999999999", b"[.]"):
        with pytest.raises(PdfError):
            Parser(bad).value()


_ops = st.sampled_from([("int", -7), ("real", 2.5), ("name", "A b"), ("name", ""), ("string", b"a(b"), ("hex", b"\1\2"), ("bool", True), ("null",), ("ref", 3, 0), ("word", "Tj")])


@settings(max_examples=300, deadline=None)
@given(st.lists(_ops, max_size=6))
def test_emitted_tokens_read_back(ops):
    e = Emitter()
    want = []
    for op, *args in ops:
        getattr(e, op)(*args)
        one = Emitter()
        getattr(one, op)(*args)
        want += [(t.kind, t.literal) for t in tokens(one.bytes())][:-1]
    assert [(t.kind, t.literal) for t in tokens(e.bytes())][:-1] == want


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40))
def test_strings_and_names_round_trip(raw):
    assert token(string(raw)).literal == raw
    assert token(name(raw)).literal == raw


def test_numbers_and_text():
    assert [real(x) for x in (0.5, -1.25, 72.0, 841.89, 1e-30)] == [b"0.5", b"-1.25", b"72", b"841.89", b"0"]
    assert real(3.4028234663852886e38) == b"340282346638528860000000000000000000000"
    for bad in (float("nan"), float("inf"), 1e300):
        with pytest.raises(PdfError):
            real(bad)
    assert text_string("a — b") == b"<feff00610020201400200062>" and text_string("x 😀") == b"<feff00780020d83dde00>"
    assert pdf_date(datetime(2026, 8, 16, 22, 30, tzinfo=timezone(timedelta(hours=-3)))) == "D:20260816223000-03'00'"
    assert record(15, 0) == b"0000000015 00000 n\r\n" and len(record(0, 65535, True)) == 20
    with pytest.raises(PdfError):
        record(10**10, 0)
    with pytest.raises(PdfError):
        Emitter().begin(b"[").bytes()


def test_inflate_is_strict():
    data = bytes(range(256)) * 20
    z = zlib.compress(data)
    assert inflate(z) == data == inflate(z + b"more") == inflate(z, skip_checksum=True)
    wrong = z[:-1] + bytes((z[-1] ^ 1,))
    assert inflate(wrong, skip_checksum=True) == data
    for bad in (z[:-4], z[:20], wrong, b"", b"xx" + z, z[:2]):
        with pytest.raises(PdfError):
            inflate(bad)
    with pytest.raises(PdfError):
        inflate(z[:-4], skip_checksum=True)
    with pytest.raises(PdfError):
        inflate(z, limit=100)


def _filtered(rows, kinds, step):
    out, above = b"", bytes(len(rows[0]))
    for row, f in zip(rows, kinds, strict=True):
        line = []
        for j, x in enumerate(row):
            a, b, c = row[j - step] if j >= step else 0, above[j], above[j - step] if j >= step else 0
            p = a + b - c
            near = min((a, b, c), key=lambda v: abs(p - v))
            line.append((x - (0, a, b, (a + b) // 2, near)[f]) & 255)
        out += bytes((f, *line))
        above = row
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=6, max_size=6), st.integers(0, 4)), min_size=1, max_size=6), st.sampled_from([1, 3]))
def test_predictors_round_trip(rows, colors):
    data, kinds = [r for r, _ in rows], [f for _, f in rows]
    assert unpredict(_filtered(data, kinds, colors), 6 // colors, colors) == b"".join(data)


def test_predictor_errors_and_ties():
    assert [paeth(*x) for x in ((0, 0, 0), (1, 2, 3), (5, 5, 5), (10, 0, 0), (0, 10, 0), (1, 1, 0))] == [0, 1, 5, 10, 10, 1]
    for bad in (b"\5abc", b"\0ab"):
        with pytest.raises(PdfError):
            unpredict(bad, 3)


def page(body, **extra):
    w = Writer()
    content = w.stream(body)
    font = w.object({"Type": Name("Font"), "BaseFont": Name("Helvetica"), **extra})
    w.object({"Type": Name("Page"), "Parent": Ref(4), "Contents": Ref(content), "Resources": {"Font": {"F1": Ref(font)}}}, 3)
    w.object({"Type": Name("Pages"), "Kids": [Ref(3)], "Count": 1}, 4)
    root = w.object({"Type": Name("Catalog"), "Pages": Ref(4)})
    return w.close(root), root


def test_fresh_document_and_updates():
    data, root = page(b"BT /F1 12 Tf 72 720 Td (Hello) Tj ET")
    doc = Document(data)
    assert text.page_text(doc, text.pages(doc)[0][1]) == b"Hello\n" and b"xref\n0 6\n" in data
    u = Writer(data)
    kept = [(k, u.copy(doc, v)) for k, v in doc.resolve(root).v]
    u.object({k.decode(): v for k, v in kept} | {"Marker": 42}, root)
    new = Document(u.close(root))
    assert len(new.revisions) == 2 and new.resolve(root).get(b"Marker").v == 42 and new.lookup(4) == doc.lookup(4)
    with pytest.raises(PdfError):
        u.close(root)
    with pytest.raises(PdfError):
        u.copy(doc, doc.resolve(1))
    with pytest.raises(PdfError):
        Writer().object(1, 0)
    with pytest.raises(PdfError):
        Writer().close(0)


def test_chains_that_loop_or_are_broken():
    data, _ = page(b"")
    at = Document(data).revisions[0].xref_off
    for bad in (b"x" + data, data.replace(b"startxref", b"startxxxx"), data.replace(b"startxref\n", b"startxref\nx"), data.replace(b"startxref\n", b"startxref\n9")):
        with pytest.raises(PdfError):
            Document(bad)
    with pytest.raises(PdfError, match="loop"):
        Document(data.replace(b"/Root", b"/Prev %d/Root" % at))
    w = Writer()
    n = w.object({"A": 1})
    assert Document(w.close(n)).resolve(0).kind == "null"
    with pytest.raises(PdfError):
        Document(data).lookup(99)
    with pytest.raises(PdfError):
        Document(data).resolve(1, 5)


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("predictor", [True, False])
def test_object_streams(compress, predictor):
    objects = [(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Kids[3 0 R]/Count 1>>"), (3, b"<</Type/Page/X 1234>>"), (4, b"9999")]
    doc = Document(xref_stream_document(objects, 1, compress, predictor, members=2))
    assert [doc.lookup(n).kind for n in range(6)] == ["free", *["compressed"] * 4, "normal"]
    assert doc.resolve(4).v == 9999 and [n for n, _ in text.pages(doc)] == [3]
    if compress:
        small = Document(doc.data, Limits(inflated=60)) if not predictor else None
        if small:
            with pytest.raises(PdfError):
                Document(doc.data, Limits(inflated=8)).resolve(4)


def test_cmaps():
    cmap = b"1 begincodespacerange <00> <ff> endcodespacerange 2 beginbfchar <01> <0041> <02> <d83dde00> endbfchar 3 beginbfrange <10> <12> <0061> <20> <21> [<0078> <0079>] <30> <31> [<007a> <0077>] endbfrange"
    f = text.parse_cmap(cmap)
    assert f.width == 1 and f.codes == {1: "A", 2: "😀", 0x10: "a", 0x11: "b", 0x12: "c", 0x20: "x", 0x21: "y", 0x30: "z", 0x31: "w"}
    assert text.parse_cmap(cmap, compat=True).codes == {1: "A", 2: "😀", 0x10: "z", 0x11: "w"}
    assert text.advance(b"\x00\xff", 1) == b"\x01\x00" and text.advance(b"\x41", 3) == b"\x41"
    two = text.Font(2, {0x0102: "x"})
    assert two.decode(b"\1\2\7\7\1") == b"x" and text.Font(1, {65: "é"}).decode(b"AB") == "é".encode() + b"B"
    with pytest.raises(PdfError):
        text.parse_cmap(b"<zz>")


def test_text_operators_and_fonts():
    diffs = {"Encoding": {"Differences": [65, Name("quoteleft"), Name("uni00E9"), Name("x"), Name("unknownname"), 97, Name("fi")]}}
    doc = Document(page(b"BT /F1 9 Tf (ABCa) Tj [(B) -20 (C)] TJ ET BT (z) ' ET", **diffs)[0])
    assert text.page_text(doc, text.pages(doc)[0][1]).decode() == "‘éxﬁéx\nz\n"
    assert [fonts.glyph_char(x) for x in ("A", "uni20AC", "u1F600", "Euro", "euro", "uniZZZZ", "")] == ["A", "€", "😀", "", "€", "", ""]
    assert fonts.encode("Aé€中☃") == b"A\xe9\x80??" and fonts.string_width("Helvetica", "中", 10) == fonts.string_width("Helvetica", "?", 10)
    assert len(fonts.GLYPHS) == 80 or len(fonts.GLYPHS) == 81


def test_geometry():
    m = draw.translation(10, 0).then(draw.scaling(2, 3))
    assert m.apply(1, 1) == (22, 3) and draw.rotation(90).apply(1, 0) == pytest.approx((0, 1))
    p = draw.Path().move(0, 0).quad(3, 3, 6, 0)
    assert p.segments[1] == ("c", pytest.approx((2, 2, 4, 2, 6, 0))) and draw.Path().rect(1, 2, 3, 4).bounds() == (1, 2, 4, 6) and draw.Path().bounds() is None
    assert draw.hex_color("#ff8000") == pytest.approx((1, 128 / 255, 0)) and draw.hex_color("red") == (0, 0, 0)
    c = draw.Canvas()
    c.save()
    c.transform(draw.rotation(90))
    c.link(0, 0, 10, 5, "http://x")
    c.link(0, 0, 1, 1, "")
    with pytest.raises(PdfError):
        c.bytes()
    c.restore()
    with pytest.raises(PdfError):
        c.restore()
    c.text_right(100, 5, "ab (c)")
    c.fill_stroke(draw.Path(even_odd=True).rect(0, 0, 1, 1).close(), dash=(1, 2))
    c.clip(draw.Path().rect(0, 0, 1, 1))
    assert c.links == [(pytest.approx(-5), 0, pytest.approx(0, abs=1e-9), 10, "http://x")]
    assert b"(ab \\(c\\)) Tj ET" in c.bytes() and b"B*\n" in c.bytes() and b"W n\n" in c.bytes() and b"[1 2] 0 d" in c.bytes()


def test_markup():
    got = [(a.word, a.glue, a.brk) for a in atoms("a<b>b</b>  c&#160;d &lt;x&gt;<br/>e <x>f <unfinished")]
    assert got == [("a", False, False), ("b", True, False), ("c", False, False), ("d", False, False), ("<x>", False, False), ("", False, True), ("e", False, False), ("f", False, False), ("<unfinished", False, False)]
    a = atoms("<font size='9' color=\"#ff0000\">x</font><a href='h&amp;k'>y</a><i><b>z</b></i>")
    assert (a[0].size, a[0].color, a[1].href, a[2].font) == (9.0, (1.0, 0, 0), "h&k", "Helvetica-BoldOblique")


def test_wrapping_fills_greedily():
    rnd = random.Random(0)
    items = atoms(" ".join("x" * rnd.randrange(1, 12) for _ in range(200)), plain=True)
    lines = wrap(items, 100)
    assert [a for line in lines for a in line.atoms] == items
    for one, two in zip(lines, lines[1:], strict=False):
        first = two.atoms[0]
        assert one.width + fonts.string_width(first.font, " ", 10) + fonts.string_width(first.font, first.word, 10) > 100
        assert one.width <= 100 or len(one.atoms) == 1


def shown(data):
    doc = Document(data)
    return [text.page_text(doc, p).decode("cp1252").split() for _, p in text.pages(doc)]


def test_stories():
    para = lambda n: Paragraph(" ".join(f"w{k}" for k in range(n)))
    story = [Bookmark("A", 1), para(400), Spacer(20), Rule(), Bookmark("B", 2), Table([[para(3), para(30)], [None, para(1)]], [100, 0], [StyleOp("grid", 0, 0, -1, -1), StyleOp("pad", 0, 0, -1, -1, (2, 2, 2, 2)), StyleOp("background", 0, 0, -1, 0, (1, 0, 0)), StyleOp("valign", 0, 0, 0, 0, "bottom")]), Stack([para(5), para(6)], keep=True), Bullet(para(2)), Preformatted("x\ny"), columns([para(2), para(2)])]
    data = Doc(title="T — x", author="A", on_page=lambda c, n, total: c.text(10, 10, f"{n}of{total}")).build(story)
    pages = shown(data)
    assert pages[0][-1] == f"1of{len(pages)}" and sum(len(p) for p in pages) == 400 + 3 + 30 + 1 + 11 + 1 + 2 + 2 + 4 + len(pages)
    doc = Document(data)
    root = doc.deref(doc.revisions[0].trailer.get(b"Root"))
    top = doc.deref(root.get(b"Outlines"))
    assert top.get(b"Count").v == 2 and doc.deref(doc.deref(top.get(b"First")).get(b"First")).get(b"Title").v == b"B"
    with pytest.raises(PdfError):
        Doc().build([Bookmark("")])


def test_pages_break_where_lines_end():
    f = Frame(0, 100, 100, 52)  # room for four lines of 12
    flow = Paragraph("a<br/>b<br/>c<br/>d<br/>e<br/>f", Style(leading=12))
    lines, end = [], None
    g = flow.flow(f, __import__("pagelake.kernel.layout", fromlist=["At"]).At(0, 100))
    while True:
        try:
            lines.append(next(g))
        except StopIteration as stop:
            end = stop.value
            break
    assert [p for p, *_ in lines] == [0, 0, 0, 0, 1, 1] and end == (1, 76) and height(flow, f) == 72
    tall = Stack([Paragraph("a<br/>b<br/>c", Style(leading=12))] * 2, keep=True)
    assert height(tall, f) == 72  # taller than a page: it breaks inside


def test_outlines_and_rectangles():
    got = outline([("1", 1), ("2", 2), ("3", 2), ("4", 3), ("5", 1)])
    assert [x["parent"] for x in got] == [None, 0, 0, 2, None] and [x["count"] for x in got] == [3, 0, 1, 0, 0]
    assert (got[0]["first"], got[0]["last"], got[0]["next"], got[4]["prev"], got[2]["prev"], got[1]["next"]) == (1, 2, 4, 0, 1, 2)
    assert covers(StyleOp("x", -1, 0, 0, -1), 2, 5, 3, 6) and not covers(StyleOp("x", 1, 1, 1, 1), 0, 1, 3, 6)
    assert syntax({"A": [1, None, True, Name("N"), Ref(2), b"s", 1.5, "é"]}) == b"<</A[1 null true/N 2 0 R(s)1.5<feff00e9>]>>"


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=80) | st.text("()<>[]{}/%\\ \n+-.#0aR", max_size=80).map(str.encode), st.integers(0, 10), st.sampled_from([None, 0, 1, 3]))
def test_all_tokens_are_those_one_by_one(data, at, limit):
    from pagelake.kernel.lexer import scan, scan_all

    want, pos = [], at
    while limit is None or len(want) < limit:
        want.append(scan(data, pos))
        if want[-1][1] == "EOF":
            break
        pos = want[-1][3]
    assert list(scan_all(data, at, limit)) == want
