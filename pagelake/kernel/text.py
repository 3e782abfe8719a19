"""Character maps of fonts and the text that a content stream shows."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import ILLEGAL_TOKEN, PdfError
from .fonts import glyph_char
from .lexer import scan, tokens
from .objects import NULL, Document, Value


@dataclass
class Font:
    width: int = 1
    codes: dict[int, str] = field(default_factory=dict)

    def decode(self, raw: bytes) -> bytes:
        """Unmapped codes of one byte stand for themselves, wider ones for nothing; a cut last code is dropped."""
        out = []
        for k in range(0, len(raw) - self.width + 1, self.width):
            code = int.from_bytes(raw[k : k + self.width], "big")
            if code in self.codes:
                out.append(self.codes[code].encode("utf-8", "replace"))
            elif self.width == 1:
                out.append(raw[k : k + 1])
        return b"".join(out)


def utf16(raw: bytes) -> str:
    """UTF-16 big-endian; a single byte is a code point of its own, a bad surrogate U+FFFD."""
    return chr(raw[0]) if len(raw) == 1 else raw[: len(raw) & ~1].decode("utf-16-be", "replace")


def advance(raw: bytes, by: int) -> bytes:
    """A range's destination moved on: its last two bytes count up; one byte does not."""
    if len(raw) < 2:
        return raw
    return raw[:-2] + ((int.from_bytes(raw[-2:], "big") + by) & 0xFFFF).to_bytes(2, "big")


def parse_cmap(content: bytes, compat: bool = False) -> Font:
    """The codes of a ToUnicode map. ``compat``: a block of ranges with arrays gives its first range alone, with its last array's items."""
    font, operands, items, arrays = Font(2), [], None, []
    for t in tokens(content):
        if t.kind == "illegal":
            raise PdfError(ILLEGAL_TOKEN, t.pos)
        if t.kind in ("hexstring", "string"):
            (operands if items is None else items).append(t.literal)
        elif t.kind == "[":
            items = []
        elif t.kind == "]" and items is not None:
            operands.append(items)
            arrays.append(items)
            items = None
        elif t.kind == "identifier":
            if t.literal == b"endcodespacerange" and operands:
                font.width = len(operands[0])
            elif t.literal == b"endbfchar":
                for code, to in zip(operands[::2], operands[1::2], strict=False):
                    font.codes[int.from_bytes(code, "big")] = utf16(to)
            elif t.literal == b"endbfrange":
                triples = list(zip(operands[::3], operands[1::3], operands[2::3], strict=False))
                if compat and arrays:
                    triples = [(triples[0][0], triples[0][0], arrays[-1])]
                for lo, hi, to in triples:
                    a, b = int.from_bytes(lo, "big"), int.from_bytes(hi, "big")
                    if isinstance(to, list):
                        font.codes |= {a + k: utf16(x) for k, x in enumerate(to)}
                    elif 0 <= b - a <= 0xFFFF:
                        font.codes |= {a + k: utf16(advance(to, k)) for k in range(b - a + 1)}
            operands, items, arrays = [], None, []
    return font


def differences(items: list[Value]) -> dict[int, str]:
    """Codes of an encoding's differences: a number sets the code, each name takes one and moves on."""
    code, out = 0, {}
    for x in items:
        if x.kind == "int":
            code = x.v
        elif x.kind == "name":
            if c := glyph_char(x.v.decode("utf-8", "replace")):
                out[code] = c
            code += 1
    return out


def load_font(doc: Document, v: Value) -> Font:
    d = doc.deref(v)
    to = doc.deref(d.get(b"ToUnicode"))
    if to.kind == "stream":
        return parse_cmap(doc.stream(to))
    encoding = doc.deref(d.get(b"Encoding"))
    diffs = doc.deref(encoding.get(b"Differences")) if encoding.kind == "dict" else NULL
    return Font(1, differences(diffs.v) if diffs.kind == "array" else {})


def inherited(doc: Document, page: Value, key: bytes, depth: int = 32) -> Value:
    """A page's value of a key, or that of the nearest ancestor which has it."""
    while depth:
        if (v := doc.deref(page.get(key))).kind != "null":
            return v
        page, depth = doc.deref(page.get(b"Parent")), depth - 1
        if page.kind != "dict":
            return NULL
    raise PdfError("page tree too deep")


def pages(doc: Document, depth: int = 32) -> list[tuple[int, Value]]:
    """Leaves of the page tree in order, with their object numbers."""
    root = doc.deref(doc.revisions[0].trailer.get(b"Root"))
    out: list[tuple[int, Value]] = []
    todo = [(root.get(b"Pages"), 0)]
    while todo:
        at, level = todo.pop()
        if level > depth:
            raise PdfError("page tree too deep")
        node = doc.deref(at)
        kids = doc.deref(node.get(b"Kids"))
        if kids.kind != "array":
            out.append((at.v[0] if at.kind == "ref" else 0, node))
        else:
            todo += [(k, level + 1) for k in reversed(kids.v) if k.kind == "ref"]
    return out


def page_content(doc: Document, page: Value) -> bytes:
    """The page's content streams, each with a line end after it."""
    at = page.get(b"Contents")
    v = doc.deref(at)
    if v.kind == "null":
        return b""
    parts = [v] if v.kind == "stream" else [doc.deref(x) for x in v.v if x.kind == "ref"] if v.kind == "array" else []
    return b"".join(doc.stream(p) + b"\n" for p in parts)


def page_fonts(doc: Document, page: Value) -> dict[bytes, Font]:
    fonts = doc.deref(inherited(doc, page, b"Resources").get(b"Font"))
    return {k: load_font(doc, v) for k, v in (fonts.v if fonts.kind == "dict" else []) if v.kind == "ref"}


def show_text(content: bytes, fonts: dict[bytes, Font]) -> bytes:
    """The strings that text operators show, decoded by the font in force, in drawing order; ET ends a line."""
    out, strings, last_name, font, at = [], [], b"", None, 0
    while True:
        pos, kind, literal, at = scan(content, at)
        if kind in ("string", "hexstring"):
            strings.append(literal)
        elif kind == "identifier":
            if literal == b"Tf":
                font = fonts.get(last_name)
            elif literal in (b"Tj", b"'", b'"'):
                out += [font.decode(s) if font and (font.codes or font.width > 1) else s for s in strings[-1:]]
            elif literal == b"TJ":
                out += [font.decode(s) if font else s for s in strings]
            elif literal == b"ET":
                out.append(b"\n")
            strings = []
        elif kind == "name":
            last_name = literal
        elif kind == "illegal":
            raise PdfError(ILLEGAL_TOKEN, pos)
        elif kind == "EOF":
            return b"".join(out)


def page_text(doc: Document, page: Value) -> bytes:
    return show_text(page_content(doc, page), page_fonts(doc, page))
