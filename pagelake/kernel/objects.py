"""Values, cross-reference chains and objects of one document held in memory."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from . import errors as E
from .errors import PdfError
from .flate import inflate, unpredict
from .lexer import Token, token


class Value(NamedTuple):
    """kind: null, bool, int, real, string, hexstring, name, array, dict, ref (or stream, of an object). An array's v is a list, a dictionary's a list of pairs in order."""

    kind: str
    v: Any
    off: int
    end: int

    def get(self, key: bytes) -> Value:
        """A dictionary's first value of the key, null where there is none."""
        if self.kind in ("dict", "stream"):
            return next((x for k, x in self.v if k == key), NULL)
        return NULL

    def int(self, default: int | None = None) -> int | None:
        return self.v if self.kind == "int" else default


NULL = Value("null", None, 0, 0)


@dataclass(frozen=True)
class Limits:
    literal: int = 1 << 26
    depth: int = 64
    sections: int = 4096
    inflated: int = 1 << 28
    revisions: int = 64
    tail: int = 8192


#: What makes a reference of the number before it.
_reference = re.compile(rb"[\0\t\n\f\r ]+\+?([0-9]+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")


class Parser:
    """Reads values; ``at`` is past what it has read."""

    def __init__(self, data: bytes, at: int = 0, limits: Limits = Limits()):  # noqa: B008
        self.data, self.at, self.limits = data, at, limits

    def next(self) -> Token:
        t = token(self.data, self.at, self.limits.literal)
        self.at = t.end
        return t

    def value(self, depth: int = 0, t: Token | None = None) -> Value:
        t = t or self.next()
        if t.kind == "integer":
            n = int(t.literal)
            if not -(1 << 63) <= n < 1 << 63:
                raise PdfError("integer overflow", t.pos)
            if 0 < n < 1 << 32:
                if m := _reference.match(self.data, t.end):
                    if int(m[1]) < 1 << 16:
                        self.at = m.end()
                        return Value("ref", (n, int(m[1])), t.pos, m.end())
                elif b"%" in self.data[t.end : t.end + 64]:  # a comment may stand between
                    gen = token(self.data, t.end)
                    if gen.kind == "integer" and 0 <= int(gen.literal) < 1 << 16 and (r := token(self.data, gen.end)).kind == "R":
                        self.at = r.end
                        return Value("ref", (n, int(gen.literal)), t.pos, r.end)
            return Value("int", n, t.pos, t.end)
        if t.kind == "real":
            try:
                return Value("real", float(t.literal), t.pos, t.end)
            except ValueError:
                raise PdfError(E.ILLEGAL_TOKEN, t.pos) from None
        if t.kind in ("string", "hexstring", "name"):
            return Value(t.kind, t.literal, t.pos, t.end)
        if t.kind in ("true", "false"):
            return Value("bool", t.kind == "true", t.pos, t.end)
        if t.kind == "null":
            return Value("null", None, t.pos, t.end)
        if t.kind in ("[", "<<"):
            if depth >= self.limits.depth:
                raise PdfError(E.DEPTH_LIMIT, t.pos)
            close, items = ("]", []) if t.kind == "[" else (">>", [])
            while (x := self.next()).kind != close:
                if x.kind == "EOF":
                    raise PdfError(E.UNEXPECTED_EOF, x.pos)
                if close == "]":
                    items.append(self.value(depth + 1, x))
                elif x.kind == "name":
                    items.append((x.literal, self.value(depth + 1)))
                else:
                    raise PdfError(E.UNEXPECTED_TOKEN if x.kind != "illegal" else E.ILLEGAL_TOKEN, x.pos)
            return Value("array" if close == "]" else "dict", items, t.pos, x.end)
        raise PdfError({"illegal": E.ILLEGAL_TOKEN, "EOF": E.UNEXPECTED_EOF}.get(t.kind, E.UNEXPECTED_TOKEN), t.pos)


@dataclass
class Codec:
    """How a stream's bytes are encoded, and how a cross-reference stream's rows are laid out."""

    flate: bool = False
    predictor: int = 1
    columns: int = 1
    colors: int = 1
    bits: int = 8
    w: list[int] = field(default_factory=list)

    def decode(self, raw: bytes, limit: int) -> bytes:
        out = inflate(raw, limit) if self.flate else raw
        if self.predictor >= 10:
            return unpredict(out, self.columns, self.colors, self.bits)
        if self.predictor > 1:
            raise PdfError(E.TODO)
        return out


@dataclass
class Section:
    """A run of object numbers in a cross-reference table or stream."""

    rev: int
    first: int
    count: int
    off: int
    stream: bool
    row_first: int = 0
    length: int = 0
    codec: Codec = field(default_factory=Codec)


@dataclass
class Revision:
    xref_off: int
    trailer_off: int
    classic: bool
    first_section: int
    trailer: Value


class Entry(NamedTuple):
    num: int
    kind: str  # free, normal, compressed
    off: int | None
    gen: int | None
    stm: int | None
    idx: int | None


_startxref = re.compile(rb"startxref")


class Document:
    """The index of a document, newest revision first; objects are read when asked for."""

    def __init__(self, data: bytes, limits: Limits = Limits()):  # noqa: B008
        self.data, self.limits = data, limits
        self.revisions: list[Revision] = []
        self.sections: list[Section] = []
        self._rows: dict[int, bytes] = {}
        self._stms: dict[int, tuple[bytes, list[tuple[int, int]]]] = {}
        if not data.startswith(b"%PDF-"):
            raise PdfError(E.MISSING_HEADER, 0)
        at = data.rfind(b"startxref", max(0, len(data) - limits.tail))
        if at < 0:
            raise PdfError(E.MISSING_STARTXREF)
        t = token(data, at + 9)
        if t.kind != "integer":
            raise PdfError(E.MALFORMED_STARTXREF, t.pos)
        off: int | None = int(t.literal)
        while off:
            if len(self.revisions) >= limits.revisions:
                raise PdfError(E.PREV_TOO_LONG, off)
            if not 0 < off < len(data):
                raise PdfError(E.OOB_XREF, off)
            following = (self._table if token(data, off).kind == "xref" else self._stream)(off)
            if following == off:
                raise PdfError(E.PREV_LOOP, off)
            off = following

    # -- the chain

    def _table(self, off: int) -> int | None:
        p = Parser(self.data, off, self.limits)
        p.next()
        rev = Revision(off, 0, True, len(self.sections), NULL)
        while (t := p.next()).kind == "integer":
            n = p.next()
            if n.kind != "integer" or int(t.literal) < 0 or int(n.literal) < 0:
                raise PdfError(E.BAD_SUBSECTION, n.pos)
            first, count = int(t.literal), int(n.literal)
            records = token(self.data, p.at).pos  # fixed width, so they need no reading now
            if records + 20 * count > len(self.data):
                raise PdfError(E.BAD_SUBSECTION, records)
            if count:
                self._add(Section(len(self.revisions), first, count, records, False))
            p.at = records + 20 * count
        if t.kind != "trailer":
            raise PdfError(E.UNEXPECTED_TOKEN, t.pos)
        rev.trailer_off = token(self.data, p.at).pos
        rev.trailer = p.value()
        if rev.trailer.kind != "dict":
            raise PdfError(E.UNEXPECTED_TOKEN, rev.trailer_off)
        self.revisions.append(rev)
        return rev.trailer.get(b"Prev").int()

    def _stream(self, off: int) -> int | None:
        if token(self.data, off).kind != "integer":
            raise PdfError(E.EXPECTED_XREF, off)
        _, _, d = self._object_at(off)
        if d.kind != "stream":
            raise PdfError(E.BAD_XREF_STREAM, off)
        w = [x.int(-1) for x in d.get(b"W").v] if d.get(b"W").kind == "array" else []
        length, size = d.get(b"Length").int(-1), d.get(b"Size").int(-1)
        if len(w) != 3 or not all(0 <= x <= 8 for x in w) or not w[1] or length < 0 or size < 0:
            raise PdfError(E.BAD_XREF_STREAM, off)
        codec = self._codec(d)
        codec.w = w
        index = [x.int(-1) for x in d.get(b"Index").v] if d.get(b"Index").kind == "array" else [0, size]
        if len(index) % 2 or min(index, default=0) < 0:
            raise PdfError(E.BAD_XREF_STREAM, off)
        self.revisions.append(Revision(off, d.off, False, len(self.sections), d._replace(kind="dict")))
        row = 0
        for first, count in zip(index[::2], index[1::2], strict=True):
            if count:
                self._add(Section(len(self.revisions) - 1, first, count, self._payload_start(d), True, row, length, codec))
            row += count
        return d.get(b"Prev").int()

    def _add(self, s: Section) -> None:
        if len(self.sections) >= self.limits.sections:
            raise PdfError(E.MEMORY_LIMIT)
        self.sections.append(s)

    # -- records

    def entries(self, s: Section):
        """The section's records, in order."""
        if not s.stream:
            for k in range(s.count):
                r = self.data[s.off + 20 * k : s.off + 20 * k + 20]
                off, gen = r[:10].strip(), r[11:16].strip()
                if not off.isdigit() or not gen.isdigit():
                    raise PdfError(E.BAD_SUBSECTION, s.off + 20 * k)
                free = r[17:18] == b"f"
                yield Entry(s.first + k, "free" if free else "normal", None if free else int(off), int(gen), None, None)
            return
        if s.off not in self._rows:
            self._rows[s.off] = s.codec.decode(self.data[s.off : s.off + s.length], self.limits.inflated)
        rows, (a, b, c) = self._rows[s.off], s.codec.w
        for k in range(s.count):
            r = rows[(s.row_first + k) * (a + b + c) : (s.row_first + k + 1) * (a + b + c)]
            if len(r) < a + b + c:
                raise PdfError(E.BAD_XREF_STREAM, s.off)
            kind, x, y = int.from_bytes(r[:a], "big") if a else 1, int.from_bytes(r[a : a + b], "big"), int.from_bytes(r[a + b :], "big")
            if kind == 1:
                yield Entry(s.first + k, "normal", x, y, None, None)
            elif kind == 2:
                yield Entry(s.first + k, "compressed", None, None, x, y)
            else:
                yield Entry(s.first + k, "free", None, None, None, None)

    def lookup(self, num: int) -> Entry:
        """The newest record of a number, even a free one."""
        for s in self.sections:
            if s.first <= num < s.first + s.count:
                if not s.stream:
                    one = Section(s.rev, num, 1, s.off + 20 * (num - s.first), False)
                    return next(self.entries(one))
                one = Section(s.rev, num, 1, s.off, True, s.row_first + num - s.first, s.length, s.codec)
                return next(self.entries(one))
        raise PdfError(E.OBJECT_NOT_FOUND)

    # -- objects

    def _object_at(self, off: int) -> tuple[int, int, Value]:
        p = Parser(self.data, off, self.limits)
        num, gen, word = p.next(), p.next(), p.next()
        if num.kind != "integer" or gen.kind != "integer" or word.kind != "obj":
            raise PdfError(E.BAD_HEADER, off)
        v = p.value()
        if v.kind == "dict" and token(self.data, p.at).kind == "stream":
            v = v._replace(kind="stream")
        return int(num.literal), int(gen.literal), v

    def resolve(self, num: int, gen: int | None = None) -> Value:
        """The object's value; a free number's is null."""
        return self.at(self.lookup(num), gen)

    def at(self, e: Entry, gen: int | None = None) -> Value:
        """The value of the object that a record points to."""
        if e.kind == "free":
            return NULL
        if e.kind == "compressed":
            data, at = self.member(e)
            return Parser(data, at, self.limits).value()
        if e.off >= len(self.data):
            raise PdfError(E.OOB_XREF, e.off)
        n, g, v = self._object_at(e.off)
        if n != e.num or gen is not None and g != gen:
            raise PdfError(E.ID_MISMATCH, e.off)
        return v

    def deref(self, v: Value, hops: int = 16) -> Value:
        while v.kind == "ref":
            if not hops:
                raise PdfError(E.DEPTH_LIMIT)
            v, hops = self.resolve(*v.v), hops - 1
        return v

    def _payload_start(self, d: Value) -> int:
        t = token(self.data, d.end)
        if t.kind != "stream":
            raise PdfError(E.NOT_A_STREAM, d.off)
        at = t.end
        if self.data[at : at + 2] == b"\r\n":
            return at + 2
        if self.data[at : at + 1] in (b"\n", b"\r"):
            return at + 1
        raise PdfError(E.UNEXPECTED_TOKEN, at)

    def _codec(self, d: Value) -> Codec:
        """A stream's codec: no filter, or one that is FlateDecode."""
        f = self.deref(d.get(b"Filter"))
        parms = self.deref(d.get(b"DecodeParms"))
        if f.kind == "array":
            if len(f.v) > 1:
                raise PdfError(E.TODO, d.off)
            f = self.deref(f.v[0]) if f.v else NULL
            parms = self.deref(parms.v[0]) if parms.kind == "array" and parms.v else parms
        if f.kind == "null":
            return Codec()
        if f.v != b"FlateDecode":
            raise PdfError(E.TODO, d.off)
        number = lambda k, default: parms.get(k).int(default)
        return Codec(True, number(b"Predictor", 1), number(b"Columns", 1), number(b"Colors", 1), number(b"BitsPerComponent", 8))

    def payload(self, d: Value) -> tuple[int, int, Codec]:
        """Where a stream's encoded bytes are, and their codec."""
        if d.kind != "stream":
            raise PdfError(E.NOT_A_STREAM, d.off)
        n = self.deref(d.get(b"Length")).int(-1)
        at = self._payload_start(d)
        if n < 0 or at + n > len(self.data):
            raise PdfError(E.BAD_LENGTH, d.off)
        return at, n, self._codec(d)

    def stream(self, d: Value) -> bytes:
        at, n, codec = self.payload(d)
        return codec.decode(self.data[at : at + n], self.limits.inflated)

    def object_stream(self, num: int) -> tuple[bytes, list[tuple[int, int]]]:
        """An object stream's bytes and its (number, offset) pairs."""
        if num not in self._stms:
            e = self.lookup(num)
            if e.kind == "compressed":
                raise PdfError(E.NESTED_OBJSTM)
            d = self.resolve(num)
            n, first = self.deref(d.get(b"N")).int(-1), self.deref(d.get(b"First")).int(-1)
            _, length, codec = self.payload(d)
            if n < 0 or first < 0 or codec.flate and first > length * 1032:
                raise PdfError(E.BAD_OBJSTM, d.off)
            data = self.stream(d)
            p, pairs = Parser(data, 0, self.limits), []
            for _ in range(n):
                a, b = p.next(), p.next()
                if a.kind != "integer" or b.kind != "integer" or first + int(b.literal) >= max(1, len(data)):
                    raise PdfError(E.BAD_OBJSTM, d.off)
                pairs.append((int(a.literal), first + int(b.literal)))
            self._stms[num] = data, pairs
        return self._stms[num]

    def member(self, e: Entry) -> tuple[bytes, int]:
        data, pairs = self.object_stream(e.stm)
        if not 0 <= e.idx < len(pairs) or pairs[e.idx][0] != e.num:
            raise PdfError(E.ID_MISMATCH)
        return data, pairs[e.idx][1]

    def object_end(self, off: int) -> int:
        """Past an object's ``endobj``; a payload is jumped over."""
        _, _, v = self._object_at(off)
        at = v.end
        if v.kind == "stream":
            start, n, _ = self.payload(v)
            at = start + n
        while (t := token(self.data, at)).kind not in ("endobj", "EOF"):
            at = t.end
        return t.end
