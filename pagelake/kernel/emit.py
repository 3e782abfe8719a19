"""Writing of PDF syntax and of whole documents."""

from __future__ import annotations

import math
import re
from decimal import Decimal

from .errors import PdfError
from .lexer import DELIMITERS, SPACE
from .objects import Document, Value

_plain_name = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%#\x00-\x20\x7f-\xff]")
_string_special = {0x28: b"\\(", 0x29: b"\\)", 0x5C: b"\\\\", 0x0D: b"\\r", 0x00: b"\\000"}
_apart = frozenset(SPACE + DELIMITERS)


def real(f: float) -> bytes:
    """The shortest decimal that reads back as ``f``, without an exponent."""
    if not math.isfinite(f) or abs(f) > 3.4028234663852886e38:
        raise PdfError("number can't be written")
    if abs(f) < 1e-20:
        return b"0"
    s = format(Decimal(repr(f)), "f")
    return (s.rstrip("0").rstrip(".") if "." in s else s).encode()


_special = re.compile(rb"[()\\\r\0]")


def string(raw: bytes) -> bytes:
    return b"(" + _special.sub(lambda m: _string_special[m[0][0]], raw) + b")"


def name(raw: bytes) -> bytes:
    return b"/" + b"".join(bytes((b,)) if _plain_name.fullmatch(bytes((b,))) else b"#%02X" % b for b in raw)


def text_string(s: str) -> bytes:
    """ASCII as a literal string, else UTF-16 with its mark, in hexadecimal."""
    return string(s.encode()) if s.isascii() else b"<feff" + s.encode("utf-16-be", "surrogatepass").hex().encode() + b">"


class Emitter:
    """Tokens with no more space between them than they need. ``close`` checks that what was opened is closed."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.open: list[bytes] = []
        self.last = b"\n"
        self.size = 0

    def raw(self, b: bytes) -> Emitter:
        if b:
            self.parts.append(b)
            self.size += len(b)
            self.last = b[-1:]
        return self

    def put(self, b: bytes) -> Emitter:
        if self.last[0] not in _apart and b[0] not in _apart:
            self.raw(b" ")
        return self.raw(b)

    def int(self, n: int) -> Emitter:
        return self.put(b"%d" % n)

    def real(self, f: float) -> Emitter:
        return self.put(real(f))

    def name(self, s: str | bytes) -> Emitter:
        self.put(name(s.encode() if isinstance(s, str) else s))
        if self.last == b"/":
            self.raw(b" ")  # an empty name must not run into what follows
        return self

    def string(self, raw: bytes) -> Emitter:
        return self.put(string(raw))

    def text(self, s: str) -> Emitter:
        return self.put(text_string(s))

    def hex(self, raw: bytes) -> Emitter:
        return self.put(b"<" + raw.hex().encode() + b">")

    def bool(self, b: bool) -> Emitter:
        return self.put(b"true" if b else b"false")

    def null(self) -> Emitter:
        return self.put(b"null")

    def ref(self, num: int, gen: int = 0) -> Emitter:
        return self.put(b"%d %d R" % (num, gen))

    def word(self, w: str) -> Emitter:
        return self.put(w.encode())

    def line(self) -> Emitter:
        return self.raw(b"\n")

    def begin(self, bracket: bytes) -> Emitter:
        self.open.append({b"[": b"]", b"<<": b">>"}[bracket])
        return self.put(bracket)

    def end(self, bracket: bytes) -> Emitter:
        if not self.open or self.open.pop() != bracket:
            raise PdfError("unbalanced dictionary or array")
        return self.put(bracket)

    def value(self, x) -> Emitter:
        """A Python value: bytes are strings, ``Name`` names, ``Ref`` references, dict and list composites, ``Raw`` as it is."""
        if x is None:
            return self.null()
        if isinstance(x, bool):
            return self.bool(x)
        if isinstance(x, int):
            return self.int(x)
        if isinstance(x, float):
            return self.real(x)
        if isinstance(x, Name):
            return self.name(str(x))
        if isinstance(x, Raw):
            return self.put(bytes(x))
        if isinstance(x, bytes):
            return self.string(x)
        if isinstance(x, str):
            return self.text(x)
        if isinstance(x, Ref):
            return self.ref(*x)
        if isinstance(x, dict):
            self.begin(b"<<")
            for k, v in x.items():
                self.name(k).value(v)
            return self.end(b">>")
        self.begin(b"[")
        for v in x:
            self.value(v)
        return self.end(b"]")

    def bytes(self) -> bytes:
        if self.open:
            raise PdfError("unbalanced dictionary or array")
        return b"".join(self.parts)


class Name(str):
    """A string that is a PDF name."""


class Raw(bytes):
    """Bytes that are PDF syntax already."""


class Ref(tuple):
    def __new__(cls, num: int, gen: int = 0):
        return super().__new__(cls, (num, gen))


def syntax(x) -> bytes:
    return Emitter().value(x).bytes()


def record(off: int, gen: int, free: bool = False) -> bytes:
    """A classic cross-reference record of 20 bytes."""
    if not 0 <= off <= 9_999_999_999:
        raise PdfError("PDF feature not implemented yet")
    return b"%010d %05d %c\r\n" % (off, gen, b"f"[0] if free else b"n"[0])


class Writer:
    """A document, or a revision after a base document. Objects may be written again: the last one of a number counts."""

    def __init__(self, base: bytes | None = None, version: str = "1.7"):
        self.log: list[tuple[int, int, int]] = []  # number, generation, offset
        self.closed = False
        if base is None:
            self.parts, self.at, self.prev, self.next = [], 0, None, 1
            self._write(b"%%PDF-%s\n%%\xe2\xe3\xcf\xd3\n" % version.encode())
            self.base = None
        else:
            self.base = Document(base)
            self.parts, self.at = [], 0
            self._write(base if base.endswith(b"\n") else base + b"\n")
            self.prev = self.base.revisions[0].xref_off
            self.next = max([self.base.revisions[0].trailer.get(b"Size").int(1), *(s.first + s.count for s in self.base.sections)])

    def _write(self, b: bytes) -> None:
        if self.closed:
            raise PdfError("document is closed")
        self.parts.append(b)
        self.at += len(b)

    def new_id(self) -> int:
        self.next += 1
        return self.next - 1

    def object(self, value, num: int | None = None, gen: int = 0) -> int:
        num = self.new_id() if num is None else num
        if num <= 0:
            raise PdfError("object 0 can't be written")
        body = syntax(value)
        self.log.append((num, gen, self.at))
        self._write(b"%d %d obj\n" % (num, gen) + body + b"\nendobj\n")
        self.next = max(self.next, num + 1)
        return num

    def stream(self, payload: bytes, extra: dict | None = None, num: int | None = None, gen: int = 0, length: Ref | None = None) -> int:
        """A stream object; its /Length may be an object of its own."""
        num = self.new_id() if num is None else num
        head = syntax({**(extra or {}), "Length": length if length is not None else len(payload)})
        self.log.append((num, gen, self.at))
        self._write(b"%d %d obj\n" % (num, gen) + head + b"\nstream\n" + payload + b"\nendstream\nendobj\n")
        self.next = max(self.next, num + 1)
        return num

    def copy(self, doc: Document, v: Value) -> Raw:
        """A value of another document, as it stands there. Streams can't be copied so."""
        if v.kind == "stream":
            raise PdfError("value is a stream object")
        return Raw(doc.data[v.off : v.end]) if v.kind != "null" else Raw(b"null")

    def close(self, root: int, info: int | None = None) -> bytes:
        """Table and trailer: runs of consecutive numbers, the last offset of each."""
        if not root:
            raise PdfError("document without a root")
        last = {num: record(off, gen) for num, gen, off in self.log}
        if self.prev is None:
            last[0] = record(0, 65535, True)
        numbers, start = sorted(last), self.at
        out = [b"xref\n"]
        k = 0
        while k < len(numbers):
            j = k
            while j + 1 < len(numbers) and numbers[j + 1] == numbers[j] + 1:
                j += 1
            out.append(b"%d %d\n" % (numbers[k], j - k + 1))
            out += [last[n] for n in numbers[k : j + 1]]
            k = j + 1
        trailer = {"Size": max([self.next, *(n + 1 for n in numbers)]), "Root": Ref(root)}
        if info:
            trailer["Info"] = Ref(info)
        if self.prev is not None:
            trailer["Prev"] = self.prev
        out.append(b"trailer\n" + syntax(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % start)
        self._write(b"".join(out))
        self.closed = True
        return b"".join(self.parts)


def xref_stream_document(objects: list[tuple[int, bytes]], root: int, compress: bool = True, predictor: bool = True, members: int = 100) -> bytes:
    """A document whose objects (number, syntax) are in object streams, found by a cross-reference stream; for tests and size."""
    import zlib

    w = Writer(version="1.5")
    w.next = max(n for n, _ in objects) + 1
    rows: dict[int, tuple[int, int, int]] = {0: (0, 0, 65535)}
    for at in range(0, len(objects), members):
        part = objects[at : at + members]
        offsets, body = [], b""
        for _, x in part:
            offsets.append(len(body))
            body += x + b"\n"
        head = b" ".join(b"%d %d" % (n, o) for (n, _), o in zip(part, offsets, strict=True)) + b"\n"
        raw = zlib.compress(head + body) if compress else head + body
        stm = w.stream(raw, {"Type": Name("ObjStm"), "N": len(part), "First": len(head), **({"Filter": Name("FlateDecode")} if compress else {})})
        rows |= {n: (2, stm, k) for k, (n, _) in enumerate(part)}
    rows |= {n: (1, off, gen) for n, gen, off in w.log}
    me = w.new_id()
    rows[me] = (1, w.at, 0)
    table = b"".join(bytes((a,)) + b.to_bytes(4, "big") + c.to_bytes(2, "big") for a, b, c in (rows.get(n, (0, 0, 0)) for n in range(me + 1)))
    extra = {"Type": Name("XRef"), "Size": me + 1, "W": [1, 4, 2], "Root": Ref(root)}
    if predictor:
        lines = [table[k : k + 7] for k in range(0, len(table), 7)]
        table = b"".join(b"\2" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True)) for row, above in zip(lines, [bytes(7), *lines], strict=False))
        extra["DecodeParms"] = {"Predictor": 12, "Columns": 7}
        compress = True
    if compress:
        table, extra["Filter"] = zlib.compress(table), Name("FlateDecode")
    start = w.at
    w.stream(table, extra, num=me)
    w._write(b"startxref\n%d\n%%%%EOF\n" % start)
    return b"".join(w.parts)
