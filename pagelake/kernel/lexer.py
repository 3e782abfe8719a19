"""Tokens of PDF syntax. One compiled pattern finds the shape of a token; a few small functions decode it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

#: The reserved words of the file format.
KEYWORDS = frozenset(b"obj endobj stream endstream xref trailer startxref false true null R".split())
SPACE, DELIMITERS = b"\0\t\n\f\r ", b"()<>[]{}/%"
#: What a backslash and one of these letters stand for.
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

_regular = rb"[^\0\t\n\f\r ()<>\[\]{}/%]"
#: White space and comments, then one token: a string without escapes, a number (with a fraction), a name, a word, a bracket, a
#: hexadecimal string, the beginning of any other string, or a byte that begins nothing.
_token = re.compile(
    rb"(?:[\0\t\n\f\r ]++|%[^\r\n]*+)*+(?:\(([^()\\\r]*)\)|([+-]?(?:[0-9]+(\.[0-9]*)?|\.[0-9]*))|/(" + _regular + rb"*)|(" + _regular + rb"+)|(<<|>>|[\[\]{}])|<([^>]*)>|(\()|(.))",
    re.S,
)
_in_string = re.compile(rb"[()]|\\(?:\r\n|.)?", re.S)
_escape = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|\r|\n)|(.))|\r\n?", re.S)
_hash = re.compile(rb"#([0-9a-fA-F]{2})")


class Token(NamedTuple):
    pos: int
    kind: str
    literal: bytes
    end: int


def unescape_string(raw: bytes) -> bytes:
    """The bytes of a literal string's inside."""

    def one(m: re.Match) -> bytes:
        if m[1]:
            return bytes((int(m[1], 8) & 255,))
        if m[2]:
            return b""
        if m[3]:
            return ESCAPES.get(m[3], m[3])
        return b"\n"

    return _escape.sub(one, raw) if b"\\" in raw or b"\r" in raw else raw


def unescape_hex(raw: bytes) -> bytes | None:
    """The bytes of a hexadecimal string's inside: white space is nothing, an odd last digit is a high one. None: a bad digit."""
    digits = raw.translate(None, SPACE)
    try:
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))
    except ValueError:
        return None


def unescape_name(raw: bytes) -> bytes | None:
    """A name with its #xx decoded. None: a bad digit."""
    if b"#" not in raw:
        return raw
    out = _hash.sub(lambda m: bytes((int(m[1], 16),)), raw)
    return out if raw.count(b"#") == len(_hash.findall(raw)) else None


def string_end(data: bytes, at: int) -> int:
    """Past the parenthesis that closes the string opened just before ``at``; -1: none does."""
    depth = 1
    for m in _in_string.finditer(data, at):
        if m[0] == b"(":
            depth += 1
        elif m[0] == b")":
            depth -= 1
            if not depth:
                return m.end()
    return -1


def scan(data: bytes, at: int, max_literal: int = 1 << 26) -> tuple[int, str, bytes, int]:
    """(pos, kind, literal, end) of the token at or after ``at``."""
    m = _token.match(data, at)
    if m is None:
        return len(data), "EOF", b"", len(data)
    g = m.lastindex
    raw, pos, end = m[g], m.start(g), m.end()
    if len(raw) > max_literal and g != 6:
        return pos - (g in (1, 4, 7)), "illegal", b"", end
    if g == 2:
        # A lone point is a number that has no value.
        return pos, "real" if m[3] is not None or b"." in raw else "integer", raw, end
    if g == 5:
        if raw[0] in b"+-":  # a sign without digits
            return pos, "illegal", raw[:1], pos + 1
        return pos, raw.decode() if raw in KEYWORDS else "identifier", raw, end
    if g == 1:
        return pos - 1, "string", raw, end
    if g == 4:
        value = raw if b"#" not in raw else unescape_name(raw)
        return pos - 1, "illegal" if value is None else "name", value or b"", end
    if g == 6:
        return pos, raw.decode(), raw, end
    if g == 7:
        value = unescape_hex(raw)
        return pos - 1, "illegal" if value is None else "hexstring", value or b"", end
    if g == 8:
        end = string_end(data, pos + 1)
        if end < 0 or end - pos - 2 > max_literal:
            return pos, "illegal", b"", len(data) if end < 0 else end
        return pos, "string", unescape_string(data[pos + 1 : end - 1]), end
    return pos, "illegal", raw, end


def token(data: bytes, at: int = 0, max_literal: int = 1 << 26) -> Token:
    """The token at or after ``at``."""
    return Token(*scan(data, at, max_literal))


def scan_all(data: bytes, at: int = 0, limit: int | None = None, max_literal: int = 1 << 26) -> Iterator[tuple[int, str, bytes, int]]:
    """What ``scan`` says of each token from ``at`` to the end of the data. The common kinds are told apart here, in one pass of the pattern."""
    left = -1 if limit is None else limit
    while left:
        again = False
        for m in iter(_token.scanner(data, at).match, None):  # each begins where the last ended
            if not left:
                return
            left -= 1
            g = m.lastindex
            raw = m[g]
            if g == 5 and raw[0] not in b"+-" and len(raw) <= max_literal:
                yield m.start(5), raw.decode() if raw in KEYWORDS else "identifier", raw, m.end()
            elif g == 2 and len(raw) <= max_literal:
                yield m.start(2), "real" if b"." in raw else "integer", raw, m.end()
            elif g == 1 and len(raw) <= max_literal:
                yield m.start(1) - 1, "string", raw, m.end()
            elif g == 6:
                yield m.start(6), raw.decode(), raw, m.end()
            else:
                found = scan(data, at := m.start(), max_literal)
                yield found
                if found[3] != m.end():  # it ends elsewhere than the pattern does
                    at, again = found[3], True
                    break
        if not again:
            if left:
                yield len(data), "EOF", b"", len(data)
            return


def tokens(data: bytes, at: int = 0, limit: int | None = None, max_literal: int = 1 << 26) -> Iterator[Token]:
    """Tokens from ``at`` to the end of the data, which is the last of them."""
    return map(Token._make, scan_all(data, at, limit, max_literal))


def line_and_column(data: bytes, at: int) -> tuple[int, int, int]:
    """Line and column of an offset, from 1, and the line's length; lines end with LF."""
    start = data.rfind(b"\n", 0, at) + 1
    stop = data.find(b"\n", at)
    return data.count(b"\n", 0, at) + 1, at - start + 1, (len(data) if stop < 0 else stop) - start
