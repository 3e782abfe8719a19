"""The drawing surface of one page: operators with their coordinates, links, and the fonts in use."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import NamedTuple

from .emit import real, string
from .errors import PdfError
from .fonts import encode, string_width


class Matrix(NamedTuple):
    """x' = a x + c y + e, y' = b x + d y + f."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 1.0
    e: float = 0.0
    f: float = 0.0

    def then(self, n: Matrix) -> Matrix:
        """This matrix first, then ``n``."""
        return Matrix(self.a * n.a + self.b * n.c, self.a * n.b + self.b * n.d, self.c * n.a + self.d * n.c, self.c * n.b + self.d * n.d, self.e * n.a + self.f * n.c + n.e, self.e * n.b + self.f * n.d + n.f)

    def apply(self, x: float, y: float) -> tuple[float, float]:
        return self.a * x + self.c * y + self.e, self.b * x + self.d * y + self.f


def translation(x: float, y: float) -> Matrix:
    return Matrix(e=x, f=y)


def scaling(x: float, y: float) -> Matrix:
    return Matrix(a=x, d=y)


def rotation(degrees: float) -> Matrix:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return Matrix(c, s, -s, c)


def hex_color(s: str) -> tuple[float, float, float]:
    """#rrggbb (an alpha is ignored); anything else is black."""
    digits = s.removeprefix("#")
    try:
        return tuple(int(digits[k : k + 2], 16) / 255 for k in (0, 2, 4)) if s.startswith("#") and len(digits) in (6, 8) else (0.0, 0.0, 0.0)
    except ValueError:
        return 0.0, 0.0, 0.0


@dataclass
class Path:
    """Segments (operator, points); ``even_odd`` is the fill rule."""

    segments: list[tuple[str, tuple[float, ...]]] = field(default_factory=list)
    even_odd: bool = False

    def move(self, x, y):
        self.segments.append(("m", (x, y)))
        return self

    def line(self, x, y):
        self.segments.append(("l", (x, y)))
        return self

    def cubic(self, *p):
        self.segments.append(("c", p))
        return self

    def quad(self, x1, y1, x2, y2):
        """A quadratic curve, written as the cubic that is the same."""
        x0, y0 = self.segments[-1][1][-2:]
        third = lambda a, b: a + 2 / 3 * (b - a)
        return self.cubic(third(x0, x1), third(y0, y1), third(x2, x1), third(y2, y1), x2, y2)

    def rect(self, x, y, w, h):
        self.segments.append(("re", (x, y, w, h)))
        return self

    def close(self):
        self.segments.append(("h", ()))
        return self

    def bounds(self) -> tuple[float, float, float, float] | None:
        pts = []
        for op, p in self.segments:
            pts += [(p[0], p[1]), (p[0] + p[2], p[1] + p[3])] if op == "re" else list(zip(p[::2], p[1::2], strict=True))
        return (min(x for x, _ in pts), min(y for _, y in pts), max(x for x, _ in pts), max(y for _, y in pts)) if pts else None


def _numbers(*p: float) -> bytes:
    return b" ".join(map(real, p))


class Canvas:
    """Drawing calls in order; each is a few lines of content syntax at once."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.fonts: list[str] = []
        self.links: list[tuple[float, float, float, float, str]] = []
        self.glyphs: set[tuple[str, int]] = set()
        self.stack: list[Matrix] = []
        self.ctm = Matrix()

    def _put(self, *words: bytes) -> None:
        self.parts.append(b" ".join(words) + b"\n")

    def bytes(self) -> bytes:
        if self.stack:
            raise PdfError("graphics state is saved and not restored")
        return b"".join(self.parts)

    def save(self) -> None:
        if len(self.stack) >= 32:
            raise PdfError("graphics states nest too deep")
        self.stack.append(self.ctm)
        self._put(b"q")

    def restore(self) -> None:
        if not self.stack:
            raise PdfError("no graphics state is saved")
        self.ctm = self.stack.pop()
        self._put(b"Q")

    def transform(self, m: Matrix) -> None:
        self.ctm = m.then(self.ctm)
        self._put(_numbers(*m), b"cm")

    def text(self, x: float, y: float, s: str, font: str = "Helvetica", size: float = 12, color=(0.0, 0.0, 0.0)) -> None:
        if font not in self.fonts:
            self.fonts.append(font)
        raw = encode(s)
        self.glyphs |= {(font, c) for c in raw}
        self._put(b"BT /F%d" % (self.fonts.index(font) + 1), real(size), b"Tf", _numbers(*color), b"rg", _numbers(x, y), b"Td", string(raw), b"Tj ET")

    def text_right(self, x: float, y: float, s: str, font: str = "Helvetica", size: float = 12, color=(0.0, 0.0, 0.0)) -> None:
        self.text(x - string_width(font, s, size), y, s, font, size, color)

    def rule(self, x0, y0, x1, y1, width: float = 1, color=(0.0, 0.0, 0.0)) -> None:
        self._put(_numbers(*color), b"RG", real(width), b"w", _numbers(x0, y0), b"m", _numbers(x1, y1), b"l S")

    def fill_rect(self, x, y, w, h, color=(0.0, 0.0, 0.0)) -> None:
        self._put(_numbers(*color), b"rg", _numbers(x, y, w, h), b"re f")

    def stroke_rect(self, x, y, w, h, width: float = 1, color=(0.0, 0.0, 0.0)) -> None:
        self._put(_numbers(*color), b"RG", real(width), b"w", _numbers(x, y, w, h), b"re S")

    def _path(self, p: Path) -> None:
        for op, points in p.segments:
            self._put(*([_numbers(*points)] if points else []), op.encode())

    def pen(self, width: float = 1, cap: int = 0, join: int = 0, miter: float = 0, dash: tuple[float, ...] = (), phase: float = 0) -> None:
        words = [real(width), b"w", b"%d J %d j" % (cap, join)]
        words += [real(miter), b"M"] * bool(miter) + [b"[" + _numbers(*dash) + b"]", real(phase), b"d"] * bool(dash)
        self._put(*words)

    def fill(self, p: Path, color=(0.0, 0.0, 0.0)) -> None:
        self._put(_numbers(*color), b"rg")
        self._path(p)
        self._put(b"f*" if p.even_odd else b"f")

    def stroke(self, p: Path, color=(0.0, 0.0, 0.0), **pen) -> None:
        self._put(_numbers(*color), b"RG")
        self.pen(**pen)
        self._path(p)
        self._put(b"S")

    def fill_stroke(self, p: Path, fill=(0.0, 0.0, 0.0), stroke=(0.0, 0.0, 0.0), **pen) -> None:
        self._put(_numbers(*fill), b"rg", _numbers(*stroke), b"RG")
        self.pen(**pen)
        self._path(p)
        self._put(b"B*" if p.even_odd else b"B")

    def clip(self, p: Path) -> None:
        self._path(p)
        self._put(b"W* n" if p.even_odd else b"W n")

    def link(self, x, y, w, h, uri: str) -> None:
        """A link over a rectangle: the box around its corners as they stand on the page."""
        if uri:
            pts = [self.ctm.apply(px, py) for px in (x, x + w) for py in (y, y + h)]
            self.links.append((min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts), uri))
