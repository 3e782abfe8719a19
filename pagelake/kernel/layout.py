"""Stories laid out into pages.

An element is laid out by ``flow``: a generator that is told where it begins and yields drawing calls placed on
pages, and whose end position is what it returns. Nothing is drawn while measuring, since
heights come from running the same generator against a page without a bottom.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Generator
from dataclasses import dataclass, field
from datetime import datetime
from typing import NamedTuple

from .draw import Canvas, hex_color
from .emit import Name, Ref, Writer
from .errors import PdfError
from .fonts import string_width, styled


@dataclass(frozen=True)
class Frame:
    x: float
    width: float
    top: float
    bottom: float


class At(NamedTuple):
    page: int
    y: float


Flow = Generator[tuple[int, str, tuple], None, At]  # (page, method of Canvas, arguments)
_endless = -1e18


def height(e, f: Frame) -> float:
    """How tall an element is on a page without a bottom."""
    flow = e.flow(Frame(f.x, f.width, f.top, _endless), At(0, f.top))
    while True:
        try:
            next(flow)
        except StopIteration as stop:
            return f.top - stop.value.y


def _room(f: Frame, at: At, need: float) -> At:
    """Here, or the next page's top where ``need`` doesn't fit and there is anything above."""
    return At(at.page + 1, f.top) if at.y - need < f.bottom and at.y < f.top else at


@dataclass(frozen=True)
class Style:
    font: str = "Helvetica"
    size: float = 10
    leading: float = 0
    align: str = "left"
    color: tuple[float, float, float] = (0.0, 0.0, 0.0)
    left: float = 0
    right: float = 0
    before: float = 0
    after: float = 0
    link_color: tuple[float, float, float] | None = None
    underline: bool = False

    @property
    def line(self) -> float:
        return self.leading or 1.2 * self.size


class Atom(NamedTuple):
    word: str
    font: str
    size: float
    color: tuple[float, float, float]
    href: str
    brk: bool
    glue: bool


_tag = re.compile(r"<([^>]*)>")
_attribute = r"{}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
#: The entities of the dialect.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&#160;": " ", "&amp;": "&"}
_entity = re.compile("|".join(ENTITIES))
_words = re.compile(r"[ \t\n\r\v\f]+|[^ \t\n\r\v\f]+")


def unescape(s: str) -> str:
    return _entity.sub(lambda m: ENTITIES[m[0]], s)


def _attr(tag: str, name: str) -> str:
    m = re.search(_attribute.format(name), tag)
    return (m[1] if m[1] is not None else m[2]) if m else ""


def atoms(markup: str, style: Style = Style(), plain: bool = False) -> list[Atom]:  # noqa: B008
    """Words with their looks. Tags never part words, white space does; unknown tags go, a tag that never ends is text."""
    out: list[Atom] = []
    looks = [(styled(style.font, "Bold" in style.font, "Oblique" in style.font or "Italic" in style.font), style.size, style.color, "", False, False)]
    gap = True

    def words(s: str):
        nonlocal gap
        font, size, color, href, _, _ = looks[-1]
        for m in _words.finditer(s if plain else unescape(s)):
            if m[0][0] in " \t\n\r\v\f":
                gap = True
            else:
                out.append(Atom(m[0], font, size, color, href, False, not gap and bool(out)))
                gap = False

    if plain:
        words(markup)
        return out
    at = 0
    for m in _tag.finditer(markup):
        if m.start() < at:
            continue
        words(markup[at : m.start()])
        at, tag = m.end(), m[1].strip()
        font, size, color, href, bold, italic = looks[-1]
        kind = tag.split(None, 1)[0] if tag else ""
        if tag in ("br", "br/", "br /"):
            out.append(Atom("", font, size, color, "", True, False))
            gap = True
        elif tag in ("b", "i"):
            bold, italic = bold or tag == "b", italic or tag == "i"
            looks.append((styled(style.font, bold, italic), size, color, href, bold, italic))
        elif kind.startswith("font"):
            try:
                size = float(_attr(tag, "size") or size)
            except ValueError:
                pass
            looks.append((font, size, hex_color(c) if (c := _attr(tag, "color")) else color, href, bold, italic))
        elif kind == "a" or kind.startswith("link"):
            looks.append((font, size, style.link_color or color, unescape(_attr(tag, "href")), bold, italic))
        elif tag in ("/b", "/i", "/font", "/a", "/link") and len(looks) > 1:
            looks.pop()
    words(markup[at:])
    return out


class Line(NamedTuple):
    atoms: list[Atom]
    width: float
    tallest: float
    last: bool


def wrap(items: list[Atom], avail: float) -> list[Line]:
    """Lines filled greedily. A glued word has no space before it; a break ends the line."""
    lines: list[Line] = []
    cur: list[Atom] = []
    used = 0.0
    for a in items:
        if a.brk:
            lines.append(Line(cur, used, max((x.size for x in cur), default=0), True))
            cur, used = [], 0.0
            continue
        w = string_width(a.font, a.word, a.size)
        space = string_width(a.font, " ", a.size) if cur and not a.glue else 0.0
        if cur and used + space + w > avail:
            lines.append(Line(cur, used, max(x.size for x in cur), False))
            cur, used, space = [], 0.0, 0.0
        cur.append(a)
        used += space + w
    return [*lines, Line(cur, used, max((x.size for x in cur), default=0), True)]


@dataclass
class Paragraph:
    markup: str
    style: Style = field(default_factory=Style)
    plain: bool = False

    def __post_init__(self):
        self.atoms = atoms(self.markup, self.style, self.plain)

    def flow(self, f: Frame, at: At, align: str | None = None) -> Flow:
        s, align = self.style, align or self.style.align
        avail = f.width - s.left - s.right
        if avail <= 0:
            return at
        at = At(at.page, at.y - s.before)
        for line in wrap(self.atoms, avail):
            at = _room(f, at, s.line)
            gaps = sum(not a.glue for a in line.atoms[1:])
            extra = (avail - line.width) / gaps if align == "justify" and not line.last and gaps and avail > line.width else 0.0
            x = f.x + s.left + {"right": avail - line.width, "center": (avail - line.width) / 2}.get(align, 0.0)
            size = max(line.tallest, s.size)
            base = at.y - 0.8 * size
            runs: list[list] = []
            for k, a in enumerate(line.atoms):
                if k and not a.glue:
                    x += string_width(a.font, " ", a.size) + extra
                w = string_width(a.font, a.word, a.size)
                yield at.page, "text", (x, base, a.word, a.font, a.size, a.color)
                if a.href:
                    if runs and runs[-1][0] == a.href and runs[-1][3] == k - 1:
                        runs[-1][2:] = [x + w, k]
                    else:
                        runs.append([a.href, x, x + w, k])
                x += w
            for href, x0, x1, _ in runs:
                yield at.page, "link", (x0, base - 0.2 * size, x1 - x0, size, href)
                if s.underline:
                    yield at.page, "rule", (x0, base - 0.1 * size, x1, base - 0.1 * size, size / 20, s.link_color or s.color)
            at = At(at.page, at.y - s.line)
        return At(at.page, at.y - s.after)


@dataclass
class Spacer:
    height: float

    def flow(self, f: Frame, at: At) -> Flow:
        yield from ()
        return At(at.page, max(f.bottom, at.y - self.height))


@dataclass
class Rule:
    width: float = 1
    color: tuple[float, float, float] = (0.0, 0.0, 0.0)
    before: float = 0
    after: float = 0

    def flow(self, f: Frame, at: At) -> Flow:
        at = _room(f, at, self.before + self.width + self.after)
        y = at.y - self.before - self.width / 2
        yield at.page, "rule", (f.x, y, f.x + f.width, y, self.width, self.color)
        return At(at.page, at.y - self.before - self.width - self.after)


@dataclass
class Preformatted:
    text: str
    style: Style = field(default_factory=lambda: Style("Courier"))

    def flow(self, f: Frame, at: At) -> Flow:
        for line in self.text.split("\n"):
            at = _room(f, at, self.style.line)
            yield at.page, "text", (f.x + self.style.left, at.y - 0.8 * self.style.size, line.removesuffix("\r"), self.style.font, self.style.size, self.style.color)
            at = At(at.page, at.y - self.style.line)
        return at


@dataclass
class Bookmark:
    title: str
    level: int = 0

    def flow(self, f: Frame, at: At) -> Flow:
        yield from ()
        return at


@dataclass
class Stack:
    """Elements one below the other; ``keep`` moves them to the next page together if they fit there."""

    items: list
    keep: bool = False

    def flow(self, f: Frame, at: At) -> Flow:
        if self.keep:
            tall = height(Stack(self.items), f)
            if tall <= f.top - f.bottom:
                at = _room(f, at, tall)
        for e in self.items:
            at = yield from e.flow(f, at)
        return at


@dataclass
class Bullet:
    item: object
    mark: str = "•"
    indent: float = 12
    style: Style = field(default_factory=Style)

    def flow(self, f: Frame, at: At) -> Flow:
        at = _room(f, at, self.style.line)
        yield at.page, "text", (f.x, at.y - 0.8 * self.style.size, self.mark, self.style.font, self.style.size, self.style.color)
        return (yield from self.item.flow(Frame(f.x + self.indent, f.width - self.indent, f.top, f.bottom), at))


class StyleOp(NamedTuple):
    """pad, align, valign, background, grid, box, or line over a rectangle of cells; negative corners count from the end."""

    kind: str
    c0: int
    r0: int
    c1: int
    r1: int
    value: object = None


def covers(op: StyleOp, c: int, r: int, columns: int, rows: int) -> bool:
    fix = lambda v, n: n + v if v < 0 else v
    (c0, c1), (r0, r1) = sorted((fix(op.c0, columns), fix(op.c1, columns))), sorted((fix(op.r0, rows), fix(op.r1, rows)))
    return c0 <= c <= c1 and r0 <= r <= r1


@dataclass
class Table:
    rows: list[list]
    widths: list[float] = field(default_factory=list)
    ops: list[StyleOp] = field(default_factory=list)
    pad: float = 0

    def columns(self, f: Frame) -> list[float]:
        """Column widths: given ones stay, the others share what is left."""
        if not self.widths:
            n = max(map(len, self.rows), default=0)
            return [f.width / n] * n
        free = sum(w <= 0 for w in self.widths)
        share = max(0.0, f.width - sum(w for w in self.widths if w > 0)) / free if free else 0.0
        return [w if w > 0 else share for w in self.widths]

    def of(self, kind: str, c: int, r: int, n: int, default):
        """The last operation of the kind that covers a cell."""
        return next((o.value for o in reversed(self.ops) if o.kind == kind and covers(o, c, r, n, len(self.rows))), default)

    def flow(self, f: Frame, at: At) -> Flow:
        widths = self.columns(f)
        n = len(widths)
        lefts = [f.x + sum(widths[:k]) for k in range(n)]
        pad = lambda c, r: self.of("pad", c, r, n, (self.pad,) * 4)  # noqa: E731  left, right, top, bottom
        for r, row in enumerate(self.rows):
            cells = []
            for c, e in enumerate(row[:n]):
                if e is not None:
                    p = pad(c, r)
                    inner = Frame(lefts[c] + p[0], widths[c] - p[0] - p[1], f.top, _endless)
                    cells.append((c, e, p, inner, height(e, inner)))
            tall = max((h + p[2] + p[3] for _, _, p, _, h in cells), default=0.0)
            at = _room(f, at, tall)
            low = at.y - tall
            for c in range(min(n, len(row))):
                if (color := self.of("background", c, r, n, None)) is not None:
                    yield at.page, "fill_rect", (lefts[c], low, widths[c], tall, color)
            for c, e, p, inner, h in cells:
                slack = tall - p[2] - p[3] - h
                y = at.y - p[2] - {"middle": slack / 2, "bottom": slack}.get(self.of("valign", c, r, n, "top"), 0.0)
                how = self.of("align", c, r, n, None)
                yield from e.flow(inner, At(at.page, y), how) if how and isinstance(e, Paragraph) else e.flow(inner, At(at.page, y))
            for o in self.ops:
                if o.kind in ("grid", "box", "line"):
                    yield from self._rules(o, r, at, low, lefts, widths)
            at = At(at.page, low)
        return at

    def _rules(self, o: StyleOp, r: int, at: At, low: float, lefts: list[float], widths: list[float]) -> Flow:
        width, color = o.value or (0.5, (0.0, 0.0, 0.0))
        n, rows = len(lefts), len(self.rows)
        inside = [c for c in range(n) if covers(o, c, r, n, rows)]
        if not inside:
            return
        x0, x1 = lefts[inside[0]], lefts[inside[-1]] + widths[inside[-1]]
        first, last = not covers(o, inside[0], r - 1, n, rows) or r == 0, r == rows - 1 or not covers(o, inside[0], r + 1, n, rows)
        if o.kind == "grid" or o.kind == "box" and first:
            yield at.page, "rule", (x0, at.y, x1, at.y, width, color)
        if o.kind == "grid" or o.kind == "line" or last:
            yield at.page, "rule", (x0, low, x1, low, width, color)
        if o.kind != "line":
            for x in [lefts[c] for c in inside if o.kind == "grid" or c == inside[0]] + [x1]:
                yield at.page, "rule", (x, low, x, at.y, width, color)


def columns(items: list, widths: list[float] | None = None) -> Table:
    """Elements side by side: a table of one row."""
    return Table([items], widths or [])


def outline(marks: list[tuple[str, int]]) -> list[dict]:
    """For each mark (title, level): parent, prev, next, first, last (places in the list, or None) and count of all below it."""
    out = [dict.fromkeys(("parent", "prev", "next", "first", "last")) | {"count": 0} for _ in marks]
    path: list[int] = []
    for k, (_, level) in enumerate(marks):
        older = None
        while path and marks[path[-1]][1] >= level:
            older = path.pop()
        if path:
            up = out[path[-1]]
            out[k]["parent"] = path[-1]
            if up["last"] is not None:
                older = up["last"]
            up["first"] = k if up["first"] is None else up["first"]
            up["last"] = k
        elif older is None:
            older = next((j for j in range(k - 1, -1, -1) if out[j]["parent"] is None), None)
        if older is not None:
            out[k]["prev"], out[older]["next"] = older, k
        for a in path:
            out[a]["count"] += 1
        path.append(k)
    return out


def pdf_date(t: datetime) -> str:
    minutes = int((t.utcoffset().total_seconds() if t.utcoffset() else 0) // 60)
    return f"D:{t:%Y%m%d%H%M%S}{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}'{abs(minutes) % 60:02d}'"


def _marks(e, below: list[Bookmark]) -> list[Bookmark]:
    if isinstance(e, Bookmark):
        if not e.title:
            raise PdfError("bookmark without a title")
        below.append(e)
    elif isinstance(e, Stack):
        for x in e.items:
            _marks(x, below)
    return below


@dataclass
class Doc:
    width: float = 612
    height: float = 792
    margins: tuple[float, float, float, float] = (72, 72, 72, 72)  # left, right, top, bottom
    title: str = ""
    author: str = ""
    created: datetime | None = None
    on_page: Callable[[Canvas, int, int], None] | None = None

    def build(self, story: list) -> bytes:
        """The story as a document: pages filled in order, furniture once the total is known, then fonts, pages, outline and catalog."""
        left, right, top, bottom = self.margins
        f = Frame(left, self.width - left - right, self.height - top, bottom)
        pages, at, marks = [Canvas()], At(0, f.top), []
        for e in story:
            marks += [(b.title, b.level, at.page, at.y) for b in _marks(e, [])]
            flow = e.flow(f, at)
            while True:
                try:
                    page, call, args = next(flow)
                except StopIteration as stop:
                    at = stop.value
                    break
                pages += [Canvas() for _ in range(page + 1 - len(pages))]
                getattr(pages[page], call)(*args)
            pages += [Canvas() for _ in range(at.page + 1 - len(pages))]
        if self.on_page:
            for k, c in enumerate(pages):
                self.on_page(c, k + 1, len(pages))
        w = Writer()
        root, tree = w.new_id(), w.new_id()
        faces = {n: w.object({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(n), "Encoding": Name("WinAnsiEncoding")}) for n in dict.fromkeys(n for c in pages for n in c.fonts)}
        ids = []
        for c in pages:
            content = w.stream(c.bytes())
            links = [w.object({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": list(map(float, x[:4])), "Border": [0, 0, 0], "A": {"S": Name("URI"), "URI": x[4].encode()}}) for x in c.links]
            page = {"Type": Name("Page"), "Parent": Ref(tree), "MediaBox": [0, 0, float(self.width), float(self.height)], "Contents": Ref(content)}
            page |= {"Annots": [Ref(k) for k in links]} if links else {}
            ids.append(w.object(page | {"Resources": {"Font": {f"F{k + 1}": Ref(faces[n]) for k, n in enumerate(c.fonts)}}}))
        w.object({"Type": Name("Pages"), "Kids": [Ref(k) for k in ids], "Count": len(ids)}, tree)
        catalog = {"Type": Name("Catalog"), "Pages": Ref(tree)}
        if marks:
            top_id = w.new_id()
            items = [w.new_id() for _ in marks]
            tops = []
            for k, (mark, of) in enumerate(zip(marks, outline([m[:2] for m in marks]), strict=True)):
                item = {"Title": mark[0], "Parent": Ref(items[of["parent"]] if of["parent"] is not None else top_id)}
                item |= {n.capitalize(): Ref(items[of[n]]) for n in ("prev", "next", "first", "last") if of[n] is not None}
                item |= {"Count": of["count"]} if of["count"] else {}
                w.object(item | {"Dest": [Ref(ids[mark[2]]), Name("XYZ"), None, float(mark[3]), None]}, items[k])
                tops += [items[k]] if of["parent"] is None else []
            w.object({"Type": Name("Outlines"), "First": Ref(tops[0]), "Last": Ref(tops[-1]), "Count": len(items)}, top_id)
            catalog["Outlines"] = Ref(top_id)
        info = {k: v for k, v in (("Title", self.title), ("Author", self.author)) if v} | ({"CreationDate": pdf_date(self.created).encode()} if self.created else {})
        info_id = w.object(info) if info else None
        w.object(catalog, root)
        return w.close(root, info_id)
