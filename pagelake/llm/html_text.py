"""Main text of web pages by consensus paths of their hosts.

Each page's elements are scored as containers of its text. The page votes for its best container's
generalised path (tags with their classes, digits left out); Spark sums the votes for each host; then each
page is extracted from all elements at its host's winning path, or from its own best container where
the path has no text on it.

What classes and ids say of an element never decides alone: one that holds the article, the main part or the page's title is
kept whatever its names, and names that only hint (``with-sidebar``, ``ad-free``) count for small blocks.

Defined cases: a null or empty page, or one without text, gives an empty text. Pages without a host vote together
under the empty host. Rows with the same id are pages of their own; ties go to the path with more score, then the last by name. Broken
markup (no end tags, cut pages, stray ``<``, quotes that never end) is read as far as it goes; a page takes memory by its length, however
deep. Other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_small, stored

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title nav footer aside button select option label template svg iframe object canvas dialog menu datalist".split())
RAW = frozenset("script style noscript textarea noframes xmp".split())
BLOCK = frozenset("html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("body article main section div td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 html body article main".split())
#: What the classes and ids of text beside the article say, and words that stand with them in names that say no more.
BESIDE = frozenset("ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies dialog disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respondform share sharing sidebar signup skip social sponsor sponsored subscribe subscription toc toolbar topbar tracking widget widgets".split())
PLAIN = frozenset("area articles bar block bottom box buttons column container content form inner items left links list main outer page panel post posts right section site slot stories thread top unit wrap wrapper".split())

_markup = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|textarea|noframes|xmp)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*>|<([a-zA-Z][a-zA-Z0-9:-]*)[^>]*>""", re.S | re.I)
_named = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![\w=-])hidden(?![\w=-])""", re.I)
_digits = re.compile(r"[0-9a-f]*\d[0-9a-f]*")
#: Elements that an opening tag of the key ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body article section div main".split())
#: Tasks that a host's pages are dealt over, where the hosts' paths are too many to broadcast.
SHARES = 64
#: What an element's names say of it.
HARD, SAYS, HINTS = 3, 2, 1


class Element:
    """An open or closed element. ``path``: its place in the page's table of paths; ``mark``: whether its names say that it is beside the article."""

    __slots__ = ("tag", "path", "mark", "hidden", "linked", "up", "chars", "links", "article", "beside", "score", "inside")

    def __init__(self, tag: str, path: int, mark: int, up: Element | None):
        self.tag, self.path, self.mark, self.up = tag, path, mark, up
        self.hidden = mark == HARD or bool(up and up.hidden)
        self.linked = tag == "a" or bool(up and up.linked)
        self.chars = self.links = 0
        self.article, self.beside, self.score, self.inside = tag in ("article", "main", "h1"), False, 0.0, False


class Page:
    """A page's elements, its blocks of text, and a table of paths, each its parent's place and a step, so that deep pages take room by their length."""

    def __init__(self, page: str):
        self.steps: list[tuple[int, str]] = [(-1, "")]
        self.places: dict[tuple[int, str], int] = {}
        self.elements = [Element("", 0, 0, None)]
        self.blocks: list[tuple[Element, str, int]] = []
        self._read(page)
        self._judge()

    def open(self, tag: str, attributes: str, up: Element) -> Element:
        classes, mark = "", HARD if tag in HIDDEN else 0
        if tag == "header":
            mark = SAYS
            x: Element | None = up
            while x is not None and mark:
                mark, x = 0 if x.tag in ("article", "main") else mark, x.up
        elif tag == "form":
            mark = HINTS
        if attributes.strip():
            for m in _named.finditer(attributes):
                name, value = (m[1] or "hidden").lower(), (m[2] or m[3] or m[4] or "").lower()
                if name == "hidden" or name == "aria-hidden" and value == "true":
                    mark = HARD
                if name == "class":
                    classes = "".join("." + x for x in sorted({_digits.sub("", x).strip("-_") for x in value.split()} - {""}))
                if tag not in HEADINGS:
                    for token in value.split() if name == "class" else [value.strip()]:
                        words = [x for x in re.split(r"[^a-z]+", token) if x]
                        if any(x in BESIDE for x in words) and (name == "class" or len(words) == 1):
                            mark = max(mark, SAYS if all(x in BESIDE or x in PLAIN for x in words) else HINTS)
        path = up.path
        if tag in BLOCK and tag != "p":
            path = self.places.setdefault((up.path, tag + classes), len(self.steps))
            if path == len(self.steps):
                self.steps.append((up.path, tag + classes))
        x = Element(tag, path, mark, up)
        self.elements.append(x)
        return x

    def _read(self, page: str) -> None:
        top = at = self.elements[0]
        buffer: list[str] = []
        linked = 0

        def flush():
            nonlocal linked
            text, links = " ".join(html.unescape("".join(buffer)).split()), linked
            buffer.clear()
            linked = 0
            if text:
                home = at
                while home.up and home.tag not in BLOCK:
                    home = home.up
                self.blocks.append((home, text, min(links, len(text))))

        pos = 0
        for m in _markup.finditer(page):
            if m.start() > pos and not at.hidden:
                s = page[pos : m.start()]
                buffer.append(s)
                linked += len(s) * at.linked
            pos = m.end()
            tag = m[3] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            if m[2]:
                x = at
                while x.up and x.tag != tag:
                    x = x.up
                if x.up is None:
                    continue
                if tag in BLOCK:
                    flush()
                at = x.up
                continue
            if tag == "br":
                buffer.append(" ")
                continue
            if tag in BLOCK:
                flush()
                x = at
                while x.up and x.tag not in BLOCK:
                    x = x.up
                if x.tag == "p":
                    at = x.up or top
                if tag in CLOSES:
                    x = at
                    while x.up and x.tag not in CLOSES[tag] and x.tag not in SCOPES:
                        x = x.up
                    if x.up and x.tag in CLOSES[tag]:
                        at = x.up
            if tag not in VOID and not (m[4] or "").endswith("/"):
                at = self.open(tag, m[4] or "", at)
        if pos < len(page) and not at.hidden:
            rest = page[pos:]
            buffer.append(rest if "<" not in rest else re.sub(r"<[a-zA-Z/!][^>]*\Z", "", rest))
        flush()

    def _judge(self) -> None:
        """Which elements are beside the article, and each container's score: its text without links, less of what is deeper inside.

        Names that say no more than what is beside count, unless the article, the main part or the page's title is inside. Names that only hint
        count for a small block, and a form's for one without half of the page's text.
        """
        for home, text, links in self.blocks:
            home.chars += len(text)
            home.links += links
        for x in reversed(self.elements):
            if x.up is not None:
                x.up.chars += x.chars
                x.up.links += x.links
                x.up.article = x.up.article or x.article
        total = self.elements[0].chars
        for x in self.elements[1:]:
            if x.mark == SAYS or x.tag == "form" and 2 * x.chars < total:
                x.beside = not x.article
            elif x.mark == HINTS and x.tag != "form":
                x.beside = not x.article and 4 * x.chars < total and (x.chars < 200 or 3 * x.links >= x.chars)
            x.beside = x.beside or x.up.beside
        self.blocks = [b for b in self.blocks if not b[0].beside]
        for home, text, links in self.blocks:
            home.score += len(text) - 2 * links
        for x in reversed(self.elements):
            if x.up is not None:
                x.up.score += x.score * (0.8 if x.tag in CONTAINERS else 1.0)

    def scores(self) -> dict[int, float]:
        """The score of each container's path that has text: more for an article."""
        out: dict[int, float] = {}
        for home, _, _ in self.blocks:
            x: Element | None = home
            while x is not None and x.up is not None and not x.inside:
                x.inside = True  # met already, and all above it
                if x.tag in CONTAINERS:
                    out[x.path] = out.get(x.path, 0.0) + x.score * {"article": 3.0, "main": 2.0}.get(x.tag, 1.0)
                x = x.up
        for x in self.elements:
            x.inside = False
        return out

    def name(self, path: int) -> str:
        out = []
        while path > 0:
            path, step = self.steps[path]
            out.append(step)
        return " ".join(reversed(out))

    def find(self, name: str) -> int:
        at = 0
        for step in name.split(" ") if name else ():
            at = self.places.get((at, step), -1)
        return at

    def text_at(self, path: int) -> str:
        """The blocks inside containers at ``path``, in page order, a line each."""
        for x in self.elements[1:]:
            x.inside = x.up.inside or x.path == path and x.tag in CONTAINERS
        return "\n".join(text for home, text, _ in self.blocks if home.inside)

    def best(self) -> tuple[int, float]:
        """The best container's path and score; (0, 0) if there is none."""
        scores = self.scores()
        if not scores:
            return 0, 0.0
        most = max(scores.values())
        path = max((p for p, s in scores.items() if s == most), key=self.name)
        return path, most


def extract(page: str, path: str | None) -> str:
    own = Page(page)
    if path and (at := own.find(path)) > 0 and own.scores().get(at, 0) > 0 and (text := own.text_at(at)):
        return text
    at, _ = own.best()
    return own.text_at(at) if at else "\n".join(t for _, t, _ in own.blocks)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), F.lit("")))

    def vote(batches):
        for b in batches:
            found = []
            for x in b["html"]:
                page = Page(x)
                path, score = page.best()
                found.append((page.name(path), score))
            yield pd.DataFrame({"host": b["host"], "path": [p for p, _ in found], "score": [s for _, s in found]})

    votes = rows.select("host", "html").mapInPandas(vote, "host string, path string, score double").filter("path <> ''")
    sums = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.floor("score")).alias("score"))
    won = stored(sums.groupBy("host").agg(F.max_by("path", F.struct("n", "score", "path")).alias("path")), "hosts")

    def read(batches):
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": [extract(x, p) for x, p in zip(b["html"], b["path"], strict=True)]})

    if is_small(won):
        out = rows.join(F.broadcast(won), "host", "left")
    else:  # a host may have a third of all pages: they are dealt over SHARES tasks a host
        shares = won.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        out = rows.withColumn("share", F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.lit(SHARES)).cast("int")).join(shares, ["host", "share"], "left")
    out = out.select("page_id", "url", "html", "path")
    return out.mapInPandas(read, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
