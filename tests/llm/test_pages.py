import html
import re

import pytest

from pagelake.llm.html_text import CONTAINERS, Page, extract, main_text
from pagelake.llm.queries import op10_main_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("no markup", "no markup"),
        ("<p>a<p>b", "a\nb"),
        ("<div>a<p>b &amp; c&nbsp;d<br>e</div>", "a\nb & c d e"),
        ("<nav>menu</nav><article><h1>T</h1><p>x <a href='>'>y</a> &lt; z</p></article><footer>f</footer>", "T\nx y < z"),
        ("<article><ul><li>1<li>2</ul>tail</article>", "1\n2\ntail"),
        ("<body><div class='story'><p>long text of the story itself</p></div><div class='comments'><p>" + "reader " * 90 + "</p></div></body>", "long text of the story itself"),
        ("<script>var a='</p><p>no'</script><style>p{}</style><!-- <p>no --><p>yes", "yes"),
        ("<p hidden>no</p><p aria-hidden='true'>no</p><form><p>no</p></form><p>yes</p>", "yes"),
        ("<p>cut in a tag <b", "cut in a tag"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<script>never closed", ""),
        ("<div class='content with-sidebar'><article><p>the story</p></article><div class='sidebar'>side</div></div>", "the story"),
        ("<div id='page' class='site has-sidebar'><main><p>the story</p></main></div>", "the story"),
        ("<form id='aspnetForm'><div class='story'><p>the story is long enough</p></div></form><form>mail</form>", "the story is long enough"),
        ("<body><div class='comment-article'><p>the story is long enough</p></div><div class='comments'>x</div>", "the story is long enough"),
        ("<div class='ad-free story'><p>the story is long enough</p></div><div class='ad'>buy</div>", "the story is long enough"),
        ("<article><div class='post-header'><h1>Title</h1></div><p>text</p><h2 id='related-work'>Related work</h2><section id='comments-on-method'><p>more</p></section></article>", "Title\ntext\nRelated work\nmore"),
        ("<article><header><h1>Title</h1></header><p>text</p></article><header><p>site</p></header>", "Title\ntext"),
        ('one <a href="x>two', "one two"),
    ],
)
def test_pages(page, text):
    assert extract(page, None) == text


def test_long_and_deep_pages():
    assert extract("<div>" * 3000 + "x" + "</div>" * 3000, None) == "x"
    assert len(extract("<p>" + "word " * 200_000, None)) == 999_999


def test_deep_pages_take_memory_by_their_length():
    import tracemalloc

    tracemalloc.start()
    assert extract("<div>" * 100_000 + "x", None) == "x"
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_scores_equal_their_definition():
    """A container's score is its text less twice its links, times 0.8 for each container in between; three times that for an article, twice for main."""
    source = "<body><div class=a1>one two<section><p>three <a>four</a></p><table><tr><td>five<td>six</table></section></div><main><article>seven</article></main></body>"
    page, want = Page(source), {}
    for home, text, links in page.blocks:
        x, depth = home, 0
        while x.up is not None:
            if x.tag in CONTAINERS:
                want[x.path] = want.get(x.path, 0) + (len(text) - 2 * links) * 0.8**depth * {"article": 3, "main": 2}.get(x.tag, 1)
                depth += 1
            x = x.up
    assert page.scores() == pytest.approx(want) and page.find(page.name(page.best()[0])) == page.best()[0]


def test_votes_equal_brute_force(spark):
    """Hosts without an article element, with several layouts."""
    import random

    rnd = random.Random(4)
    rows = []
    for k in range(120):
        good, other = ("x " * rnd.randrange(10, 60) for _ in range(2))
        body = f"<div class=c{k}><div class=text><p>{good}</p></div><div class='more w-1/2'><p>{other}</p></div></div>" if k % 3 else f"<section><p>{good}</p></section><div><p>{other}</p></div>"
        rows.append((k, f"https://h{k % 5}.example/{k}", f"<html><body>{body}</body></html>"))
    votes, score = {}, {}
    for _, url, source in rows:
        page, host = Page(source), url.split("/")[2]
        path, worth = page.best()
        key = (host, page.name(path))
        votes[key], score[key] = votes.get(key, 0) + 1, score.get(key, 0) + int(worth // 1)
    won = {h: max((p for g, p in votes if g == h), key=lambda p: (votes[h, p], score[h, p], p)) for h, _ in votes}
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: extract(source, won[url.split("/")[2]]) for i, url, source in rows}


def test_hosts_vote(spark):
    story = lambda k: f"<div class='text-{k}'><p>{'good ' * 30}{k}</p></div><div class='more'><p>{'other ' * (60 if k == 9 else 3)}</p></div>"
    rows = [(k, "http://one.example/%d" % k, f"<body>{story(k)}</body>") for k in range(10)]
    rows += [(20, None, None), (21, "http://two.example/", ""), (22, "x", "<p>plain</p>"), (22, "x", "<p>plain</p>")]
    got = sorted((r.page_id, r.text, r.n_chars) for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = [(k, ("good " * 30).strip() + f" {k}") for k in range(10)] + [(20, ""), (21, ""), (22, "plain"), (22, "plain")]
    assert got == [(i, t, len(t)) for i, t in want]  # page 9 alone would have chosen otherwise
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_whole_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in op10_main_text(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", source[r.page_id], re.S)[1].replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?p>|</?h1>", inner))
        assert r.text == "\n".join(x for x in parts if x)
    assert Page("").scores() == {}
