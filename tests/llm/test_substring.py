import random

import numpy as np
import pytest

from pagelake.llm import substring_dedup as S
from pagelake.llm.queries import op5_substring_dedup

from .helpers import documents, odd_rows


def prose(rnd, n, ends=0.05):
    """n words, some of them at a line's end."""
    return "".join(f"w{rnd.randrange(5000)}" + ("\n" if rnd.random() < ends else " ") for _ in range(n))


def repeated(rows, n=50):
    """For each row, the words that stand in a run of n that an earlier document has too (by id, then text's rows are told apart by place)."""
    first, out = {}, []
    for _, t in rows:
        w = S.word_list(t)
        hit = np.zeros(len(w), bool)
        for k in range(len(w) - n + 1):
            if first.setdefault(tuple(w[k : k + n]), len(out)) != len(out):
                hit[k : k + n] = True
        out.append(hit)
    return out


def cut_words(text, cuts):
    spans = [m.span() for m in S.WORD.finditer(text)]
    return np.array([any(c.start <= a and b <= c.end for c in cuts) for a, b in spans], bool)


def test_paragraphs_begin_at_least_hashes():
    rnd = np.random.default_rng(0)
    for _ in range(50):
        sizes, width = rnd.integers(0, 60, 5), int(rnd.integers(2, 12))
        h, first = rnd.integers(1, 1 << 60, sizes.sum()).astype(np.uint64), np.cumsum(sizes) - sizes
        want = {s + int(np.argmin(h[s : s + width])) for f, n in zip(first, sizes, strict=True) for s in range(f, f + n - width + 1)}
        assert set(S.starts(h, first, sizes, width).tolist()) == want
    assert len(S.starts(np.full(300, 7, np.uint64), np.array([0]), np.array([300]), 30)) <= 12  # one word again and again


def test_bands_reach_their_recall():
    for recall, hashes in ((0.95, 6), (0.9995, 16), (0.99, 12)):
        bands, rows = S.tune(0.8, recall, hashes)
        assert bands * rows <= hashes and 1 - (1 - 0.8**rows) ** bands >= recall and rows > 1


@pytest.fixture(scope="module")
def corpus():
    """Passages inside lines, over lines, nested in one another, at both ends; whole copies; texts that share less than 50 words."""
    rnd = random.Random(21)
    passages = [prose(rnd, n) for n in (50, 51, 55, 60, 80, 140, 300)]
    inner = " ".join(S.WORD.findall(passages[3])[8:45])  # 37 words of the one of 60: shorter than a run, and often met first
    rows = []
    for k in range(160):
        kind, text = k % 8, prose(rnd, rnd.randrange(5, 120))
        if kind == 0:
            text += inner + " "
        elif kind < 6:
            text += rnd.choice(passages)
        text += prose(rnd, rnd.randrange(0, 90))
        if kind == 3:
            text += " ".join(S.WORD.findall(rnd.choice(passages))[:49]) + " end"
        rows.append((k, text))
    rows += [(200 + k, rows[7][1]) for k in range(3)] + [(300, passages[5]), (301, prose(rnd, 30) + passages[6])]
    return rows


@pytest.mark.parametrize("large", [256, 3])
def test_every_run_of_fifty_words_in_an_earlier_document_goes(spark, corpus, monkeypatch, large):
    """Also where bands are dealt to sub-bands and blocks of a few members."""
    monkeypatch.setattr(S, "LARGE", large)
    monkeypatch.setattr(S, "BLOCK", large)
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r.doc_id: r for r in S.cut_repeats(docs).collect()}
    want = dict(zip([i for i, _ in corpus], repeated(corpus), strict=True))
    extra = 0
    for i, text in corpus:
        mine = cut_words(text, got[i].cuts)
        assert (mine | ~want[i]).all(), i  # nothing that repeats stays
        extra += int((mine & ~want[i]).sum())
        assert want[i].any() or not got[i].cuts  # clean documents are left alone
        kept, last = [], 0
        for c in got[i].cuts:
            kept.append(text[last : c.start])
            last = c.end
        assert got[i].text == "".join([*kept, text[last:]])
    assert sum(w.sum() for w in want.values()) > 5000 and extra < 60
    assert got[200].text == got[202].text == "" and got[301].cuts[0].of.doc_id < 301


def test_near_paragraphs_go_too(spark):
    """Lines of which a few words differ: Jaccard of five-word shingles 0.8 or more, and none at 0.5."""
    rnd = random.Random(3)
    rows = []
    for k in range(40):
        line = [f"w{rnd.randrange(5000)}" for _ in range(100)]
        near, far = list(line), list(line)
        for j in (30, 70):
            near[j] = "other"
        for j in range(4, 100, 9):
            far[j] = "other"
        rows += [(3 * k, " ".join(line)), (3 * k + 1, "before\n" + " ".join(near) + "\nafter"), (3 * k + 2, " ".join(far))]
    got = {r.doc_id: r.text for r in S.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[3 * k + 1] == "before\nafter" for k in range(40))
    assert all(got[i] == t for i, t in rows if i % 3 != 1)


def test_prefix_filter_loses_no_similar_pair(spark):
    rnd = random.Random(8)
    rows = []
    for k in range(60):
        base = [rnd.randrange(60) for _ in range(20)] if k % 3 == 0 else rows[-1][2]
        own = sorted({x if rnd.random() > 0.05 else rnd.randrange(60) for x in base})
        rows.append((1, k, own))
    members = spark.createDataFrame([(b, i, i, bytearray(np.array(s, np.int64).tobytes())) for b, i, s in rows], "bucket long, id long, root long, shingles binary")
    dealt = {}
    for r in S.sub_bands(members, 0.8).collect():
        dealt.setdefault(r.bucket, set()).add(r.id)
    near = [(i, j) for _, i, u in rows for _, j, v in rows if i < j and len(set(u) & set(v)) >= 0.8 * len(set(u) | set(v))]
    assert len(near) > 20 and all(any({i, j} <= ids for ids in dealt.values()) for i, j in near)


def test_odd_rows(spark):
    rows = odd_rows()
    out = S.cut_repeats(documents(spark))
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert out.count() == len(rows) and out.columns[: len(documents(spark).columns)] == documents(spark).columns
    text, source = dict(got), {r[0]: r[1] for r in rows}
    assert text[10] == source[10] and text[11] == source[11].split("\n")[1] and text[12] == source[12].split("\n")[0] + "\n"
    assert text[5] == source[5] and text[6] == text[8] == ""  # copies of 5
    assert text[1] is None and text[2] == "" and text[14] == source[14] and text[9] == source[9]
    assert S.cut_repeats(documents(spark, [])).count() == 0


def test_ids_of_text_and_clashing_columns(spark):
    rnd = random.Random(5)
    passage = prose(rnd, 60)
    rows = [("b", passage, 1, 2, "x"), ("a", prose(rnd, 9) + passage, 1, 2, "x"), (None, passage, 1, 2, "x"), ("c", None, 1, 2, "x"), ("a", passage, 1, 2, "x")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, __id int, __version int, cuts string")
    out = S.cut_repeats(docs)
    assert out.columns == [*docs.columns, "cuts_"] and out.count() == 5
    got = {(r.doc_id, len(S.word_list(r.text or ""))) for r in out.collect()}
    assert (None, 60) in got and ("b", 0) in got and ("c", 0) in got and sum(n for i, n in got if i == "a") in (9 + 60, 60)


def test_the_query(spark, sf_dir):
    got = op5_substring_dedup(spark, sf_dir).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), key=lambda r: r[0])
    want = dict(zip([i for i, _ in rows], repeated(rows), strict=True))
    cut = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i, t in rows:
        assert (cut_words(t, cut[i].cuts) | ~want[i]).all() and cut[i].n_cut == len(cut[i].cuts)
