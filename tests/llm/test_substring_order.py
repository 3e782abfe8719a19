"""Which document is the first doesn't hang on the order of rows, and what an operator stores goes."""

import os
import random

import numpy as np
import pytest

from pagelake.llm import common
from pagelake.llm import substring_dedup as S

from .test_substring import cut_words, prose, repeated


def words(rnd, n):
    return "".join(f"v{rnd.randrange(10**6)} " for _ in range(n))


def held_against_brute_force(spark, rows):
    """How many words go; nothing stays that repeats in an earlier document, and nothing goes beside it but GAP words at seams."""
    got = {r.doc_id: r.cuts for r in S.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    inside = sorted(rows)
    count = 0
    for (i, text), want in zip(inside, repeated(inside), strict=True):
        mine = cut_words(text, got[i])
        assert (mine | ~want).all(), i
        assert (mine & ~want).sum() == 0, i
        count += int(mine.sum())
    return count


def test_what_only_later_documents_repeat_stays(spark):
    """Rows that don't come in the order of ids: the middle document shares a passage with the first, and more with the last."""
    rnd = random.Random(31)
    rows = []
    for k in range(0, 60, 3):
        p, q = words(rnd, 60), words(rnd, 60)
        rows += [(k + 1, p + q), (k, p), (k + 2, words(rnd, 8) + p + q)]
    assert held_against_brute_force(spark, rows) >= 20 * 180


def test_a_passage_twice_in_the_first_document(spark):
    """The longer repetition is around its second place there."""
    rnd = random.Random(32)
    rows = []
    for k in range(0, 80, 2):
        x, u, y = words(rnd, 13), words(rnd, 26), words(rnd, 13)
        rows += [(k, words(rnd, 40) + u + words(rnd, 40) + x + u + y), (k + 1, words(rnd, 20) + x + u + y + words(rnd, 20))]
    assert held_against_brute_force(spark, rows) == 40 * 52


@pytest.mark.parametrize("most", [3, 4096])
def test_buckets_of_several_documents(spark, most):
    """Also where rows of a bucket don't meet in one task; and where they do, by no join."""
    rnd = np.random.default_rng(33)
    bucket, node = rnd.integers(0, 300, 3000) << 8, rnd.integers(0, 40, 3000)
    bucket[:900] = 7 << 8
    rows = [(int(b), int(n) << S.BITS | k) for k, (b, n) in enumerate(zip(bucket, node, strict=True))]
    rows += [(1000 << 8, 5 << S.BITS | k) for k in range(20)]  # in one document only
    all_of = {}
    for b, i in rows:
        all_of.setdefault(b, []).append(i)
    want = {(b, i, min(x)) for b, x in all_of.items() if len({i >> S.BITS for i in x}) > 1 for i in x}
    out = S.company_of(spark.createDataFrame(rows, "bucket long, id long"), most)
    got = [tuple(r) for r in out.select("bucket", "id", "first").collect()]
    assert set(got) == want and len(got) == len(want)
    assert most == 3 or "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_only_the_cuts_stay_stored(spark):
    rnd = random.Random(34)
    line = prose(rnd, 70, 0)
    rows = [(k, words(rnd, 30) + line + "\n" + words(rnd, 60)) for k in range(30)]
    with common.scope() as paths:
        S.repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    left = [p for p in paths if os.path.exists(p.removeprefix("file:"))]
    assert len(left) == 1 and "/cuts-" in left[0] and len(paths) > 8


@pytest.mark.parametrize("most", [3, 4096])
def test_places_of_several_documents(spark, most):
    """A very common passage makes one row a document, not one for each run of it; and the places are the same."""
    rows = [(k << 8, d << S.BITS | 100 * (d % 3) + k) for d in range(50) for k in range(30)] + [(1000 << 8, 3 << S.BITS)]
    got = S.company_of(spark.createDataFrame(rows, "bucket long, id long").coalesce(1), most, runs=True).collect()
    assert {(r.id + k, r.first + k) for r in got for k in range(r.n)} == {(i, b >> 8) for b, i in rows if i >> S.BITS and b >> 8 < 1000}
    assert len(got) == (49 if most == 3 else 49 * 30)
