import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from pagelake.llm import quality as Q
from pagelake.llm import toxicity as T
from pagelake.llm.common import id_text

from .helpers import documents, odd_rows


def _brute(e, trans):
    n, p, pairs, z = len(e), np.zeros(len(e)), np.zeros((2, 2)), 0.0
    for tags in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(trans[a, b] for a, b in zip((0, *tags), tags, strict=False)) + sum(x for x, t in zip(e, tags, strict=True) if t))
        z += w
        p += w * np.array(tags)
        for a, b in zip((0, *tags), tags, strict=False):
            pairs[a, b] += w
    return p / z, pairs / z


def test_marginals_equal_enumeration(monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 3)
    rnd = np.random.default_rng(0)
    for _ in range(10):
        sizes = rnd.integers(1, 9, 4)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        e, trans = rnd.normal(size=sizes.sum()), rnd.normal(size=(2, 2))
        p, pairs = T.forward_backward(e, starts, trans)
        each = [_brute(e[s : s + n], trans) for s, n in zip(starts, sizes, strict=True)]
        assert np.allclose(p, np.concatenate([x[0] for x in each])) and np.allclose(pairs, sum(x[1] for x in each))


def _labelled(bad, n=600):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        t = [f"{rnd.choice('abcdefgh')}{rnd.choice('aeiou')}{rnd.randrange(60)}" for _ in range(60)]
        y = rnd.random() < 0.25
        for _ in range(3 * y):
            t[rnd.randrange(60)] = rnd.choice(bad)
        rows.append((i, " ".join(t)))
        labels.append((i, int(y)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = _labelled(["vile", "fool", "scumbag"])
    rows += [(1004, "\u0130\u0130\u0130 vile"), (1000, None), (1001, ""), (1002, "..."), (1003, "A fool, a VILE one. " + "ba1 " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    known = spark.createDataFrame([*labels, (5000, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.toxicity(docs, known).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[i].predicted, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert [got[1003].spans[k].asDict() for k in (0, 1)] == [{"start": 2, "end": 6}, {"start": 10, "end": 14}]
    assert [s.asDict() for s in got[1004].spans] == [{"start": 4, "end": 8}]
    assert got[1000].score == got[1001].score == got[1002].score < 0.5 and got[1000].spans == []
    left = T.reject(docs, known)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = T.toxicity(documents(spark), none).collect()
    assert len(got) == len(odd_rows()) and not any(r.predicted for r in got)
    assert T.toxicity(documents(spark, []), none).count() == 0


def test_rules_compile_to_what_they_are(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(400, len(Q.STATISTICS)))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(float)
    rules = Q.fit(x, y, trees=10)
    assert 0 < len(rules.terms) < 60
    z = rules.intercept + sum(w * Q.holds(x, r) for r, w in rules.terms)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], list(Q.STATISTICS)).select(rules.column().alias("s"))
    assert np.allclose([r.s for r in frame.collect()], 1 / (1 + np.exp(-z)))
    assert (((1 / (1 + np.exp(-z))) > 0.5) == y).mean() > 0.97


def test_quality_on_held_out_documents(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(("alpha", "beta.", "gamma", "delta,", "eps")) + str(rnd.randrange(99)) * (i % 2) for _ in range(80)) if i % 3 else "same same " * 50) for i in range(400)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.quality(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert len(got) == 402 and got[900].score == got[901].score
    assert all(got[i].predicted == int(i % 3 > 0) for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0)


def test_quality_of_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 0), (14, 1), (77, None)], "doc_id long, quality int")
    got = Q.quality(documents(spark), labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert Q.quality(documents(spark, []), labels).count() == 0
    stats = Q.statistics(id_text(documents(spark, odd_rows()[:3]))).collect()
    assert all(v == v and v is not None for r in stats for v in r)
