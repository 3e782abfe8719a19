import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelake.llm import near_dedup as N
from pagelake.llm.common import stored
from pagelake.llm.components import components, extended
from pagelake.llm.near_dedup import deduplicate, edits, near_classes

from .helpers import documents, odd_rows


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


words = st.lists(st.integers(0, 6), max_size=25)


@settings(max_examples=300, deadline=None)
@given(words, words, st.integers(0, 20))
def test_edits_equal_the_full_table(a, b, most):
    assert edits(np.array(a, np.uint64), np.array(b, np.uint64), most) == min(levenshtein(a, b), most + 1)


@settings(max_examples=200, deadline=None)
@given(words, words, st.integers(0, 20))
def test_columns_equal_the_full_table(a, b, most):
    if a and b:
        assert N._by_columns(np.array(a, np.uint64), np.array(b, np.uint64), most) == min(levenshtein(a, b), most + 1)


def test_edits_of_long_texts():
    rnd = np.random.default_rng(3)
    a = rnd.integers(0, 50, 400).astype(np.uint64)
    b = np.delete(np.insert(a, rnd.integers(0, 400, 60), 99), rnd.integers(0, 400, 20))
    assert edits(a, b, 120) == min(levenshtein(a.tolist(), b.tolist()), 121)


def test_labelled_shingles_agree_between_texts_with_and_without_repeats():
    one, two = np.arange(50, dtype=np.uint64), np.append(np.arange(50), np.arange(10)).astype(np.uint64)
    assert set(N.labelled(one).tolist()) < set(N.labelled(two).tolist())
    assert len(set(N.labelled(np.zeros(40, np.uint64)).tolist())) == 36


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2300)] + [(7, 7)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_extended(spark):
    """Edges that come later give the same components as all at once: of nodes in one, of several, of new ones, of one with itself."""
    rnd = random.Random(5)
    edge = lambda low, high: (rnd.randrange(low, high), rnd.randrange(low, high))
    early, late = [edge(0, 120) for _ in range(50)] + [(0, k) for k in range(1, 30)], [edge(0, 200) for _ in range(40)] + [(150, 151), (151, 152), (7, 8), (9, 9)]
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    want = {r.node: r.root for r in components(frame(early + late)).collect()}
    got = extended(stored(components(frame(early)), "early"), stored(frame(late), "late")).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.root for r in got} == want


def brute(texts):
    cut = {i: N.WORD.findall((t or "").lower()) for i, t in texts}
    root = {i: i for i in cut}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in cut:
        for j in cut:
            n = max(len(cut[i]), len(cut[j]))
            if i < j and abs(len(cut[i]) - len(cut[j])) <= 0.2 * n + 1e-9 and levenshtein(cut[i], cut[j]) <= 0.2 * n + 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in cut}


def test_near_classes_equal_brute_force(spark):
    rows = [r for r in odd_rows() if r[0] != 9]
    got = {r.doc_id: r.class_id for r in near_classes(documents(spark, rows)).collect()}
    assert got == brute([(r[0], r[1]) for r in rows])
    assert got[7] == got[8] == 5 and got[3] == got[2] == 1
    kept = deduplicate(documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values())) and kept.columns == documents(spark).columns
    assert near_classes(documents(spark, [])).count() == 0


def test_a_family_of_near_copies_and_a_common_passage(spark):
    """Two hundred variants of one text are one class; texts that only share half of their words stay apart."""
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(4000)}"
    base, passage, rows = [word() for _ in range(200)], [word() for _ in range(80)], []
    for k in range(200):
        t = list(base)
        for _ in range(8):
            t[rnd.randrange(200)] = word()
        rows.append((k, " ".join(t)))
    rows += [(1000 + k, " ".join([word() for _ in range(80)] + passage)) for k in range(150)]
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == 0 for k in range(200)) and all(got[1000 + k] == 1000 + k for k in range(150))


def test_pairs_within_the_edits_are_linked_however_few_minima_agree(spark):
    """A text and its copy with every tenth word changed, where the text's partner is a longer one that holds it."""
    rnd = random.Random(6)
    word, hasher, rows, met = (lambda: f"w{rnd.randrange(9000)}"), N.WordHasher(), [], []
    for k in range(0, 180, 3):
        text = [word() for _ in range(60)]
        rows += [(k, text + [word() for _ in range(60)]), (k + 1, [word() if j % 10 == 5 else w for j, w in enumerate(text)]), (k + 2, text)]
        one, two = (N.sketch(hasher(t)) for _, t in rows[-2:])
        met += [k] * bool((one == two).any())
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect()}
    assert len(met) > 30 and [k for k in met if got[k + 1] != got[k + 2] or got[k] == got[k + 1]] == []


def drifting(rnd, families, members, size, changes):
    """Texts, each made from an earlier one of its family."""
    out = []
    for _ in range(families):
        family = [[f"w{rnd.randrange(9000)}" for _ in range(size)]]
        while len(family) < members:
            t = list(rnd.choice(family))
            for k in rnd.sample(range(size), changes):
                t[k] = f"w{rnd.randrange(9000)}"
            family.append(t)
        out += family
    rnd.shuffle(out)
    return out


def joined(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(k) for k in range(n)]


def test_all_members_of_drifting_families_are_compared(spark):
    """Classes are the components of all pairs that share a sketch and are within the edits, in blocks of any size."""
    texts, hasher = drifting(random.Random(11), 6, 60, 30, 2), N.WordHasher()
    hashed = [hasher(t) for t in texts]
    keys = [N.sketch(h) for h in hashed]
    links = [(i, j) for j in range(len(texts)) for i in range(j) if (keys[i] == keys[j]).any() and edits(hashed[i], hashed[j], 6) <= 6]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_classes(docs).collect()}
    assert [got[k] for k in range(len(texts))] == joined(len(texts), links)


def test_blocks_hold_all_pairs_of_several_components_once(spark):
    rows = [(1, k, 0 if k < 70 else k // 3) for k in range(100)] + [(2, k, k) for k in range(35)] + [(3, k, k % 2) for k in range(6)]
    met = {}
    for r in N.dealt_blocks(spark.createDataFrame(rows, "bucket long, doc_id long, root long"), 10).collect():
        met.setdefault((r.bucket, r.x, r.y), []).append(r)
    pairs = [(b, *sorted((p.doc_id, q.doc_id))) for (b, x, y), g in met.items() for i, p in enumerate(g) for j, q in enumerate(g) if p.own == x and q.own == y and (i < j if x == y else True) and p.root != q.root]
    assert sorted(pairs) == sorted((b, i, j) for b, i, r in rows for c, j, s in rows if b == c and i < j and r != s)
