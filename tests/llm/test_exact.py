import hashlib
import unicodedata

from pagelake.llm.decontamination import contained, decontaminate
from pagelake.llm.fingerprints import collisions, digests, edited_fingerprints, with_next

from .helpers import LONG, documents, odd_rows


def canonical(t):
    return " ".join(unicodedata.normalize("NFKC", t).lower().split())


def test_digests_are_the_same_exactly_for_the_same_canonical_texts(spark):
    got = [(r.doc_id, r.digest) for r in digests(documents(spark)).collect()]
    forms = {r[0]: canonical(r[1] or "") for r in odd_rows()}
    assert len(got) == len(odd_rows())
    for i, a in got:
        for j, b in got:
            assert (a == b) == (forms[i] == forms[j]), (i, j)


def test_colliding_buckets_are_told_apart(spark):
    forms = spark.createDataFrame([(1, "a", 7, 7), (2, "a", 7, 7), (3, "b", 7, 7), (4, "c", 8, 8), (5, "d", 9, 9), (6, "d", 9, 9)], "doc_id long, form string, h1 long, h2 long")
    assert [(r.h1, r.sha) for r in collisions(forms).collect()] == [(7, hashlib.sha256(b"b").hexdigest())]


def test_edited_texts(spark):
    rows = sorted(odd_rows(), key=lambda r: (r[0], r[1] or ""))
    got = edited_fingerprints(documents(spark)).collect()
    want, texts = [], [r[1] or "" for r in rows]
    for k, r in enumerate(rows):
        t, after = texts[k], texts[(k + 1) % len(rows)]
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        want.append((r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canonical(edited) == canonical(t)), float(canonical(after) == canonical(t))))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == sorted(want)
    assert all((r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1) for r in got)
    assert edited_fingerprints(documents(spark, [])).count() == 0


def test_next_rows_over_ranges(spark):
    ids = [-5, 0, 1, 2, 100, 101, 5000, 9000]
    rows = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    for each in (1, 2, 3, 100):
        assert dict((r.doc_id, r.next_text) for r in with_next(rows, "text", each=each).collect()) == {a: str(b) for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}


def test_next_rows_of_any_ids(spark):
    """Ids of text, null ids, and ids that lie in a heap with one far away."""
    named = [(i, str(i)) for i in ("b", "a", "zz", None, "c", "d")]
    want = {None: "a", "a": "b", "b": "c", "c": "d", "d": "zz", "zz": "None"}
    for each in (1, 2, 100):
        assert dict((r.doc_id, r.next_text) for r in with_next(spark.createDataFrame(named, "doc_id string, text string"), "text", each=each).collect()) == want
    ids = [*range(100), 10**12]
    rows = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    assert dict((r.doc_id, r.next_text) for r in with_next(rows, "text", each=4).collect()) == {a: str(b) for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}
    assert with_next(rows.limit(0), "text").count() == with_next(spark.createDataFrame([], "doc_id string, text string"), "text").count() == 0


def test_the_query_and_its_sql(spark, sf_dir):
    import duckdb

    from pagelake.llm.queries import ORACLE_SQL, op1_decontamination

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(ORACLE_SQL["op1_decontamination"])
    got = op1_decontamination(spark, sf_dir)
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall())


def _shingles(t):
    w = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "N" else " " for c in (t or "").lower()).split()
    return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)}


def test_containment_equals_brute_force(spark):
    words = LONG.split()
    items = [(1, " ".join(words[100:140])), (2, " ".join(words[500:530]) + " these are not in it"), (3, None), (4, "too short"), (5, " ".join(words[700:705])), (6, " ".join(words[3000:3020]) + " and now something else that is nowhere at all in any of the texts here"), (1, " ".join(words[100:140]))]
    docs = [*odd_rows(), (20, "Before: " + ", ".join(words[100:140]).upper() + "! after", *[None] * 9)]
    want = {(d[0], i) for d in docs for i, t in items if (q := _shingles(t)) and len(q & _shingles(d[1])) >= 0.8 * len(q)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contained(documents(spark, docs), bench).collect()}
    assert got == want and (9, 1) in got and (20, 1) in got and (9, 6) not in got
    left = [r.doc_id for r in decontaminate(documents(spark, docs), bench).collect()]
    assert sorted(left) == sorted(d[0] for d in docs if d[0] not in {i for i, _ in want})
    assert contained(documents(spark, []), bench).count() == 0
    assert decontaminate(documents(spark), spark.createDataFrame([], "item_id long, text string")).count() == len(odd_rows())
