"""Every query with SQL beside it gives the same rows in DuckDB; sources, sinks and streams work on files."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from pagelake.kernel import errors
from pagelake.operators import layout as L
from pagelake.operators import text as T
from pagelake.operators import tree as TREE
from pagelake.operators import writers as W
from pagelake.operators import xref as X
from pagelake.plans.queries import ORACLE_SQL, QUERIES
from pagelake.sources.datasource import register
from pagelake.sources.pdf import open_documents
from pagelake.streaming.ingest import append_to, newest_records, read_stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    v = float(v) if isinstance(v, decimal.Decimal) else v
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        r = con.execute(ORACLE_SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert sorted((tuple(norm(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=str) == got


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "page_text"] and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pdf"))
    rows = spark.createDataFrame([(1, "one two (three)", 0), (2, None, 1), (3, "café 中", 2)], "doc_id long, text string, k int")
    assert sum(r.bytes for r in W.save(W.updated_pages(rows, "k"), at).collect()) > 0
    return at


def test_documents_from_files(spark, folder):
    docs = open_documents(spark, folder)
    docs.register()
    assert spark.sql("SELECT count(*) FROM pdf_revision").first()[0] == 6
    texts = sorted(r.text_win1252 for r in docs.page_text(1).collect())
    assert texts == ["", "café\n?\n", "one\ntwo\n(three)\n"]
    assert {r.value_int for r in docs.walk("/Root/Pages/Kids/0/Rotate").collect()} == {90, 180}
    assert docs.walk("/Root").first().value_ref_num == 5
    assert {r.kind for r in docs.objects("stream").collect()} == {"stream"} and docs.objects(nums=[2]).count() == 3
    assert docs.raw(0, 5).first().data == b"%PDF-" and docs.tokens(0, 4).count() == 12
    assert docs.value_tree(3).filter("depth > 1").count() > 0 and docs.stream(1).count() == 3
    assert docs.trailer().count() == 3 and docs.pages().count() == 3 and docs.streams().filter("raw is not null").count() == 3
    with pytest.raises(ValueError):
        docs.raw(0, 1 << 21)


def test_data_source(spark, folder):
    register(spark)
    df = spark.read.format("pdf").option("table", "object").load(folder)
    assert df.filter("num = 5").count() == 3 and df.count() == 15
    assert spark.read.format("pdf").option("table", "object").option("nums", "1,5").load(folder).count() == 6
    assert spark.read.format("pdf").option("table", "revision").load(folder).count() == 6


def test_broken_documents_are_rows(spark):
    rows = spark.createDataFrame([("a", b"not one"), ("b", None), ("c", b"%PDF-1.7\nstartxref\n99\n%%EOF")], "path string, content binary")
    docs = open_documents(spark, rows)
    assert {(r.path, r.error) for r in docs.table("revision").collect()} == {("a", errors.MISSING_HEADER), ("c", errors.OOB_XREF)}
    assert docs.table("object").count() == 0 and docs.byte_map().count() == 0


def test_streams(spark, folder, tmp_path):
    s = read_stream(spark, folder, "xref_entry")
    append_to(s, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3 * 6 + 3
    q = newest_records(read_stream(spark, folder, "revision").select("path", "rev", "size"), ["path"], "rev").writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.rev for r in spark.table("latest").collect()) == [0, 1, 2]


def test_trees_end(spark):
    edges = spark.createDataFrame([(1, "a", "b", 0), (1, "b", "a", 0)], "doc int, parent string, child string, pos int")
    roots = spark.createDataFrame([(1, "a")], "doc int, node string")
    assert TREE.descend(edges, roots, ["doc"], depth=4).filter("too_deep").count() == 1
    with pytest.raises(ValueError):
        TREE.walk(edges, roots, "/Nowhere")


def test_small_relations(spark):
    items = spark.createDataFrame([(1, 0, 65, None), (1, 1, None, "x"), (1, 2, None, "y"), (1, 3, 97, None), (1, 4, None, "z"), (2, 0, None, "w")], "f int, o int, n int, g string")
    assert sorted((r.f, r.code, r.g) for r in T.expand_differences(items, ["f"], "o", "n", "g").collect()) == [(1, 65, "x"), (1, 66, "y"), (1, 97, "z"), (2, 0, "w")]
    old = spark.createDataFrame([("p", 0, 0), ("p", 1, 1)], "path string, rev int, first_section int")
    new = spark.createDataFrame([("p", 0, 0, 2)], "path string, rev int, first_section int, n_sections int")
    assert sorted((r.rev, r.first_section) for r in X.append_revision(old, new).collect()) == [(0, 0), (1, 2), (2, 3)]
    pieces = spark.createDataFrame([(1, 0, False, 10.0), (1, 1, True, 10.0), (1, 2, False, 10.0)], "line int, i int, glue boolean, w double")
    from pyspark.sql import functions as F

    assert L.justify_slack(pieces, ["line"], "i", F.col("glue"), "w", F.lit(50.0)).first().slack == 20.0
    widths = spark.createDataFrame([(1, 100.0), (1, 0.0), (1, 0.0)], "t int, w double")
    assert sorted(r.width for r in L.share_widths(widths, ["t"], "w", F.lit(300.0)).collect()) == [100.0, 100.0, 100.0]
    nums = X.numbers(spark.createDataFrame([(0, 5, 3)], "sec int, first_obj long, cnt long"))
    assert sorted(r.num for r in nums.collect()) == [5, 6, 7]
    m = spark.createDataFrame([(1,), (2,)], "k int")
    assert X.attributed(m, m.filter("k = 1"), ["k"]).count() == X.dangling(m, m.filter("k = 1"), ["k"]).count() == 1
    streams = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "p int, o int, t string")
    assert T.concat_streams(streams, ["p"], "o", "t").first().content == "a\nb\n"
