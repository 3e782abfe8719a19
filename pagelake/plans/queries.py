"""The engine's queries over the driver's tables, each beside the SQL that says the same of the tables' own rows.

Queries over documents write PDFs from rows and read them again, so the reader is held against what the writer was given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import syntax as S
from ..kernel.fonts import HELVETICA
from ..operators import layout as L
from ..operators import ranges as R
from ..operators import text as T
from ..operators import tree as TREE
from ..operators import writers as W
from ..operators import xref as X
from ..sources.pdf import Documents

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str = ""):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Words of a text as a page shows them: one to a line, a question mark for what WinAnsi lacks.
_WORDS = r"""list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[^\x09-\x0d\x20-\x7e\x{a0}-\x{ff}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]', '?', 'g'), '[ \t\n\r\x0b\f]+'), lambda x: x <> '')"""
_PAGE = f"SELECT doc_id, CASE WHEN len(w) = 0 THEN '' ELSE array_to_string(w, chr(10)) || chr(10) END AS page_text FROM (SELECT doc_id, {_WORDS} AS w FROM documents)"


def _text(docs: DataFrame, text: str = "text_win1252") -> DataFrame:
    """doc_id, page_text: all pages of each document in order (a page ends with a line end)."""
    pages = Documents(docs).page_text()
    parts = F.array_sort(F.collect_list(F.struct("page", F.col(text).alias("t"))))
    return pages.groupBy("path").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("page_text")).select(F.col("path").cast("long").alias("doc_id"), "page_text")


@query(_PAGE)
def pdf_page_text(spark, d):
    docs = W.word_pages(t(spark, d, "documents"))
    return Documents(docs).page_text(1).select(F.col("path").cast("long").alias("doc_id"), F.col("text_win1252").alias("page_text"))


@query(_PAGE)
def flate_page_text(spark, d):
    docs = W.word_pages(t(spark, d, "documents"), compress=True)
    return Documents(docs).page_text(1).select(F.col("path").cast("long").alias("doc_id"), F.col("text_win1252").alias("page_text"))


@query(_PAGE)
def story_page_text(spark, d):
    return _text(L.build_documents(t(spark, d, "documents"), "doc_id", "text"))


@query("SELECT what, kind, n * (SELECT count(*) FROM documents) AS n FROM (VALUES ('record', 'free', 1), ('record', 'normal', 5), ('value', 'dict', 4), ('value', 'stream', 1)) v(what, kind, n)")
def pdf_object_kinds(spark, d):
    return Documents(W.word_pages(t(spark, d, "documents"))).kinds()


def _updated(spark, d) -> DataFrame:
    return W.updated_pages(t(spark, d, "documents").withColumn("k", F.col("doc_id") % 3), "k")


@query("SELECT doc_id, 1 + doc_id % 3 AS revisions, 1 + doc_id % 3 AS sections, 'table' || repeat(',table', (doc_id % 3)::INT) AS forms, 6::BIGINT AS size, 5::BIGINT AS root_num FROM documents")
def pdf_info(spark, d):
    return Documents(_updated(spark, d)).info().select(F.col("path").cast("long").alias("doc_id"), "revisions", "sections", "forms", "size", "root_num")


@query("SELECT doc_id, rev, rev AS first_section, CASE WHEN rev = doc_id % 3 THEN 1 + doc_id % 3 ELSE rev + 1 END AS end_section, CASE WHEN rev = doc_id % 3 THEN 6 ELSE 1 END AS objects FROM documents, (VALUES (0), (1), (2)) v(rev) WHERE rev <= doc_id % 3")
def pdf_revisions(spark, d):
    r = Documents(_updated(spark, d)).revisions()
    return r.select(F.col("path").cast("long").alias("doc_id"), *(F.col(c).cast("long").alias(c) for c in ("rev", "first_section", "end_section", "objects")))


@query("SELECT live, kind, CASE WHEN live THEN n * (SELECT count(*) FROM documents) ELSE (SELECT sum(doc_id % 3)::BIGINT FROM documents) END AS n FROM (VALUES (true, 'free', 1), (true, 'normal', 5), (false, 'normal', 0)) v(live, kind, n)")
def pdf_xref(spark, d):
    return Documents(_updated(spark, d)).xref(include_shadowed=True).groupBy("live", "kind").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 90 * (doc_id % 3) END AS rotate FROM documents")
def pdf_walk(spark, d):
    docs = Documents(_updated(spark, d))
    at = docs.walk("/Root/Pages/Kids/0/Rotate").select("path", F.col("value_int").alias("rotate"))
    return docs.docs.select("path").join(at, "path", "left").select(F.col("path").cast("long").alias("doc_id"), "rotate")


@query("SELECT count(*) AS documents, 0::BIGINT AS gaps, 0::BIGINT AS overlaps FROM documents")
def pdf_byte_map(spark, d):
    """Between a document's parts there is a line end at most, and nothing overlaps."""
    m = Documents(W.word_pages(t(spark, d, "documents"))).byte_map()
    return m.agg(F.countDistinct("path").alias("documents"), F.sum((F.col("gap") > 1).cast("long")).alias("gaps"), F.sum((F.col("overlap") > 0).cast("long")).alias("overlaps"))


@query("SELECT doc_id, n_chars AS x FROM documents")
def pdf_object_streams(spark, d):
    """Numbers kept in objects of object streams, found by predicted cross-reference streams."""
    docs = W.compact(t(spark, d, "documents"), "doc_id", "n_chars")
    e = Documents(docs).entries([3]).filter(F.col("key") == F.lit("X").cast("binary"))
    return e.select(F.col("path").cast("long").alias("doc_id"), F.col("value_int").alias("x"))


@query("SELECT doc_id, 3::BIGINT AS members, 5::BIGINT AS objects, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END::BIGINT AS unreadable, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END::BIGINT AS in_streams FROM documents")
def pdf_readability(spark, d):
    """Where the object stream of a document is broken (each third), its members can't be read; the other objects can."""
    docs = W.compact(t(spark, d, "documents"), "doc_id", "n_chars")
    broken = F.expr("overlay(content PLACING X'00' FROM instr(decode(content, 'ISO-8859-1'), 'stream\\n') + 7)")
    docs = Documents(docs.withColumn("content", F.when(F.col("path").cast("long") % 3 == 0, broken).otherwise(F.col("content"))))
    members = docs.object_streams().select("path", "members")
    return docs.readability().join(members, "path").select(F.col("path").cast("long").alias("doc_id"), "members", "objects", "unreadable", "in_streams")


@query(f"SELECT doc_id, 10 * len({_WORDS}) AS tokens FROM documents")
def tokens_lex(spark, d):
    """Tokens of each page's content: ten for each word shown."""
    docs = W.word_pages(t(spark, d, "documents"))
    content = Documents(docs).streams(True, [1]).select("path", F.col("data").alias("content"))
    n = Documents(content).tokens(0, None).groupBy("path").agg(F.sum((F.col("tok") != "EOF").cast("long")).alias("tokens"))
    return n.select(F.col("path").cast("long").alias("doc_id"), "tokens")


@query(f"SELECT 'font' AS family, len(w) AS n, doc_id FROM (SELECT doc_id, {_WORDS} AS w FROM documents)")
def operators_by_kind(spark, d):
    """Text objects of each page's content, counted by their operand groups."""
    docs = W.word_pages(t(spark, d, "documents"))
    content = Documents(docs).streams(True, [1]).select("path", F.col("data").alias("content"))
    tok = T.operand_groups(Documents(content).tokens(0, None), ["path"], ["ord"], F.col("tok") == "identifier")
    n = tok.filter(F.col("lit") == F.lit("Tf").cast("binary")).groupBy("path").agg(F.count("*").alias("n"))
    return content.select("path").join(n, "path", "left").select(F.lit("font").alias("family"), F.coalesce("n", F.lit(0)).alias("n"), F.col("path").cast("long").alias("doc_id"))


# -- cross-reference relations


def _log(spark, d) -> DataFrame:
    return t(spark, d, "orders").select(F.col("o_custkey").alias("num"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("kind"))


@query("SELECT o_custkey AS num, o_orderkey AS seq, o_orderstatus AS kind FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def xref_newest_wins(spark, d):
    return X.newest(_log(spark, d), ["num"], "seq")


@query("SELECT o_custkey AS num, o_orderkey AS seq, o_orderstatus AS kind FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) > 1")
def xref_shadowed(spark, d):
    return X.shadowed(_log(spark, d), ["num"], "seq")


@query("SELECT c_custkey, min(n_nationkey)::BIGINT AS sec FROM customer JOIN nation ON c_custkey >= n_nationkey * 50 AND c_custkey < n_nationkey * 50 + 120 GROUP BY c_custkey")
def section_range_lookup(spark, d):
    sections = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("sec"), (F.col("n_nationkey") * 50).cast("long").alias("first_obj"), F.lit(120).cast("long").alias("cnt"))
    return X.first_match(t(spark, d, "customer").select("c_custkey"), sections, "c_custkey", "first_obj", "cnt", "sec")


@query("SELECT c_nationkey::BIGINT AS doc, c_custkey, min(s_suppkey)::BIGINT AS sec FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey >= s_suppkey * 10 AND c_custkey < s_suppkey * 10 + 400 GROUP BY 1, 2")
def section_lookup_by_document(spark, d):
    """The first section that holds a number, of the number's own document."""
    sections = t(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("doc"), F.col("s_suppkey").alias("sec"), (F.col("s_suppkey") * 10).alias("first_obj"), F.lit(400).cast("long").alias("cnt"))
    return X.first_match(t(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("doc"), "c_custkey"), sections, "c_custkey", "first_obj", "cnt", "sec", keys=("doc",))


@query("SELECT s_nationkey::BIGINT AS doc, s_suppkey AS rev, coalesce(lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), 100000 + s_nationkey) AS end_section FROM supplier")
def revision_bounds(spark, d):
    r = t(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("doc"), F.col("s_suppkey").alias("rev"))
    return X.revision_bounds(r, ["doc"], "rev", "rev", F.col("doc") + 100000)


@query("SELECT p_brand, p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey)::BIGINT - p_size AS row_first FROM part")
def index_cumulative(spark, d):
    p = t(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("long").alias("p_size"))
    return X.index_bases(p, ["p_brand"], "p_partkey", "p_size").drop("p_size")


@query("""SELECT source, doc_id, greatest(0, s - m) AS gap, coalesce(greatest(0, m - s), 0) AS overlap FROM (
SELECT *, max(e) OVER (PARTITION BY source ORDER BY s, e, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (
SELECT source, doc_id, s, s + n_chars AS e FROM (SELECT source, doc_id, n_chars, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars + (doc_id % 7 - 3) * 40)::BIGINT AS s FROM documents)))""")
def byte_map_gaps(spark, d):
    docs = X.index_bases(t(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], "doc_id", "n_chars")
    r = docs.select("source", F.col("doc_id").alias("label"), (F.col("row_first") + (F.col("doc_id") % 7 - 3) * 40).alias("start"), "n_chars").withColumn("end", F.col("start") + F.col("n_chars"))
    return R.gaps(r, ["source"]).select("source", F.col("label").alias("doc_id"), "gap", "overlap")


@query("SELECT o_orderkey, printf('%010d %05d ', o_orderkey, o_custkey % 65536) || CASE WHEN o_orderstatus = 'F' THEN 'f' ELSE 'n' END AS record, o_orderkey AS off, o_custkey % 65536 AS gen, CASE WHEN o_orderstatus = 'F' THEN 'free' ELSE 'normal' END AS kind FROM orders")
def xref_classic_format(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", S.classic_record(F.col("o_orderkey"), F.col("o_custkey") % 65536, F.col("o_orderstatus") == "F").alias("raw"))
    f = X.parse_record(F.col("raw"))
    return o.select("o_orderkey", F.rtrim(F.replace("raw", F.lit("\r\n"), F.lit(""))).alias("record"), f["off"].alias("off"), f["gen"].cast("long").alias("gen"), f["kind"].alias("kind"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'normal' ELSE 'compressed' END AS kind, CASE WHEN l_linenumber % 3 > 0 THEN l_partkey END AS x, CASE WHEN l_linenumber % 3 > 0 THEN l_suppkey % 65536 END AS y FROM lineitem")
def xref_stream_decode(spark, d):
    width = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    row = F.unhex(F.concat(width(F.col("l_linenumber") % 3, 1), width(F.col("l_partkey"), 4), width(F.col("l_suppkey") % 65536, 2)))
    f = X.stream_fields(F.col("row"), (1, 4, 2))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", row.alias("row")).select("l_orderkey", "l_linenumber", *(c.alias(k) for k, c in f.items()))


@query("SELECT vec_id, u.k - 1 AS k, floor((u.x::DOUBLE + 4) * 30)::BIGINT % 256 AS byte FROM (SELECT vec_id, unnest(list_transform(range(1, len(embedding) + 1), lambda i: {'k': i, 'x': embedding[i]})) AS u FROM embeddings)")
def png_up_unfilter(spark, d):
    """Bytes filtered by the row above, and back by a running sum: the relational form of a table with nothing but that filter."""
    from pyspark.sql.window import Window

    down = Window.partitionBy("k").orderBy("vec_id")
    cells = t(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x")).select("vec_id", F.col("k").cast("long").alias("k"), (F.floor((F.col("x").cast("double") + 4) * 30) % 256).alias("byte"))
    filtered = cells.select("vec_id", "k", F.pmod(F.col("byte") - F.coalesce(F.lag("byte").over(down), F.lit(0)), F.lit(256)).alias("delta"))
    return filtered.select("vec_id", "k", (F.sum("delta").over(down) % 256).alias("byte"))


_DIGIT = "instr('0123456789ABCDEF', h[{0}]) - 1"


@query(f"""SELECT doc_id, ((1 + coalesce(list_sum(b), 0)) % 65521) + 65536 * ((len(b) + coalesce(list_sum(list_transform(range(1, len(b) + 1), lambda i: (len(b) - i + 1) * b[i])), 0)) % 65521) AS adler
FROM (SELECT doc_id, list_transform(range(0, len(h) // 2), lambda i: ({_DIGIT.format('2 * i + 1')}) * 16 + {_DIGIT.format('2 * i + 2')}) AS b FROM (SELECT doc_id, string_split(hex(encode(text)), '') AS h FROM documents))""")
def adler32(spark, d):
    return t(spark, d, "documents").select("doc_id", S.adler32(F.encode("text", "UTF-8")).alias("adler"))


@query("SELECT o_orderpriority AS doc, min(k) AS first_obj, count(*) AS cnt FROM (SELECT o_orderpriority, k, k - row_number() OVER (PARTITION BY o_orderpriority ORDER BY k) AS i FROM (SELECT DISTINCT o_orderpriority, o_custkey AS k FROM orders)) GROUP BY o_orderpriority, i")
def section_islands(spark, d):
    return X.section_runs(t(spark, d, "orders").select(F.col("o_orderpriority").alias("doc"), F.col("o_custkey").alias("num")), ["doc"])


# -- trees


def _edges(spark, d) -> DataFrame:
    n, c = t(spark, d, "nation"), t(spark, d, "customer")
    region = n.select(F.col("n_regionkey").cast("long").alias("doc"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("parent"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("child"), F.col("n_nationkey").cast("long").alias("pos"))
    nation = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_regionkey").cast("long").alias("doc"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("parent"), F.concat(F.lit("C"), F.col("c_custkey")).alias("child"), F.col("c_custkey").alias("pos"))
    return region.unionByName(nation)


@query("""SELECT doc, node, row_number() OVER (PARTITION BY doc ORDER BY a, b) AS page FROM (
SELECT n_regionkey::BIGINT AS doc, 'C' || c_custkey AS node, n_nationkey AS a, c_custkey AS b FROM nation JOIN customer ON c_nationkey = n_nationkey
UNION ALL SELECT n_regionkey, 'N' || n_nationkey, n_nationkey, -1 FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer))""")
def tree_pages(spark, d):
    roots = t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("doc"), F.concat(F.lit("R"), F.col("r_regionkey")).alias("node"))
    return TREE.ordered_leaves(_edges(spark, d), roots, ["doc"]).withColumn("page", F.col("page").cast("long"))


@query("SELECT n_regionkey::BIGINT AS doc, 'C' || c_custkey AS node, CASE WHEN c_custkey % 10 = 0 THEN 'own' WHEN n_nationkey % 3 = 0 THEN 'N' || n_nationkey ELSE 'R' || n_regionkey END AS value FROM customer JOIN nation ON c_nationkey = n_nationkey")
def inherited_attr(spark, d):
    e = _edges(spark, d)
    number = F.substring("node", 2, 20).cast("long")
    nodes = e.select("doc", F.col("child").alias("node"), "parent").unionByName(t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("doc"), F.concat(F.lit("R"), F.col("r_regionkey")).alias("node"), F.lit(None).cast("string").alias("parent")))
    own = F.when(F.col("node").startswith("R"), F.col("node")).when(F.col("node").startswith("N") & (number % 3 == 0), F.col("node")).when(F.col("node").startswith("C") & (number % 10 == 0), F.lit("own"))
    return TREE.inherited(nodes.withColumn("value", own), ["doc"]).filter(F.col("node").startswith("C"))


@query("""SELECT conv_id, turn, (SELECT max(b.turn) FROM l b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.l < a.l) AS parent,
(SELECT count(*) FROM l b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.turn < coalesce((SELECT min(c.turn) FROM l c WHERE c.conv_id = a.conv_id AND c.turn > a.turn AND c.l <= a.l), 1000000)) AS n_below
FROM l a""".replace("FROM l", "FROM (SELECT conv_id, turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS l FROM conversations)"))
def outline_tree(spark, d):
    level = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return TREE.outline(t(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", level, 3).select("conv_id", "turn", "parent", "n_below")


# -- text


@query("SELECT p_partkey, p_name AS text FROM part")
def font_decode(spark, d):
    """Names spelled in the codes of a font, read back by its map."""
    codes = F.transform(F.split("p_name", ""), lambda c: (F.ascii(c) * 7 + 13) % 256)
    shown = t(spark, d, "part").filter("p_name <> ''").select("p_partkey", F.lit("F1").alias("font"), codes.alias("codes"))
    font = spark.range(32, 127).select(F.lit("F1").alias("font"), ((F.col("id") * 7 + 13) % 256).cast("int").alias("code"), F.chr("id").alias("text"))
    return T.decode_codes(shown, font, ["p_partkey"], "font", "codes")


@query("SELECT p_partkey, p_partkey * 64 + i AS code, (60000 + p_partkey * 97 + i) % 65536 AS unit FROM part, LATERAL (SELECT unnest(range(0, p_size + 1)) AS i)")
def bfrange_expand(spark, d):
    p = t(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 64).alias("lo"), (F.col("p_partkey") * 64 + F.col("p_size")).alias("hi"), (F.lit(60000) + F.col("p_partkey") * 97).alias("dst"))
    return T.expand_ranges(p, ["p_partkey"])


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type IN ('view', 'signup') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS font FROM events")
def last_font_asof(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return T.in_force(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type").isin("view", "signup"), F.col("event_type")), "font").select("user_id", "event_id", "font")


@query("SELECT user_id, grp, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS closed FROM (SELECT *, (sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) - (event_type = 'purchase')::INT)::BIGINT AS grp FROM events) GROUP BY user_id, grp")
def operand_groups(spark, d):
    e = T.operand_groups(t(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], F.col("event_type") == "purchase")
    return e.groupBy("user_id", "grp").agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("closed"))


_LITERAL = r"'(' || replace(replace(replace(replace({0}, '\', '\\'), '(', '\('), ')', '\)'), chr(13), '\r') || ')'"


@query(f"SELECT doc_id, {_LITERAL.format('text')} AS literal FROM documents")
def string_escape(spark, d):
    return t(spark, d, "documents").select("doc_id", S.literal_string(F.col("text")).alias("literal"))


@query("SELECT doc_id, '<' || lower(hex(encode(text))) || '>' AS hex FROM documents")
def hex_string(spark, d):
    return t(spark, d, "documents").select("doc_id", S.hex_string(F.encode("text", "UTF-8")).alias("hex"))


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(s, '[^\\x00-\\x7f]') THEN '<feff' || array_to_string(list_transform(string_split(s, ''), lambda c: printf('%04x', unicode(c))), '') || '>' ELSE {_LITERAL.format('s')} END AS string
FROM (SELECT doc_id, text AS s FROM documents)""")
def text_string(spark, d):
    return t(spark, d, "documents").select("doc_id", S.text_string(F.col("text")).alias("string"))


@query("""SELECT p_partkey, '/' || array_to_string(list_transform(string_split(p_name || '#(' || p_type, ''), lambda c: CASE WHEN c IN ('#', '/', '%', '(', ')', '<', '>', '[', ']', '{', '}', ' ') THEN '#' || hex(c) ELSE c END), '') AS name FROM part""")
def name_escape(spark, d):
    return t(spark, d, "part").select("p_partkey", S.name(F.concat("p_name", F.lit("#("), "p_type")).alias("name"))


_UNESCAPED = "replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&#160;', ' '), '&amp;', '&')"


@query(f"SELECT page_id, len(w) AS n_words, array_to_string(w, ' ') AS words FROM (SELECT page_id, list_filter(regexp_split_to_array({_UNESCAPED}, '[ \\t\\n\\r\\x0b\\f]+'), lambda x: x <> '') AS w FROM pages)")
def word_atoms(spark, d):
    w = S.words(S.unescape_entities(S.strip_tags(F.col("html"))))
    return t(spark, d, "pages").select("page_id", w.alias("w")).select("page_id", F.size("w").cast("long").alias("n_words"), F.array_join("w", " ").alias("words"))


@query("""SELECT page_id, i AS pos, h[i] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages), LATERAL (SELECT unnest(range(1, len(h) + 1)) AS i)""")
def link_extract(spark, d):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return t(spark, d, "pages").select("page_id", F.posexplode(links).alias("pos", "href")).withColumn("pos", (F.col("pos") + 1).cast("long"))


@query("SELECT p_partkey, (c // 65536)::INT AS r, ((c // 256) % 256)::INT AS g, (c % 256)::INT AS b FROM (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS c FROM part)")
def hex_color(spark, d):
    color = S.hex_color(F.col("color"))
    return t(spark, d, "part").select("p_partkey", F.concat(F.lit("#"), F.lpad(F.hex((F.col("p_partkey") * 7919) % 16777216), 6, "0")).alias("color")).select("p_partkey", *(c.alias(k) for k, c in color.items()))


@query(f"SELECT p_partkey, list_sum(list_transform(string_split(p_name, ''), lambda c: ({HELVETICA})[ascii(c) - 31]))::BIGINT AS width FROM part")
def string_width(spark, d):
    return t(spark, d, "part").select("p_partkey", S.string_width(F.col("p_name")).alias("width"))


# -- layout


@query("SELECT l_orderkey, l_linenumber, max(l_quantity + 4) AS row_height FROM lineitem GROUP BY l_orderkey, l_linenumber")
def row_heights(spark, d):
    return L.row_heights(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_quantity") + 4)


@query("""SELECT l_orderkey, k, (sum(w) OVER (PARTITION BY l_orderkey ORDER BY k) - w)::BIGINT AS "left" FROM (SELECT l_orderkey, l_linenumber * 100000 + l_partkey AS k, sum(l_quantity)::BIGINT AS w FROM lineitem GROUP BY ALL)""")
def col_lefts(spark, d):
    c = t(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("k")).agg(F.sum("l_quantity").cast("long").alias("w"))
    return L.column_lefts(c, ["l_orderkey"], "k", "w").drop("w")


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS tbl, (l_linenumber - 1)::INT AS r, (l_suppkey % 4)::INT AS c FROM lineitem),
n AS (SELECT tbl, max(r) + 1 AS nr, max(c) + 1 AS nc FROM c GROUP BY tbl),
o AS (SELECT tbl, seq, 'v' || seq AS value, least(c0, CASE WHEN c1 < 0 THEN nc + c1 ELSE c1 END) AS a0, greatest(c0, CASE WHEN c1 < 0 THEN nc + c1 ELSE c1 END) AS a1, least(r0, CASE WHEN r1 < 0 THEN nr + r1 ELSE r1 END) AS b0, greatest(r0, CASE WHEN r1 < 0 THEN nr + r1 ELSE r1 END) AS b1
FROM n, (VALUES (1, 0, 0, -1, -1), (2, 1, 0, 1, -1), (3, 0, 1, -1, 1), (4, 2, 2, 0, 0)) v(seq, c0, r0, c1, r1))
SELECT tbl, r, c, max_by(value, seq) AS value FROM c JOIN o USING (tbl) WHERE c BETWEEN a0 AND a1 AND r BETWEEN b0 AND b1 GROUP BY tbl, r, c""")
def cell_style(spark, d):
    cells = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("tbl"), (F.col("l_linenumber") - 1).cast("int").alias("r"), (F.col("l_suppkey") % 4).cast("int").alias("c")).distinct()
    each = F.explode(F.array(*(F.struct(*(F.lit(x).alias(k) for k, x in zip(("seq", "c0", "r0", "c1", "r1"), o, strict=True))) for o in ((1, 0, 0, -1, -1), (2, 1, 0, 1, -1), (3, 0, 1, -1, 1), (4, 2, 2, 0, 0)))))
    ops = cells.select("tbl").distinct().select("tbl", each.alias("o")).select("tbl", "o.*").withColumn("value", F.concat(F.lit("v"), "seq"))
    return L.cell_style(cells, ops, ["tbl"])


@query("SELECT doc_id, (i - 1) // 40 + 1 AS page, count(*) AS n FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) GROUP BY doc_id, page")
def paginate_lines(spark, d):
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return L.paginate(lines, ["doc_id"], "i", 40).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


@query("SELECT vec_id, round(2 * x - y + 10, 6) AS x, round(0.5 * x + 3 * y - 20, 6) AS y FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)")
def affine_apply(spark, d):
    v = t(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    x, y = S.affine((2.0, 0.5, -1.0, 3.0, 10.0, -20.0), F.col("x"), F.col("y"))
    return v.select("vec_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("""SELECT vec_id, round(least(x - y, x2 - y, x - y2, x2 - y2), 6) AS x0, round(least(x + y, x2 + y, x + y2, x2 + y2), 6) AS y0, round(greatest(x - y, x2 - y, x - y2, x2 - y2), 6) AS x1, round(greatest(x + y, x2 + y, x + y2, x2 + y2), 6) AS y1
FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS x2, embedding[4]::DOUBLE AS y2 FROM embeddings)""")
def bbox_links(spark, d):
    v = t(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(("x", "y", "x2", "y2"))))
    corners = [S.affine((1.0, 1.0, -1.0, 1.0, 0.0, 0.0), F.col(a), F.col(b)) for a in ("x", "x2") for b in ("y", "y2")]
    return v.select("vec_id", *(F.round(c, 6).alias(k) for k, c in S.bounding_box(corners).items()))


@query("SELECT p_brand, list_reduce(list_prepend(2166136261::BIGINT, list_sort(list(DISTINCT p_size::BIGINT))), lambda h, x: (xor(h, x) * 16777619) % 4294967296) AS tag FROM part GROUP BY p_brand")
def subset_tag(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(S.fnv_fold(F.array_sort(F.collect_set(F.col("p_size").cast("long")))).alias("tag"))


@query("SELECT conv_id, run, count(*) AS n, min(turn) AS x0, max(turn) AS x1 FROM (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT conv_id, turn, role, (lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role)::INT AS f FROM conversations)) GROUP BY conv_id, run, role".replace("count(*) AS n, ", "").replace("conv_id, run, min", "conv_id, role, min"))
def link_runs(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", "role", F.col("turn").alias("x0"), F.col("turn").alias("x1"))
    return L.link_runs(c, ["conv_id"], "turn", "role", "x0", "x1")


@query()
def wrap_lines(spark, d):
    """Lines of each document at a width of 451 points."""
    return L.wrap_text(t(spark, d, "documents"), "doc_id", "text", 451.0).groupBy("doc_id").agg(F.count("*").alias("lines"))
