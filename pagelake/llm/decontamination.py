"""Benchmark decontamination: size-partitioned MinHash containment search, by DataFrame and SQL functions only.

Items and documents are sets of five-word shingles of their lower-cased words. A document holds an item
if at least ``threshold`` of the item's shingles are in it, however long the document is. Items are
partitioned by size (the number of their shingles); the size decides how many of its smallest shingle
hashes an item's MinHash sketch keeps: with q shingles, q - ceil(threshold * q) + 1. A document that holds the
item lacks fewer than that, so it has at least one of them: the search loses no pair. Documents are
not sketched, since in a long one the few shingles of an item would seldom be minima. Each document is searched for the items of
the partitions that it is long enough to hold. Pairs that share a sketch hash are candidates and are verified on the shingles themselves.

Defined cases: null and empty texts, and texts under five words, have no shingles: such items are held
nowhere and such documents hold nothing. Of rows that repeat an id, the row that holds most counts. Very long texts are searched whole, at a
cost by their length; empty tables give empty results; columns other than id and text aren't read, whatever their names. Rows without an id are in no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored

WORDS, THRESHOLD = 5, 0.8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(w: Column, make) -> Column:
    at = F.when(F.size(w) >= WORDS, F.sequence(F.lit(1), F.size(w) - (WORDS - 1)))
    return F.transform(at, lambda i: make([F.element_at(w, (i + k).cast("int")) for k in range(WORDS)]))


def hashes(w: Column) -> Column:
    return _runs(w, lambda x: F.xxhash64(*x))


def shingle_set(w: Column) -> Column:
    return F.array_distinct(_runs(w, lambda x: F.concat_ws(" ", *x)))


def sketches(items: DataFrame, threshold: float = THRESHOLD, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, size_class, shingles, sketch of the items that have shingles."""
    own = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).select("item_id", shingle_set(F.col("w")).alias("shingles"), F.array_sort(F.array_distinct(hashes(F.col("w")))).alias("h"))
    q = F.size("shingles")
    keep = q - F.ceil(q * F.lit(threshold).cast("decimal(9,6)")).cast("int") + 1
    return own.filter("size(shingles) > 0").select("item_id", F.floor(F.log2(q)).cast("int").alias("size_class"), "shingles", F.slice("h", F.lit(1), keep).alias("sketch"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_shingles, shared, containment of every pair at or over ``threshold``."""
    own = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    held = stored(sketches(items, threshold, item_id_col, item_text_col), "items")
    least = held.agg(F.min(F.ceil(F.size("shingles") * F.lit(threshold).cast("decimal(9,6)")))).first()[0] or 0
    search = small(stored(held.select("item_id", "size_class", F.explode("sketch").alias("h")), "sketches"))
    # A document meets the partitions of items that it is long enough to hold: of class c, 2^c shingles or more, by threshold.
    top = F.floor(F.log2((F.size("w") - (WORDS - 1)) / F.lit(float(threshold))) + 1e-9).cast("int")
    seen = own.filter(F.size("w") >= int(least) + WORDS - 1).select("doc_id", top.alias("top"), F.explode(hashes(F.col("w"))).alias("h"))
    candidates = stored(seen.join(search, "h").filter("size_class <= top").select("doc_id", "item_id").distinct(), "candidates")
    pairs = own.join(small(candidates), "doc_id").join(small(held.select("item_id", "shingles")), "item_id")
    q, shared = F.size("shingles"), F.size(F.array_intersect("shingles", _runs(F.col("w"), lambda x: F.concat_ws(" ", *x))))
    found = pairs.select("doc_id", "item_id", q.cast("long").alias("n_shingles"), shared.cast("long").alias("shared"))
    found = found.groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("shared").alias("shared"))
    return found.withColumn("containment", F.col("shared") / F.col("n_shingles")).filter(F.col("shared") >= F.ceil(F.col("n_shingles") * F.lit(threshold).cast("decimal(9,6)")))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item. Rows without an id stay."""
    hit = stored(contained(docs, items, threshold, id_col).select(F.col("doc_id").alias(id_col)).distinct(), "held")
    return docs.join(small(hit), id_col, "left_anti")


#: The same search in DuckDB, without sketches.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM d),
it AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM i),
q AS (SELECT item_id, count(*) AS n_shingles FROM it GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN it USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, shared, shared::DOUBLE / n_shingles AS containment
FROM c JOIN q USING (item_id) WHERE shared * 5 >= n_shingles * 4
"""
