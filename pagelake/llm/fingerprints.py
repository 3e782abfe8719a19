"""Canonical exact digests of documents, by DataFrame and SQL functions only.

A text is brought to a canonical form: Unicode compatibility composition (NFKC), lower case, runs of white
space as one space, none at the ends. Two chained 64-bit xxhashes of it make a 128-bit bucket; inside
buckets of several documents the canonical bytes are compared with those of the bucket's first document,
and a document that differs from it gets a digest of its own (the bucket and a SHA-256). So documents
have the same digest exactly if their canonical forms are the same.

Defined cases: a null text is empty; empty texts and texts of white space share a digest. Rows that repeat an id are
documents of their own, in the order of their texts; null ids come first; ids are of any type that has an order. Very long texts are digested
whole. An empty table gives an empty result; columns other than id and text aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_text, small, stored

#: Members of a bucket that are compared in one task.
BLOCK = 500


def canonical(text: Column) -> Column:
    composed = F.when(F.octet_length(text) != F.length(text), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(composed), r"[\s\x1c-\x1f\x{85}\p{Z}]+", " "))


def bucket(form: Column) -> tuple[Column, Column]:
    return F.xxhash64(form), F.xxhash64(F.lit("wide"), form)


def shown(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def collisions(forms: DataFrame) -> DataFrame:
    """h1, h2, sha: the canonical forms that share a bucket with another form and aren't the bucket's first. Practically none.

    ``forms``: doc_id, form, h1, h2. Counts of buckets come first, over hashes alone; only texts of buckets of several
    documents are compared, those of a large bucket in blocks.
    """
    several = stored(forms.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = forms.join(small(several), ["h1", "h2"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / BLOCK)))
    own = Window.partitionBy("h1", "h2", "block")
    members = members.withColumn("first", F.first("form").over(own.orderBy("form").rowsBetween(Window.unboundedPreceding, 0)))
    found = members.filter(F.col("form") != F.col("first")).select("h1", "h2", "form")
    heads = members.filter("n > %d" % BLOCK).groupBy("h1", "h2", "block").agg(F.min("first").alias("form"))
    head = heads.groupBy("h1", "h2").agg(F.min("form").alias("first"))
    across = heads.join(head, ["h1", "h2"]).filter(F.col("form") != F.col("first")).select("h1", "h2", "form")
    return found.unionByName(across).select("h1", "h2", F.sha2("form", 256).alias("sha")).distinct()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, digest (and text) of each row."""
    forms = id_text(docs, id_col, text_col).withColumn("form", canonical(F.col("text")))
    h1, h2 = bucket(F.col("form"))
    forms = forms.select("doc_id", "text", "form", h1.alias("h1"), h2.alias("h2"))
    apart = stored(collisions(forms.drop("text")), "collisions")
    if apart.isEmpty():
        out = forms.withColumn("digest", shown(F.col("h1"), F.col("h2")))
    else:
        out = forms.withColumn("sha", F.sha2("form", 256)).join(small(apart.withColumn("apart", F.lit(True))), ["h1", "h2", "sha"], "left")
        out = out.withColumn("digest", F.when("apart", F.concat(shown(F.col("h1"), F.col("h2")), F.lit("-"), F.col("sha"))).otherwise(shown(F.col("h1"), F.col("h2"))))
    return out.select("doc_id", *(["text"] if keep_text else []), "digest")


def _ranges(rows: DataFrame, each: int) -> DataFrame:
    """doc_id, at: ids in ascending order cut into ranges of about ``each`` rows, whatever the ids are and however they lie. Only ids and counts move."""
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    placed = stored(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    parts = placed.groupBy("part").agg(F.sum("n").alias("rows"))  # a row for each partition
    base = F.broadcast(parts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("base")))
    before = F.sum("n").over(Window.partitionBy("part").orderBy("doc_id")) - F.col("n")
    return stored(placed.join(base, "part").select("doc_id", F.floor((F.col("base") + before) / each).cast("long").alias("at")), "ranges")


def with_next(rows: DataFrame, *columns: str, each: int = 4096) -> DataFrame:
    """Adds ``next_<column>`` of the following row by ascending doc_id (nulls first; then text); after the last comes the first.

    Ids are cut into ranges of about ``each`` rows. Each range also gets the first row of the range after it, so one
    shuffle and a window inside each range suffice, and no task sees the whole table. Ranges are of equal width where whole numbers
    lie so evenly that none holds many more rows than another; else they are of equal counts, at the cost of a join.
    """
    kind = rows.schema["doc_id"].dataType.typeName()
    even, at = False, None
    if kind in ("byte", "short", "integer", "long"):
        low, high, count, known = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*"), F.count("doc_id")).first()
        if not count:
            return rows.select("*", *(F.lit(None).cast(rows.schema[c].dataType).alias(f"next_{c}") for c in columns))
        if known == count:
            wide = max(1, (high - low + 1) * each // count)
            at = F.floor((F.col("doc_id") - F.lit(low)) / F.lit(wide)).cast("long")
            even = rows.groupBy(at.alias("at")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= 8 * each
    if even:
        placed = rows.withColumn("at", at)
        first = stored(rows.groupBy(at.alias("at")).agg(F.min("doc_id").alias("doc_id")), "firsts")  # a row for each range
    else:
        ranges = _ranges(rows, each)
        other = ranges.withColumnRenamed("doc_id", "ranged")
        placed = rows.join(other, rows["doc_id"].eqNullSafe(other["ranged"])).drop("ranged")
        first = stored(ranges.groupBy("at").agg(F.min_by("doc_id", F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("doc_id")), "firsts")
    # The range before each range's first row: ranges' numbers have gaps, and the first follows the last.
    last = first.agg(F.max("at")).first()[0]
    if last is None:
        return rows.select("*", *(F.lit(None).cast(rows.schema[c].dataType).alias(f"next_{c}") for c in columns))
    order = Window.orderBy("at")
    before = first.select(F.col("doc_id").alias("__first"), F.coalesce(F.lag("at").over(order), F.lit(last)).alias("__before"))
    guests = rows.join(small(stored(before, "guests")), rows["doc_id"].eqNullSafe(F.col("__first"))).drop("__first").withColumnRenamed("__before", "at").withColumn("guest", F.lit(1))
    dealt = placed.withColumn("guest", F.lit(0)).unionByName(guests)
    own = Window.partitionBy("at").orderBy("guest", "doc_id", "text")
    return dealt.select("*", *(F.lead(c).over(own).alias(f"next_{c}") for c in columns)).filter("guest = 0").drop("at", "guest")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's digest beside that of its edited text (its last quarter gives way to the next document's beginning) and the next document's.

    The digest is exact, so a likeness is 1 where canonical forms are the same (bytes compared too) and 0 elsewhere.
    """
    rows = with_next(digests(docs, id_col, text_col, keep_text=True), "text", "digest")
    n = F.length("text")
    cut = rows.select("*", n.alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 4).cast("int")), F.substring(F.col("next_text"), F.lit(1), F.floor(n / 4).cast("int"))).alias("edited"))
    form, edited = canonical(F.col("text")), canonical(F.col("edited"))
    cut = cut.select("*", form.alias("form"), edited.alias("edited_form"))
    same = F.col("form") == F.col("edited_form")
    return cut.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("digest").alias("fingerprint"),
        F.when(same, F.col("digest")).otherwise(shown(*bucket(F.col("edited_form")))).alias("edited_fingerprint"),
        F.when(same, 1.0).otherwise(0.0).alias("near_edited"), F.when(F.col("digest") == F.col("next_digest"), 1.0).otherwise(0.0).alias("near_next"),
    )
