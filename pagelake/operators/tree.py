"""Trees: ordered leaves, inherited values, walks along paths, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEPTH = 32


def descend(edges: DataFrame, roots: DataFrame, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """keys, node, place (array of positions from the root), level of every node below ``roots`` (keys, node).

    ``edges``: keys, parent, child, pos. A level a join; it ends with the levels, or with an error row's flag ``too_deep`` at ``depth``
    (so a cycle ends too).
    """
    at = roots.select(*keys, "node", F.array().cast("array<long>").alias("place"), F.lit(0).alias("level"))
    out, step = at, edges.select(*keys, F.col("parent").alias("node"), "child", F.col("pos").cast("long").alias("pos"))
    for level in range(1, depth + 1):
        at = at.join(step, [*keys, "node"]).select(*keys, F.col("child").alias("node"), F.concat("place", F.array("pos")).alias("place"), F.lit(level).alias("level"))
        if at.isEmpty():
            return out.withColumn("too_deep", F.lit(False))
        out = out.unionByName(at)
    return out.withColumn("too_deep", F.col("level") == depth)


def ordered_leaves(edges: DataFrame, roots: DataFrame, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """keys, node, page (from 1): nodes without children, in the order of their places. A tree that is deeper than ``depth``, or has a cycle, is an error."""
    nodes = descend(edges, roots, keys, depth)
    if not nodes.filter("too_deep").isEmpty():
        raise ValueError(f"a tree is deeper than {depth} levels, or has a cycle")
    leaves = nodes.join(edges.select(*keys, F.col("parent").alias("node")).distinct(), [*keys, "node"], "left_anti")
    return leaves.withColumn("page", F.row_number().over(Window.partitionBy(*keys).orderBy("place"))).select(*keys, "node", "page")


def inherited(nodes: DataFrame, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """keys, node, value: a node's own value, or its nearest ancestor's. ``nodes``: keys, node, parent, value.

    A level a join, over the nodes that have none yet. A tree that is deeper than ``depth``, or has a cycle, is an error.
    """
    up = nodes.select(*keys, F.col("node").alias("parent"), F.col("parent").alias("__next"), F.col("value").alias("__value"))
    have = nodes.filter("value is not null").select(*keys, "node", "value")
    seek = nodes.filter("value is null").select(*keys, "node", "parent")
    for _ in range(depth):
        if seek.isEmpty():
            break
        found = seek.join(up, [*keys, "parent"], "left")
        have = have.unionByName(found.filter("__value is not null or __next is null").select(*keys, "node", F.col("__value").alias("value")))
        seek = found.filter("__value is null and __next is not null").select(*keys, "node", F.col("__next").alias("parent"))
    if not seek.isEmpty():
        raise ValueError(f"a tree is deeper than {depth} levels, or has a cycle")
    return have


def walk(entries: DataFrame, trailer: DataFrame, path: str) -> DataFrame:
    """path and the value at a slash path such as /Root/Pages/Kids/0, of each document: a join for each segment, references followed between them."""
    value = [c for c in entries.columns if c.startswith("value_")]
    segments = [s for s in path.split("/") if s]
    if not segments or segments[0] not in ("Root", "Info"):
        raise ValueError("a path begins with /Root or /Info")
    start = segments[0].lower()
    at = trailer.select("path", F.col(f"{start}_num").alias("num"), F.lit("").alias("at")).filter("num is not null")
    held = None
    for k, s in enumerate(segments[1:]):
        e = entries.filter(F.col("pos") == int(s)) if s.isdigit() else entries.filter(F.col("key") == F.lit(s).cast("binary"))
        first = Window.partitionBy("path", "num", "parent").orderBy("pos")
        e = e.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select("path", "num", F.col("parent").alias("at"), "pos", *value)
        held = at.join(e, ["path", "num", "at"])
        if k < len(segments) - 2:
            below = F.when(F.col("at") == "", F.col("pos").cast("string")).otherwise(F.concat_ws("/", "at", F.col("pos").cast("string")))
            ref = F.col("value_kind") == "ref"
            at = held.select("path", F.when(ref, F.col("value_ref_num")).otherwise(F.col("num")).alias("num"), F.when(ref, F.lit("")).otherwise(below).alias("at"))
    return held.select("path", *value) if held is not None else at.select("path", F.lit("ref").alias("value_kind"), F.col("num").alias("value_ref_num"))


def outline(marks: DataFrame, keys: list[str], order: str, level: Column, levels: int) -> DataFrame:
    """Adds to each mark: parent (nearest earlier one at a shallower level), prev and next (siblings), first, last, n_below. ``levels``: how many there are."""
    rows = marks.withColumn("__l", level)
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    rows = rows.withColumn("__r", rank)
    up, until = F.lit(None), F.lit(None)
    for k in range(levels):
        up = F.when(F.col("__l") == k, F.max(F.when(F.col("__l") < k, F.col(order))).over(before)).otherwise(up)
        until = F.when(F.col("__l") == k, F.min(F.when(F.col("__l") <= k, F.col("__r"))).over(after)).otherwise(until)
    rows = rows.withColumn("parent", up).withColumn("__u", until).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    beside = Window.partitionBy(*keys, "parent").orderBy(order)
    rows = rows.withColumn("prev", F.lag(order).over(beside)).withColumn("next", F.lead(order).over(beside)).withColumn("n_below", F.coalesce("__u", F.col("__n") + 1) - F.col("__r") - 1)
    ends = rows.filter("parent is not null").groupBy(*keys, F.col("parent").alias(order)).agg(F.min(order).alias("first"), F.max(order).alias("last"))
    return rows.join(ends, [*keys, order], "left").drop("__l", "__u", "__n", "__r")
