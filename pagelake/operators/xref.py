"""Cross-reference relations: newest wins, shadowed records, ranges of numbers, record formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest(log: DataFrame, keys: list[str], order: str, least: bool = False) -> DataFrame:
    """The row of each key with the greatest (or least) ``order``. An aggregate, so most rows of a much-written key go before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    pick = (F.min_by if least else F.max_by)(F.struct(*rest), F.col(order)).alias("row")
    return log.groupBy(*keys).agg(pick).select(*keys, "row.*").select(*log.columns)


def shadowed(log: DataFrame, keys: list[str], order: str, least: bool = False) -> DataFrame:
    """The rows that ``newest`` leaves out."""
    top = log.groupBy(*keys).agg((F.min if least else F.max)(order).alias("__top"))
    return log.join(top, keys).filter(F.col(order) != F.col("__top")).select(*log.columns)


def numbers(sections: DataFrame, first: str = "first_obj", count: str = "cnt") -> DataFrame:
    """A row ``num`` for each number of each section (the ranges are finite)."""
    return sections.filter(F.col(count) > 0).withColumn("num", F.explode(F.sequence(F.col(first), F.col(first) + F.col(count) - 1)))


def first_match(points: DataFrame, ranges: DataFrame, point: str, first: str, count: str, order: str, width: int = 1024, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each point with the range of least ``order`` that holds it: a range join by buckets of ``width`` numbers, so long ranges aren't spelled out. ``keys``: columns of both, such as the document, that must agree."""
    cut = ranges.filter(F.col(count) > 0).withColumn("__b", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor((F.col(first) + F.col(count) - 1) / width))))
    hit = points.withColumn("__b", F.floor(F.col(point) / width)).join(cut, [*keys, "__b"]).filter((F.col(point) >= F.col(first)) & (F.col(point) < F.col(first) + F.col(count)))
    return hit.groupBy(*points.columns).agg(F.min(order).alias(order))


def revision_bounds(revisions: DataFrame, keys: list[str], order: str, first: str, total: Column) -> DataFrame:
    """Adds ``end_section``: the next revision's first section, the total for the last."""
    return revisions.withColumn("end_section", F.coalesce(F.lead(first).over(Window.partitionBy(*keys).orderBy(order)), total))


def index_bases(index: DataFrame, keys: list[str], order: str, count: str) -> DataFrame:
    """Adds ``row_first``: rows before each pair of an index."""
    return index.withColumn("row_first", F.sum(count).over(Window.partitionBy(*keys).orderBy(order)) - F.col(count))


def section_runs(nums: DataFrame, keys: list[str], num: str = "num") -> DataFrame:
    """Runs of consecutive numbers: keys, first_obj, cnt."""
    distinct = nums.select(*keys, num).distinct()
    island = F.col(num) - F.row_number().over(Window.partitionBy(*keys).orderBy(num))
    return distinct.withColumn("__i", island).groupBy(*keys, "__i").agg(F.min(num).alias("first_obj"), F.count("*").alias("cnt")).drop("__i")


def parse_record(record: Column) -> dict[str, Column]:
    """Fields of a classic 20-byte record; what isn't a number is null."""
    return {"off": F.try_to_number(F.substring(record, 1, 10), F.lit("9999999999")).cast("long"), "gen": F.try_to_number(F.substring(record, 12, 5), F.lit("99999")).cast("int"), "kind": F.when(F.substring(record, 18, 1) == "f", "free").otherwise("normal")}


def stream_fields(row: Column, w: tuple[int, int, int]) -> dict[str, Column]:
    """Fields of a cross-reference stream's row of bytes, by their widths: kind, then offset or stream, generation or index."""
    a, b, c = w
    number = lambda at, n: F.conv(F.hex(F.substring(row, at, n)), 16, 10).cast("long") if n else F.lit(None).cast("long")
    code = number(1, a) if a else F.lit(1)
    x, y = number(1 + a, b), F.coalesce(number(1 + a + b, c), F.lit(0))
    kind = F.when(code == 1, "normal").when(code == 2, "compressed").otherwise("free")
    return {"kind": kind, "x": F.when(code.isin(1, 2), x), "y": F.when(code.isin(1, 2), y)}


def document_info(revisions: DataFrame, sections: DataFrame) -> DataFrame:
    """path, revisions, sections, forms, size (greatest number and one), root_num, info_num: from the newest trailer that has each."""
    newest_of = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("rev")))
    r = revisions.filter("error is null").groupBy("path").agg(
        F.count("*").alias("revisions"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rev", F.when(F.col("classic"), "table").otherwise("stream").alias("form")))), lambda x: x["form"]), ",").alias("forms"),
        F.max("size").alias("trailer_size"), newest_of("root_num").alias("root_num"), newest_of("info_num").alias("info_num"),
    )
    s = sections.groupBy("path").agg(F.count("*").alias("sections"), F.max(F.col("first_obj") + F.col("cnt")).alias("top"))
    return r.join(s, "path", "left").select("path", "revisions", F.coalesce("sections", F.lit(0)).alias("sections"), "forms", F.greatest("trailer_size", "top").alias("size"), "root_num", "info_num")


def append_revision(revisions: DataFrame, delta: DataFrame) -> DataFrame:
    """A chain with a new newest revision: an older one's number and first section move up by what the new one brings."""
    shift = delta.groupBy("path").agg(F.count("*").cast("int").alias("__n"), F.sum("n_sections").cast("int").alias("__s"))
    older = revisions.join(shift, "path", "left").withColumn("rev", F.col("rev") + F.coalesce("__n", F.lit(0))).withColumn("first_section", F.col("first_section") + F.coalesce("__s", F.lit(0))).drop("__n", "__s")
    return older.unionByName(delta.drop("n_sections"), allowMissingColumns=True)


def dangling(members: DataFrame, owners: DataFrame, on: list[str]) -> DataFrame:
    """Members that no owner claims (an anti-join)."""
    return members.join(owners.select(*on), on, "left_anti")


def attributed(members: DataFrame, owners: DataFrame, on: list[str]) -> DataFrame:
    """Members that an owner still claims (a semi-join)."""
    return members.join(owners.select(*on), on, "left_semi")
