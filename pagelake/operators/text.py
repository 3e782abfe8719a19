"""Relations of text extraction: code maps, fonts in force, operands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def decode_codes(shown: DataFrame, font_codes: DataFrame, keys: list[str], font: str, codes: str, one_byte: bool = True) -> DataFrame:
    """keys, text: each code by its font's map; an unmapped code of one byte stands for itself, a wider one for nothing."""
    each = shown.select(*keys, font, F.posexplode(codes).alias("__pos", "code"))
    hit = each.join(font_codes.select(font, "code", "text"), [font, "code"], "left")
    text = F.coalesce("text", F.chr(F.col("code")) if one_byte else F.lit(""))
    return hit.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__pos", text.alias("t")))), lambda x: x["t"]), "").alias("text"))


def expand_ranges(ranges: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", dst: str = "dst") -> DataFrame:
    """A row for each code of each range: its destination's last 16-bit unit counts up; spans over 65535 give none."""
    span = ranges.filter((F.col(hi) >= F.col(lo)) & (F.col(hi) - F.col(lo) <= 0xFFFF))
    return span.withColumn("code", F.explode(F.sequence(F.col(lo), F.col(hi)))).withColumn("unit", (F.col(dst) + F.col("code") - F.col(lo)) % 65536).select(*keys, "code", "unit")


def expand_differences(items: DataFrame, keys: list[str], order: str, number: str, name: str) -> DataFrame:
    """keys, code, name: a number sets the code, each name takes one and moves on."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    base = items.withColumn("__b", F.last(number, ignorenulls=True).over(upto)).withColumn("__g", F.count(number).over(upto))
    code = F.coalesce("__b", F.lit(0)) + F.row_number().over(Window.partitionBy(*keys, "__g").orderBy(order)) - F.when(F.col("__g") > 0, 2).otherwise(1)
    return base.withColumn("code", code).filter(F.col(name).isNotNull()).select(*keys, "code", name)


def in_force(ops: DataFrame, keys: list[str], order: list[str], setting: Column, name: str) -> DataFrame:
    """Adds the last setting at or before each operator (an as-of join by order)."""
    return ops.withColumn(name, F.last(setting, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def operand_groups(tokens: DataFrame, keys: list[str], order: list[str], is_operator: Column, name: str = "grp") -> DataFrame:
    """Adds the number of the operator that each token belongs to: operands go with the operator after them."""
    flag = is_operator.cast("int")
    return tokens.withColumn(name, F.sum(flag).over(Window.partitionBy(*keys).orderBy(*order)) - flag)


def concat_streams(parts: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """keys, content: parts in order, each with a line end after it."""
    return parts.groupBy(*keys).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n"), F.lit("\n")).alias("content"))
