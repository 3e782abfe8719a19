"""Layout as relations; what is sequential inside a document runs per document, in Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spread import spread


def row_heights(cells: DataFrame, keys: list[str], height: Column) -> DataFrame:
    return cells.groupBy(*keys).agg(F.max(height).alias("row_height"))


def column_lefts(columns: DataFrame, keys: list[str], order: str, width: str) -> DataFrame:
    return columns.withColumn("left", F.sum(width).over(Window.partitionBy(*keys).orderBy(order)) - F.col(width))


def share_widths(columns: DataFrame, keys: list[str], width: str, total: Column) -> DataFrame:
    """Columns of no width share what the fixed ones leave."""
    own = Window.partitionBy(*keys)
    fixed, free = F.sum(F.when(F.col(width) > 0, F.col(width)).otherwise(0)).over(own), F.sum(F.when(F.col(width) > 0, 0).otherwise(1)).over(own)
    return columns.withColumn("width", F.when(F.col(width) > 0, F.col(width)).otherwise(F.greatest(F.lit(0), total - fixed) / F.greatest(free, F.lit(1))))


def cell_style(cells: DataFrame, ops: DataFrame, keys: list[str]) -> DataFrame:
    """keys, r, c, value: the last operation (by seq) whose rectangle covers the cell. ``ops``: keys, seq, c0, r0, c1, r1, value.

    An equi-join on the table, then the rectangle test; the aggregate keeps one row a cell.
    """
    n = cells.groupBy(*keys).agg((F.max("r") + 1).alias("__rows"), (F.max("c") + 1).alias("__cols"))
    fix = lambda v, size: F.when(F.col(v) < 0, F.col(size) + F.col(v)).otherwise(F.col(v))
    placed = ops.join(n, keys).select(*keys, "seq", "value", *(f(fix(a, s), fix(b, s)).alias(k) for k, f, a, b, s in (("__c0", F.least, "c0", "c1", "__cols"), ("__c1", F.greatest, "c0", "c1", "__cols"), ("__r0", F.least, "r0", "r1", "__rows"), ("__r1", F.greatest, "r0", "r1", "__rows"))))
    hit = cells.select(*keys, "r", "c").join(placed, keys).filter("c between __c0 and __c1 and r between __r0 and __r1")
    return hit.groupBy(*keys, "r", "c").agg(F.max_by("value", "seq").alias("value"))


def paginate(lines: DataFrame, keys: list[str], order: str, per_page: int) -> DataFrame:
    """Adds ``page`` and ``slot`` of lines of one leading."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return lines.withColumn("page", F.floor(n / per_page) + 1).withColumn("slot", n % per_page)


def link_runs(pieces: DataFrame, keys: list[str], order: str, href: str, x0: str, x1: str) -> DataFrame:
    """keys, href, x0, x1 of each run of neighbouring pieces with the same target."""
    own = Window.partitionBy(*keys).orderBy(order)
    new = (~F.lag(href).over(own).eqNullSafe(F.col(href))).cast("int")
    run = pieces.withColumn("__n", new).withColumn("__r", F.sum("__n").over(own))
    return run.filter(F.col(href).isNotNull() & (F.col(href) != "")).groupBy(*keys, "__r", href).agg(F.min(x0).alias(x0), F.max(x1).alias(x1)).drop("__r")


def justify_slack(pieces: DataFrame, keys: list[str], order: str, glue: Column, width: str, avail: Column) -> DataFrame:
    """keys, slack of each line: what is left of it, shared by its real gaps."""
    numbered = pieces.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    line = numbered.groupBy(*keys).agg(F.sum(width).alias("__w"), F.sum(F.when((F.col("__i") > 1) & ~glue, 1).otherwise(0)).alias("__g"), F.first(avail).alias("__a"))
    return line.select(*keys, F.when((F.col("__g") > 0) & (F.col("__a") > F.col("__w")), (F.col("__a") - F.col("__w")) / F.col("__g")).otherwise(0.0).alias("slack"))


def wrap_text(rows: DataFrame, key: str, text: str, width: float, font: str = "Helvetica", size: float = 10) -> DataFrame:
    """key, line (from 0), text: lines filled greedily to ``width``. Filling is sequential, so it runs per text."""

    def run(batches):
        from ..kernel.layout import Style, atoms, wrap

        for batch in batches:
            k, n, out = [], [], []
            for at, t in enumerate(batch.column(1).to_pylist()):
                for i, line in enumerate(wrap(atoms(t or "", Style(font, size), True), width)):
                    k.append(at)
                    n.append(i)
                    out.append("".join((" " if j and not a.glue else "") + a.word for j, a in enumerate(line.atoms)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k, pa.int64())), pa.array(n, pa.int32()), pa.array(out, pa.string())], [key, "line", "text"])

    return spread(rows.select(key, F.col(text).alias("text"))).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, line int, text string")


def build_documents(rows: DataFrame, key: str, text: str, font: str = "Helvetica", size: float = 10, plain: bool = True) -> DataFrame:
    """path, content: a laid-out document for each row, a paragraph for each line of its text."""

    def run(batches):
        from ..kernel.layout import Doc, Paragraph, Style

        style = Style(font, size)
        for batch in batches:
            for part in range(0, batch.num_rows, 64):
                b = batch.slice(part, 64)
                made = [Doc().build([Paragraph(p, style, plain) for p in (t or "").split("\n")]) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    return spread(rows.select(F.col(key).cast("string").alias("path"), F.col(text).alias("text"))).mapInArrow(run, "path string, content binary")
