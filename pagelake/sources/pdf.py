"""Documents from storage or from a DataFrame of bytes, as tables.

A table is one pass of ``mapInArrow`` over (path, content) rows: each task opens its documents one by one, so a document is the
unit of parallelism and memory. Columns that aren't selected are cut by Catalyst before the pass only where the table
has them apart (a stream's bytes are in a table of their own); number filters can be given to the scan.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..kernel.lexer import scan_all as lex
from ..kernel.objects import Limits
from ..kernel.rows import rows
from ..tables import SCHEMAS


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path, content of the files under ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def scan(docs: DataFrame, table: str, limits: Limits = Limits(), nums: list[int] | None = None, batch_rows: int = 2000, **options) -> DataFrame:  # noqa: B008
    """One of the tables of ``pagelake.tables`` over (path, content) rows. ``nums``: only rows of these object numbers are sent on."""
    schema = StructType.fromDDL(SCHEMAS[table])
    arrow = to_arrow_schema(schema)
    wanted = set(nums) if nums is not None else None
    make = rows(table, limits, **options)

    def run(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                if content.is_valid:
                    for r in make(path.as_py(), content.as_py()):
                        if wanted is None or r.get("num") in wanted:
                            out.append(r)
                        if len(out) >= batch_rows:
                            yield pa.RecordBatch.from_pylist(out, schema=arrow)
                            out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    def run_tokens(batches):  # many short rows: columns are filled, not rows
        off, left = options.get("off", 0), options.get("limit")
        for batch in batches:
            path, at, kinds, literals, order = [], [], [], [], []

            def made():
                return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(order, pa.int32()), pa.array(at, pa.int64()), pa.array(kinds, pa.string()), pa.array(literals, pa.binary())], schema=arrow)

            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = 0
                for pos, kind, literal, _ in lex(content, off, left, limits.literal) if content is not None else ():
                    at.append(pos)
                    kinds.append(kind)
                    literals.append(literal)
                    n += 1
                path += [name] * n
                order += range(n)
                if len(path) >= 50_000:
                    yield made()
                    path, at, kinds, literals, order = [], [], [], [], []
            if path:
                yield made()

    return docs.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(run_tokens if table == "token" else run, schema)


class Documents:
    """A collection of documents; every method gives a DataFrame."""

    def __init__(self, docs: DataFrame, limits: Limits = Limits()):  # noqa: B008
        self.docs, self.limits = docs, limits

    def table(self, name: str, **options) -> DataFrame:
        return scan(self.docs, name, self.limits, **options)

    def register(self, prefix: str = "pdf_") -> None:
        """Temporary views of all tables."""
        for name in SCHEMAS:
            self.table(name).createOrReplaceTempView(prefix + name)

    def revisions(self) -> DataFrame:
        from ..operators.xref import revision_bounds

        r, s = self.table("revision"), self.table("xref_section")
        totals = s.groupBy("path").agg(F.count("*").cast("int").alias("sections"))
        per = s.groupBy("path", "rev").agg(F.sum("cnt").alias("objects"))
        out = revision_bounds(r.join(totals, "path", "left"), ["path"], "rev", "first_section", F.coalesce("sections", F.lit(0)))
        return out.join(per, ["path", "rev"], "left")

    def trailer(self) -> DataFrame:
        return self.table("revision").filter("rev = 0")

    def sections(self) -> DataFrame:
        return self.table("xref_section")

    def xref(self, include_shadowed: bool = False) -> DataFrame:
        from ..operators.xref import newest

        e = self.table("xref_entry").filter("error is null")
        if not include_shadowed:
            return newest(e, ["path", "num"], "sec", least=True).withColumn("live", F.lit(True))
        return e.withColumn("live", F.col("sec") == F.min("sec").over(Window.partitionBy("path", "num")))

    def objects(self, kind: str | None = None, limit: int | None = None, nums: list[int] | None = None) -> DataFrame:
        out = self.table("object", nums=nums)
        out = out.filter(F.col("kind") == kind) if kind else out
        return out.orderBy("path", "num").limit(limit) if limit else out

    def entries(self, nums: list[int] | None = None) -> DataFrame:
        return self.table("entry", nums=nums)

    def streams(self, decode: bool = False, nums: list[int] | None = None) -> DataFrame:
        return self.table("decoded" if decode else "stream", nums=nums)

    def stream(self, num: int) -> DataFrame:
        return self.streams(True, [num])

    def raw(self, off: int, length: int) -> DataFrame:
        """path, data: a span of each file, of a MiB at most."""
        if not 0 <= length <= 1 << 20:
            raise ValueError("a span is of 1 MiB at most")
        return self.docs.select("path", F.substring(F.col("content"), F.lit(off + 1), F.lit(length)).alias("data"))

    def tokens(self, off: int = 0, n: int | None = 32) -> DataFrame:
        return self.table("token", off=off, limit=n)

    def pages(self) -> DataFrame:
        return self.table("page")

    def page_text(self, page: int | None = None) -> DataFrame:
        """Text of all pages, or of one: others are then not decoded."""
        return self.table("page_text", page=page)

    def byte_map(self) -> DataFrame:
        from ..operators.ranges import byte_map

        sizes = self.docs.select("path", F.length("content").cast("long").alias("size"))
        return byte_map(self.table("object_range"), ["path"], sizes)

    def walk(self, path: str) -> DataFrame:
        from ..operators.tree import walk

        return walk(self.entries(), self.trailer(), path)

    def value_tree(self, num: int, depth: int = 8) -> DataFrame:
        """The object's values down to a depth, a row each, in order."""
        e = self.entries([num]).withColumn("depth", F.when(F.col("parent") == "", 1).otherwise(F.size(F.split("parent", "/")) + 1)).filter(F.col("depth") <= depth)
        place = F.transform(F.split(F.concat_ws("/", F.when(F.col("parent") != "", F.col("parent")), F.col("pos")), "/"), lambda x: x.cast("int"))
        return e.withColumn("place", place).orderBy("path", "num", "place")

    def info(self) -> DataFrame:
        from ..operators.xref import document_info

        return document_info(self.table("revision"), self.table("xref_section"))

    def object_streams(self) -> DataFrame:
        """path, stm, members: how many current objects each object stream holds."""
        return self.xref().filter("stm is not null").groupBy("path", "stm").agg(F.count("*").alias("members"))

    def readability(self) -> DataFrame:
        """path, objects, unreadable, in_streams of each document: its current objects, those with an error, and those of the latter that an object stream holds (where one can't be read, all of its members)."""
        bad = F.col("error").isNotNull()
        return self.table("object").groupBy("path").agg(F.count("*").alias("objects"), F.count_if(bad).alias("unreadable"), F.count_if(bad & F.col("stm").isNotNull()).alias("in_streams"))

    def kinds(self) -> DataFrame:
        """what ('record' or 'value'), kind, n over all documents."""
        records = self.xref().groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("record").alias("what"), "kind", "n")
        values = self.table("object").groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("value").alias("what"), "kind", "n")
        return records.unionByName(values)


def open_documents(spark: SparkSession, source: str | DataFrame, limits: Limits = Limits()) -> Documents:  # noqa: B008
    return Documents(files(spark, source) if isinstance(source, str) else source, limits)
