"""``spark.read.format("pdf").option("table", "object").option("nums", "1,5").load(folder)``: the tables as a data source.

Object numbers to read are an option and not pushed filters: a pushed filter stays with the relation, and a later query over the
same DataFrame without it would miss rows. A partition is a run of files of about the same bytes.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..tables import SCHEMAS


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PdfReader(DataSourceReader):
    def __init__(self, options: dict, partition_bytes: int = 64 << 20):
        self.options, self.partition_bytes = options, partition_bytes
        self.nums = {int(x) for x in options["nums"].split(",")} if options.get("nums") else None
        self.table = options.get("table", "object")

    def partitions(self):
        import pyarrow.fs as fs

        store, root = fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] else (fs.LocalFileSystem(), self.options["path"])
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        parts, held, size = [], [], 0
        for f in sorted((f for f in found if f.is_file and f.path.lower().endswith(".pdf")), key=lambda f: f.path):
            held.append(f.path)
            size += f.size
            if size >= self.partition_bytes:
                parts.append(_Files(held))
                held, size = [], 0
        return [*parts, _Files(held)] if held or not parts else parts

    def read(self, partition):
        import pyarrow.fs as fs

        from ..kernel.objects import Limits
        from ..kernel.rows import rows

        store = fs.FileSystem.from_uri(self.options["path"])[0] if "://" in self.options["path"] else fs.LocalFileSystem()
        names = [c.split()[0] for c in SCHEMAS[self.table].split(", ")]
        make = rows(self.table, Limits())
        for path in partition.paths:
            with store.open_input_file(path) as f:
                data = f.read()
            for r in make(path, data):
                if self.nums is None or r.get("num") in self.nums:
                    yield tuple(r.get(n) for n in names)


class PdfDataSource(DataSource):
    @classmethod
    def name(cls):
        return "pdf"

    def schema(self):
        return SCHEMAS[self.options.get("table", "object")]

    def reader(self, schema):
        return PdfReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(PdfDataSource)
