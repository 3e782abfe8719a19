"""Documents as they arrive: files stream in, their tables stream out, and the newest record of each object is kept.

Files that land in a folder are read once; an update of a document is another file (or another row) with the same path and a
later time. Records are append-only, so the state for an object is its newest record alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernel.objects import Limits
from ..sources.pdf import scan
from ..tables import SCHEMAS


def read_stream(spark: SparkSession, folder: str, table: str = "object", per_trigger: int = 1000) -> DataFrame:
    """A streaming DataFrame of a table of the documents that land in ``folder``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    docs = spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", per_trigger).load(folder)
    return scan(docs, table, Limits())


def newest_records(entries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A streaming aggregate of the newest row of each key (for output modes update and complete)."""
    rest = [c for c in entries.columns if c not in keys]
    return entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row")).select(*keys, "row.*")


def append_to(stream: DataFrame, folder: str, checkpoint: str):
    """Starts the stream into Parquet files, exactly once; it ends when all that is there now is done."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


TABLES = tuple(SCHEMAS)
