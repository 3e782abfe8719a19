"""What the operators of this package share: reading tables, cutting lineage, batches of Arrow columns."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a folder of this machine if Spark runs on this machine alone, else one in the warehouse."""
    sc = spark.sparkContext._jsc.sc()
    if not sc.getCheckpointDir().isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            at = tempfile.mkdtemp(prefix="pagelake-") if re.match(r"local(\[|$)", spark.sparkContext.master) else spark.conf.get("spark.sql.warehouse.dir") + "/_pagelake"
        spark.sparkContext.setCheckpointDir(at)
    return sc.getCheckpointDir().get()


#: Bytes of its input, as the planner estimates them, for which a stored table has a task of its own at least.
TASK_BYTES = 16 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns it as read back: its lineage ends here and lost executors cost nothing before it.

    Where the last stage has far more partitions than its estimated size asks for, they are gathered: into two tasks a core,
    or one for each TASK_BYTES if those are more. So tasks follow the input, and small tables are few files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    df.coalesce(max(2 * spark.sparkContext.defaultParallelism, min(-(-size // TASK_BYTES), 1 << 30))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    for scope in _scopes:
        scope.append(path)
    return out


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scope() -> Iterator[list[str]]:
    """Gathers the paths of all tables that are stored inside it, so that they can go when what was made of them is written."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes[:] = [x for x in _scopes if x is not paths]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of stored tables, and lets Spark clean up the shuffles that nothing refers to any more."""
    jvm, size = spark._jvm, 0
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(at):
            size += fs.getContentSummary(at).getLength()
            fs.delete(at, True)
    if size > 16 << 20:
        gc.collect()
        jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Deletes stored tables that later steps don't read: what was made of them is stored itself."""
    remove(tables[0].sparkSession, [t._stored_at for t in tables])


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators read, under fixed names; a null text is an empty one. Other columns play no part."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def held_out(id_col: str = "doc_id"):
    """Rows of which a classifier never sees the label."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def least(n: int, take: int) -> int:
    """A bound on 64-bit hashes of n rows under which at least ``take`` of them lie (short of a chance of one in 10^9), and few more: what is sorted for a sample is then as small as the sample."""
    share = (take + 7 * take**0.5 + 20) / max(1, n)
    return (1 << 63) - 1 if share >= 1 else int(share * 2.0**64) - (1 << 63)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lean(run: Callable) -> Callable:
    """A function over batches that gives free memory back when its task ends: Python workers live on, and would keep what one stage needed through all that follow."""

    @functools.wraps(run)
    def out(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return out


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The runs of equal keys in sorted batches, each as one batch. (Groups of two or three rows by the hundred thousand cost too much as frames of their own.)"""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            x = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        cut = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(cut, cut[1:], strict=False):
            yield batch.slice(a, b - a)
        held = batch.slice(cut[-1])
    if held is not None:
        yield held


WORD = re.compile(r"\w+")


def word_list(text: str) -> list[str]:
    """Lower-cased words, one for each match of WORD in the text as it is (so that they can be found there again, also where lower case has other lengths)."""
    words = WORD.findall(text)
    return "\0".join(words).lower().split("\0") if words else []


class _Known(dict):
    """Hashes of words by word; one that isn't held is computed, and held while there is room."""

    def __init__(self, bound: int):
        import xxhash

        super().__init__()
        self.digest, self.bound = xxhash.xxh3_64_intdigest, bound

    def __missing__(self, word: str) -> int:
        h = self.digest(word)
        if len(self) < self.bound:
            self[word] = h
        return h


class WordHasher:
    """64-bit hashes of words, the first of which are remembered, up to a bound."""

    def __init__(self, bound: int = 120_000):
        self.known = _Known(bound)

    def __call__(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the runs of k words; a shorter text is one run, an empty one none."""
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    k = min(k, n)
    h = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        h = (h ^ words[i : n - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return mix64(h)


def width(df: DataFrame) -> Column | None:
    """Bytes of a row's variable columns, by a column expression; None if all are of fixed width."""
    parts = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("string", "binary"):
            parts.append(F.octet_length(f.name))
        elif f.dataType.typeName() in ("array", "map"):
            parts.append(F.length(F.to_json(F.struct(f.name))))
        elif f.dataType.typeName() == "struct":
            parts.append(F.length(F.to_json(f.name)))
    return sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)) if parts else None


def is_small(df: DataFrame, limit: int = 16 << 20) -> bool:
    """Whether ``df`` is measured to hold at most so many bytes; 16 for each fixed column of a row, and the lengths of variable ones."""
    own = width(df)
    n, size = df.agg(F.count("*"), F.lit(0) if own is None else F.sum(own)).first()
    return n * 16 * len(df.columns) + (size or 0) <= limit


def small(df: DataFrame, limit: int = 16 << 20) -> DataFrame:
    """``df`` marked for broadcast if it is measured to be small; else as it is, to be shuffled."""
    return F.broadcast(df) if is_small(df, limit) else df


def dealt_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", each: int = 4096) -> DataFrame:
    """``left`` join ``right``, which has one row for each ``on`` at most, so that no key's rows need to meet in one task.

    A small ``right`` is broadcast. Else the rows of a key that has over ``each`` of them, and over a ten thousandth of all, are dealt over
    several tasks by a hash of the whole row, and that key's row of ``right`` goes to each of them. Both tables should be stored.
    """
    if is_small(right):
        return left.join(F.broadcast(right), on, how)
    each = max(each, left.count() // 10_000)
    hot = left.groupBy(on).agg(F.count("*").alias("__n")).filter(F.col("__n") > each).select(on, F.ceil(F.col("__n") / each).cast("int").alias("__ways"))
    hot = stored(hot, "hot")  # 10,000 rows at most
    if hot.isEmpty():
        return left.join(right, on, how)
    one = left.join(F.broadcast(hot), on, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("__ways")).cast("int"), F.lit(0))).drop("__ways")
    other = right.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__ways", F.lit(1)) - 1))).drop("__ways")
    return one.join(other, [on, "__salt"], how).drop("__salt")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
