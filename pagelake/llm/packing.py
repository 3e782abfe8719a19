"""Packing token sequences by length patterns.

The pieces of all documents are counted by length. Over that histogram (``capacity`` bins at most, however
many documents there are) patterns of a few lengths that fill a sequence exactly are enumerated, how
often to repeat each is fitted to the histogram by non-negative least squares, the repeats are rounded
down, and what is left is packed by best fit, whole runs of equal lengths at a time. Only then are the
pieces dealt to their places, by their rank among those of their length.

Defined cases: a null text is an empty document of one token (the end id); rows with the same id are
documents of their own, dealt in any order; an empty table gives an empty result; columns other than
the id and the text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_text, lean, stored
from .tokenizing import encoder, in_parts

#: Exact patterns of three and four lengths that are tried at most. It bounds the planning time, not what is packed.
MAX_PATTERNS = 40_000


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document longer than ``capacity`` is cut so that all its pieces but the first are full."""
    tail = np.array([end_id], dtype="<u4").tobytes()

    @lean
    def cut(batches):
        enc = encoder(path)
        for batch in batches:
            at, rows = 0, ([], [], [], [], [])
            for part in in_parts(batch.column(1)):
                for ids in enc.ids(part):
                    ids += tail
                    n = len(ids) // 4
                    bounds = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        for col, x in zip(rows, (at, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                            col.append(x)
                    at += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def enumerate_patterns(lengths: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Patterns of one to four of the lengths that fill ``capacity`` exactly, all of two, and evenly spaced ones of more."""
    have = set(lengths)
    few = sorted(have)
    out = [(capacity,)] if capacity in have else []
    out += [(a, capacity - a) for a in few if a >= capacity - a and capacity - a in have]
    triples = [(capacity - a - b, b, a) for i, a in enumerate(few) for b in few[i:] if capacity - a - b >= b and capacity - a - b in have]
    out += triples[:: max(1, -(-len(triples) // MAX_PATTERNS))]
    step = few[:: max(1, len(few) // 40)]
    quads = [(capacity - a - b - c, c, b, a) for i, a in enumerate(step) for j, b in enumerate(step[i:]) for c in step[i + j :] if capacity - a - b - c >= c and capacity - a - b - c in have]
    return out + quads[:: max(1, -(-len(quads) // MAX_PATTERNS))]


def fit_repeats(patterns: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares of the histogram over the patterns, by multiplicative updates; only sparse sums are formed."""
    which = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    length = np.array([x for p in patterns for x in p])
    h = histogram.astype(float)
    top = np.bincount(which, h[length], len(patterns))
    x = top / np.maximum(1, np.bincount(which, minlength=len(patterns))) / np.sqrt(len(patterns))
    for _ in range(rounds):
        made = np.bincount(length, x[which], len(h))
        x *= top / np.maximum(1e-12, np.bincount(which, made[length], len(patterns)))
    return x


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, of counted lengths: bins that hold the same are one group."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            at = min((r for r in room if r >= n), default=None)
            if at is None:
                each = min(capacity // n, count)
                full, rest = divmod(count, each)
                for m, k in ((each, full), (rest, 1)):
                    if m and k:
                        room.setdefault(capacity - m * n, []).append(((n,) * m, k))
                count = 0
                continue
            held, k = room[at].pop()
            if not room[at]:
                del room[at]
            take = min(k, count)
            if k > take:
                room.setdefault(at, []).append((held, k - take))
            room.setdefault(at - n, []).append(((*held, n), take))
            count -= take
    return [x for groups in room.values() for x in groups]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that hold every counted piece exactly once."""
    h = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in histogram.items():
        h[n] = k
    out: list[tuple[tuple[int, ...], int]] = []
    if h[capacity]:
        out.append(((capacity,), int(h[capacity])))
        h[capacity] = 0
    for _ in range(4):
        patterns = enumerate_patterns(np.flatnonzero(h).tolist(), capacity)
        if not patterns:
            break
        x = fit_repeats(patterns, h)
        used = 0
        for k in np.argsort(-x, kind="stable").tolist():
            p = patterns[k]
            need = {n: p.count(n) for n in p}
            if (times := min(int(x[k]), *(int(h[n]) // m for n, m in need.items()))) > 0:
                out.append((p, times))
                used += times
                for n, m in need.items():
                    h[n] -= m * times
        if not used:
            break
    return out + best_fit({n: int(h[n]) for n in np.flatnonzero(h).tolist()}, capacity)


def places(planned: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For each length, runs of ranks: (length, first rank, sequence of the first, offset in it), sorted by the first two."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in planned:
        offset = 0
        for n in pattern:
            rows.append((n, taken.get(n, 0), sequence, offset))
            taken[n] = taken.get(n, 0) + times
            offset += n
        sequence += times
    return tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.empty(0, np.int64),) * 4


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: each piece's place. No piece is lost and no sequence is over-full."""
    found = stored(pieces(docs, path, end_id, capacity, id_col, text_col).withColumn("shard", F.spark_partition_id()), "pieces")
    sizes = found.groupBy("length", "shard").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    length, first, sequence, offset = places(plan(histogram, capacity))
    key = length * (1 << 44) + first

    @lean
    def put(batches):
        for batch in batches:
            n, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            at = np.searchsorted(key, n * (1 << 44) + rank, side="right") - 1
            kept = [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).drop("n")
    own = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = found.withColumn("own", F.row_number().over(own)).join(before, ["length", "shard"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(put, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
