"""Token ids in bit-packed block files.

A file is a Parquet file whose rows are blocks, so that Spark's commit protocol covers it and any store
that Spark reaches will do. A block's bytes stand alone (little-endian):

    4 bytes   ``PLTB``
    u16 u16   version (1); bits an id (the fewest that hold the vocabulary)
    u32 u64   documents; ids
    u64 * (documents + 1)   offsets of the documents among the block's ids
    ids       packed without gaps, low bits first, to a whole byte

The id columns beside it give random access: a reader finds a document's block by ``first_id`` and
``last_id`` and unpacks only its ids, all at once, with numpy.

Order: blocks by ascending document id, shard by shard; documents with the same id by their text. A null
text is an empty one (it has the end id alone). An empty table gives files without blocks. Texts of any length are encoded whole; a block is
as long as its last document. Columns other than id and text aren't read, whatever their names. (The row a shard that is broadcast is
one for each file that was written.)
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_text, lean
from .tokenizing import encoder, in_parts

HEAD = struct.Struct("<4sHHIQ")


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    out = []
    for at in range(0, len(ids), 1 << 16):  # a multiple of 8 ids is a whole number of bytes
        bits = (ids[at : at + (1 << 16), None].astype(np.uint32) >> np.arange(width, dtype=np.uint32)) & 1
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack_bits(data: bytes, width: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from the ``first`` on: each is cut from the five bytes that it begins in."""
    if width in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{width // 8}", count=count, offset=first * width // 8).astype(np.uint32)
    lo, hi = first * width // 8, -(-(first + count) * width // 8)
    raw = np.concatenate((np.frombuffer(data, np.uint8, hi - lo, lo), np.zeros(5, np.uint8))).astype(np.uint64)
    bit = np.arange(count, dtype=np.int64) * width + (first * width - 8 * lo)
    at = bit >> 3
    word = raw[at]
    for k in range(1, 5):
        word = word | raw[at + k] << np.uint64(8 * k)
    return (word >> (bit & 7).astype(np.uint64) & np.uint64((1 << width) - 1)).astype(np.uint32)


def write_block(docs: list[np.ndarray], width: int) -> bytes:
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype("<u8")
    ids = np.concatenate(docs)
    return HEAD.pack(b"PLTB", 1, width, len(docs), len(ids)) + offsets.tobytes() + pack_bits(ids, width)


class Block:
    """A block for reading: ``document(k)`` unpacks one document, ``all()`` all ids."""

    def __init__(self, data: bytes):
        magic, version, self.width, self.n_docs, self.n_ids = HEAD.unpack_from(data)
        if (magic, version) != (b"PLTB", 1):
            raise ValueError("not a block of token ids")
        self.offsets = np.frombuffer(data, "<u8", self.n_docs + 1, HEAD.size).astype(np.int64)
        self.data = memoryview(data)[HEAD.size + 8 * (self.n_docs + 1) :]

    def document(self, k: int) -> np.ndarray:
        return unpack_bits(self.data, self.width, int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k]))

    def all(self) -> np.ndarray:
        return unpack_bits(self.data, self.width, 0, self.n_ids)


def write_token_files(docs: DataFrame, to: str, path: str, end_id: int = 2, shards: int | None = None, block_ids: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes ``docs`` and writes their files to the folder ``to``, in ascending id order over shards and blocks."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    @lean
    def encode(batches):
        from pyspark import TaskContext

        enc, shard = encoder(path), TaskContext.get().partitionId()
        width = max(1, int(max(enc.vocab_size - 1, end_id)).bit_length())
        held, ids, size, block, start = [], [], 0, 0, 0

        def row():
            return pa.RecordBatch.from_pydict({"shard": [shard], "block": [block], "start": [start], "n_ids": [size], "first_id": [held[0]], "last_id": [held[-1]], "doc_ids": [held], "data": [write_block(ids, width)]}, schema=out)

        for batch in batches:
            out = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("first_id", batch.schema.field(0).type), ("last_id", batch.schema.field(0).type), ("doc_ids", pa.list_(batch.schema.field(0).type)), ("data", pa.binary())])
            at = iter(batch.column(0).to_pylist())
            for part in in_parts(batch.column(1)):
                for raw, doc in zip(enc.ids(part), at):  # noqa: B905  parts take turns at it; the ids come first so that none is lost
                    held.append(doc)
                    ids.append(np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)))
                    size += len(ids[-1])
                    if size >= block_ids:
                        yield row()
                        start, block = start + size, block + 1
                        held, ids, size = [], [], 0
        if held:
            yield row()

    placed = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    placed.mapInArrow(encode, f"shard int, block int, start long, n_ids long, first_id {kind}, last_id {kind}, doc_ids array<{kind}>, data binary").write.parquet(to)


def read_token_files(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files under ``at``."""
    blocks = spark.read.parquet(at)
    kind = blocks.schema["first_id"].dataType.simpleString()
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row for each written partition
    base = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    @lean
    def decode(batches):
        for batch in batches:
            for base, start, docs, data in zip(*(batch.column(k).to_pylist() for k in ("base", "start", "doc_ids", "data")), strict=True):
                block = Block(data)
                raw, cut = memoryview(block.all().astype("<u4").tobytes()), block.offsets
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field("doc_ids").type.value_type), pa.array(cut[:-1] + (base + start)), pa.array(np.diff(cut)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.join(F.broadcast(base), "shard").select("base", "start", "doc_ids", "data").mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, at: str, doc_id) -> list[np.ndarray]:
    """The ids of the documents with this id. Only the blocks that may hold it are read (their bounds are pushed to the scan)."""
    rows = spark.read.parquet(at).filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("shard", "block").select("doc_ids", "data").toLocalIterator()
    return [Block(bytes(r["data"])).document(k) for r in rows for k, d in enumerate(r["doc_ids"]) if d == doc_id]
