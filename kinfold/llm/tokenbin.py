"""Token ids in patched frame-of-reference blocks.

File format.  A data set is a folder of Parquet files.  A row holds whole
documents, ``ROW`` ids or a little more: ``shard``, ``first`` (the position of
its first id in the shard's stream), ``count``, ``doc_ids``, ``doc_tokens``,
the ``payload``, which is blocks of ``BLOCK`` ids (the last one shorter) one
after another, and ``block_at``, the byte at which each block starts.  Shards
follow one another in ascending doc_id order, rows by ``first`` in a shard.
Every row can be decoded alone, so files are read in any order and split
anywhere, and nothing is moved to put documents together again.

A block, little-endian: minimum u32, width u8, number of exceptions u32; its
values of ``width`` bits, packed from the highest bit, holding the low bits of
id - minimum; exception places u32 each, then their full id - minimum u32
each.  The width is that of the ``PERCENTILE`` value of id - minimum, so rare
large ids become exceptions and do not widen the block.

Spark's commit protocol writes the files, so a lost executor or a repeated
task leaves neither gaps nor doubles.

Null text is empty: the document is its end id alone.  Rows that repeat a
doc_id are kept, in any order among themselves.  Null doc_ids sort first.  An
empty table gives an empty data set.  Other columns are left out.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import partitions_of, prepare

BLOCK, ROW, PERCENTILE = 8192, 4 * 8192, 0.97
HEADER = struct.Struct("<IBI")
FORMAT = "shard int, first long, count long, doc_ids array<long>, doc_tokens array<long>, block_at array<long>, payload binary"


def pack(ids: np.ndarray) -> bytes:
    """One block's payload."""
    low = int(ids.min())
    delta = (ids - np.uint32(low)).astype(np.uint32)
    k = min(len(delta) - 1, int(PERCENTILE * len(delta)))
    width = int(np.partition(delta, k)[k]).bit_length()
    odd = np.flatnonzero(delta >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    if width == 16:  # whole bytes: the low halves as they are
        packed = delta.astype(np.uint16).astype(">u2").tobytes()
    else:
        packed = np.packbits(np.unpackbits(delta.astype(">u4").view(np.uint8)).reshape(-1, 32)[:, 32 - width :]).tobytes()
    return HEADER.pack(low, width, len(odd)) + packed + odd.astype("<u4").tobytes() + delta[odd].astype("<u4").tobytes()


def unpack(payload: bytes, count: int, at: int = 0) -> np.ndarray:
    """The ids of the block that starts at a byte of a payload."""
    low, width, n_odd = HEADER.unpack_from(payload, at)
    size, at = (count * width + 7) // 8, at + HEADER.size
    if width == 16:
        delta = np.frombuffer(payload, ">u2", count, at).astype(np.uint32)
    else:
        bits = np.zeros((count, 32), np.uint8)
        bits[:, 32 - width :] = np.unpackbits(np.frombuffer(payload, np.uint8, size, at), count=count * width).reshape(count, width)
        delta = np.packbits(bits).view(">u4").astype(np.uint32)
    places = np.frombuffer(payload, "<u4", n_odd, at + size)
    delta[places] = np.frombuffer(payload, "<u4", n_odd, at + size + 4 * n_odd)
    return delta + np.uint32(low)


def pack_stream(ids: np.ndarray) -> tuple[list[int], bytes]:
    """Where each block of a stream starts, and the blocks."""
    blocks = [pack(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    return np.cumsum([0, *map(len, blocks[:-1])]).tolist(), b"".join(blocks)


def unpack_stream(payload: bytes, count: int, block_at: list[int]) -> np.ndarray:
    """The ids of all blocks."""
    return np.concatenate([unpack(payload, min(BLOCK, count - k * BLOCK), at) for k, at in enumerate(block_at)])


def encode_rows(docs: DataFrame, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Rows of the file format for ``docs``, ordered by doc_id over the shards."""
    prepare(docs.sparkSession)
    path = path or tokens.default_path()

    def run(batches):
        encode, shard, first = tokens.encoder(path), TaskContext.get().partitionId(), 0
        end, parts, doc_ids, sizes, held = np.array([end_id], np.uint32), [], [], [], 0
        for batch in _with_end(batches):
            out = []
            for doc_id, ids in [] if batch is None else zip(batch.column(0).to_pylist(), encode.encode(batch.column(1))):
                parts += [ids, end]
                doc_ids.append(doc_id)
                sizes.append(len(ids) + 1)
                held += len(ids) + 1
                if held >= ROW:
                    out.append((shard, first, held, doc_ids, sizes, *pack_stream(np.concatenate(parts))))
                    first, parts, doc_ids, sizes, held = first + held, [], [], [], 0
            if batch is None and held:
                out.append((shard, first, held, doc_ids, sizes, *pack_stream(np.concatenate(parts))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), KINDS)], names=NAMES)

    key, more = ["doc_id", "tie", "row"], partitions_of(docs)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    dealt = keyed.repartitionByRange(more, *key) if more else keyed.repartitionByRange(*key)
    return dealt.sortWithinPartitions(*key).select("doc_id", "text").mapInArrow(run, FORMAT)


def _with_end(batches):
    """The batches, then None."""
    yield from batches
    yield None


NAMES = ["shard", "first", "count", "doc_ids", "doc_tokens", "block_at", "payload"]
KINDS = [pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]


def write(docs: DataFrame, folder: str, end_id: int = 2, path: str | None = None) -> None:
    """Write ``docs`` as a data set of the file format.  Its payload is packed already, so Parquet packs nothing."""
    encode_rows(docs, end_id, path).write.options(**{"compression": "none", "parquet.enable.dictionary": "false"}).parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a data set: doc_id, start, n_tokens, tokens (array of int)."""
    return _decoded(spark, folder, "tokens array<int>", lambda ids: ids.astype(np.int32).tolist(), pa.list_(pa.int32()))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a data set: doc_id, start, n_tokens, ids_crc32 of the decoded ids."""
    return _decoded(spark, folder, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def _decoded(spark: SparkSession, folder: str, column: str, of, kind) -> DataFrame:
    prepare(spark)
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), kind]
    names = ["shard", "doc_id", "first", "n_tokens", column.split()[0]]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                shard, first, count, doc_ids, sizes, block_at, payload = (c[row].as_py() for c in batch.columns)
                ids, ends = unpack_stream(payload, count, block_at), np.cumsum(sizes)
                starts = ends - sizes
                values = [of(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [[shard] * len(sizes), doc_ids, starts + first, sizes, values]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    rows = spark.read.schema(FORMAT).parquet(folder)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each shard, of which there are as many as tasks that wrote.
    offsets = rows.groupBy("shard").agg(F.sum("count").alias("size")).select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    documents = rows.mapInArrow(run, f"shard int, doc_id long, first long, n_tokens long, {column}")
    return documents.join(offsets, "shard").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", column.split()[0])
