"""Token files in directly addressable codes.

Ids are split into chunks of ``bits`` bits. Level 0 holds the lowest chunk of
every token; a continuation bitmap marks the tokens that go on in level 1, and
so forth. A rank directory (ones before every 512 bits) turns a position in
one level into the position in the next, so any token is read with one chunk
and one rank per level and nothing else is decoded.

Files: Parquet rows, one shard of about ``shard_tokens`` tokens each, in
ascending document order: ``part`` and ``seq`` (order of the shards), ``first``
(tokens before the shard in its part), the documents' ids and lengths, and the
shard's bytes. They are written and read by Spark only, so any store that the
cluster can reach will do.

Scale: one range shuffle by (doc_id, text hash), which also splits a document
id that many rows share; one shard in memory per task. Global starts come from
one row per part.

Defined cases: a null or empty text is its end token alone; a null doc_id sorts
first; rows with equal ids and texts are kept; an empty table writes no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import tokens as T
from . import words as W
from .store import new_path, tasks

MAGIC = b"DAC1"
RANK_BITS = 512
SHARD_TOKENS = 1 << 20


def encode(ids: np.ndarray, bits: int = 8) -> bytes:
    """Bytes of one shard."""
    if not 1 <= bits <= 8:
        raise ValueError("chunks have 1 to 8 bits")
    rest, levels = ids.astype(np.uint64), []
    while True:
        chunk = (rest & np.uint64((1 << bits) - 1)).astype(np.uint8)
        rest = rest >> np.uint64(bits)
        more = rest > 0
        ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        directory = (np.cumsum(ones) - ones).astype("<u4")
        levels.append((chunk, np.packbits(more, bitorder="little"), directory))
        rest = rest[more]
        if not len(rest):
            break
    out = [MAGIC, struct.pack("<BBQ", bits, len(levels), len(ids))]
    for chunk, bitmap, directory in levels:
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes(), bitmap.tobytes(), directory.tobytes()]
    return b"".join(out)


class Shard:
    """Reader of one shard's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        self.bits, n, self.size = struct.unpack_from("<BBQ", data, 4)
        at, self.levels = 14, []
        for _ in range(n):
            (count,) = struct.unpack_from("<Q", data, at)
            at += 8
            sizes = (count, -(-count // 8), -(-count // RANK_BITS) * 4)
            parts = []
            for s in sizes:
                parts.append(np.frombuffer(data, np.uint8, s, at))
                at += s
            self.levels.append((parts[0], parts[1], np.frombuffer(parts[2].tobytes(), "<u4")))

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> int:
        """Token ``i``, from one chunk and one rank per level."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for k, (chunk, bitmap, directory) in enumerate(self.levels):
            value |= int(chunk[i]) << (self.bits * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            before = bitmap[block * (RANK_BITS // 8) : i >> 3]
            i = int(directory[block]) + int(np.bitwise_count(before).sum()) + int(bitmap[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every token, as uint32."""
        out = np.zeros(self.size, dtype=np.uint64)
        at = None
        for k, (chunk, bitmap, _) in enumerate(self.levels):
            part = chunk.astype(np.uint64) << np.uint64(self.bits * k)
            more = np.unpackbits(bitmap, count=len(chunk), bitorder="little").astype(bool)
            if at is None:
                out, at = part, np.flatnonzero(more)
            else:
                out[at] |= part
                at = at[more]
        return out.astype("<u4")


def write(docs: DataFrame, target: str | None = None, path: str | None = None, bits: int = 8, shard_tokens: int = SHARD_TOKENS,
          end_id: int = T.END_ID, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the token files of ``docs``; returns their folder."""
    spark, path = docs.sparkSession, path or T.vocabulary()
    target = target or new_path(spark, "tokens")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    key = F.xxhash64("text")
    ordered = base.repartitionByRange(tasks(spark), F.col("doc_id").asc_nulls_first(), key).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), key)
    shape = f"part int, seq int, first long, n_tokens long, doc_ids array<{kind}>, lengths array<long>, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), T.encoder(path)
        seq = first = held = 0
        docs_, ids = [], []
        kept = None

        def shard():
            flat = np.frombuffer(b"".join(ids), dtype="<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([len(flat)], pa.int64()),
                 pa.array([docs_], pa.list_(kept)), pa.array([[len(x) // 4 for x in ids]], pa.list_(pa.int64())),
                 pa.array([encode(flat, bits)], pa.binary())],
                ["part", "seq", "first", "n_tokens", "doc_ids", "lengths", "payload"])

        for batch in batches:
            kept = batch.schema.field(0).type
            for s in range(0, batch.num_rows, 256):
                some = batch.slice(s, 256)
                for doc, x in zip(some.column(0).to_pylist(), encoder.encode(W.text_array(some.column(1)).to_pylist(), end_id)):
                    docs_.append(doc)
                    ids.append(x)
                    held += len(x) // 4
                    if held >= shard_tokens:
                        yield shard()
                        docs_, ids, seq, first, held = [], [], seq + 1, first + held, 0
        if docs_:
            yield shard()

    ordered.mapInArrow(run, shape).write.parquet(target)
    return target


def read(spark: SparkSession, target: str) -> DataFrame:
    """The shards with ``base``, the tokens of all parts before theirs."""
    shards = spark.read.parquet(target)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row for each range partition of the writer
    return shards.join(F.broadcast(parts), "part")


def documents(spark: SparkSession, target: str, with_ids: bool = True) -> DataFrame:
    """One row per document, from the files: doc_id, start (tokens of all
    documents before it), n_tokens, ids_crc32 and, ``with_ids``, the ids."""
    shards = read(spark, target)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.schema.field("doc_ids").type.value_type
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("base", "first", "doc_ids", "lengths", "payload")}
                flat = Shard(row["payload"]).all()
                size = np.array(row["lengths"], dtype=np.int64)
                end = np.cumsum(size)
                pieces = [flat[b - n : b].tobytes() for n, b in zip(size.tolist(), end.tolist())]
                arrays = [pa.array(row["doc_ids"], kept), pa.array(end - size + (row["base"] + row["first"])), pa.array(size),
                          pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(pieces, pa.binary())] * with_ids, names)

    return shards.select("base", "first", "doc_ids", "lengths", "payload").mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def lookup(positions: DataFrame, target: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Tokens at global positions: (pos, id). Positions and shards meet on
    blocks of ``shard_tokens``, and only the asked tokens are decoded."""
    block = lambda c: F.floor(c / shard_tokens)
    shards = read(positions.sparkSession, target).withColumn("at", F.col("base") + F.col("first"))
    dealt = shards.select("at", "n_tokens", "payload", F.explode(
        F.sequence(block(F.col("at")), block(F.col("at") + F.col("n_tokens") - 1))).alias("block"))
    asked = positions.select("pos", block(F.col("pos")).alias("block")).distinct()
    both = asked.join(dealt, "block").where("pos >= at AND pos < at + n_tokens").groupBy("at").agg(
        F.first("payload").alias("payload"), F.collect_set("pos").alias("pos"))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                shard, at, pos = Shard(batch.column("payload")[r].as_py()), batch.column("at")[r].as_py(), batch.column("pos")[r].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int64()), pa.array([shard[p - at] for p in pos], pa.int64())], ["pos", "id"])

    return both.mapInArrow(run, "pos long, id long")
