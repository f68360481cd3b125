"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes has its top bits zero,
so equal stretches of text are cut alike wherever they stand. A document becomes
its recipe: the ordered list of its chunks' 16-byte identifiers. Documents are
then compared by recipe, some 16 bytes for every 2 KB of text.

Identifiers are verified: every distinct (identifier, bytes) pair is gathered
once, and if one identifier stands for two byte strings, all are drawn anew
with the next salt. Texts themselves move once, as chunks, of which a task
sends each distinct one a single time; equal documents, a third of the corpus
maybe, thus cost one copy per task. Equal recipes therefore mean equal bytes.

Texts are equal when identical after lower-casing A-Z. Null counts as empty;
all empty texts are equal. Among rows of one text and one doc_id exactly one is
kept; a null doc_id stays only where the whole group has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .hot import join_back
from .store import written

WINDOW = 32
ID_BYTES = 16
#: Chunk sizes in bytes: least, most, and mean distance of cut points as a power of two.
LEAST, MOST, BITS = 512, 16384, 11
SALTS = 8

_GEAR = (W.mix(np.arange(1, 257, dtype=W.U) * W.U(0x9E3779B97F4A7C15)) >> W.U(32)).astype(np.uint32)
_STEP = 0x9E3779B1
LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def cut_points(raw: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Ends of the windows whose hash has its ``bits`` top bits zero."""
    if len(raw) < WINDOW:
        return np.zeros(0, dtype=np.int64)
    h, step = _GEAR[raw], 1
    while step < WINDOW:  # hash of 2 x step bytes from two of step bytes
        h = h[:-step] * np.uint32(pow(_STEP, step, 1 << 32)) + h[step:]
        step *= 2
    return np.flatnonzero(h >> np.uint32(32 - bits) == 0) + WINDOW


def chunk_ends(raw: np.ndarray, offs: np.ndarray, least: int = LEAST, most: int = MOST, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(end of every chunk, chunks of every text) of the texts ``raw[offs[i]:offs[i + 1]]``.
    A chunk ends at the first cut point at least ``least`` bytes on, after
    ``most`` bytes at the latest, and with its text."""
    points, ends, counts = cut_points(raw, bits), [], np.zeros(len(offs) - 1, dtype=np.int64)
    for i, (at, end) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        before = len(ends)
        while end - at > least:
            k = int(np.searchsorted(points, at + least))
            cut = min(int(points[k]) if k < len(points) else end, at + most, end)
            ends.append(cut)
            at = cut
        if at < end:
            ends.append(end)
        counts[i] = len(ends) - before
    return np.array(ends, dtype=np.int64), counts


def _identified(raw: np.ndarray, ends: np.ndarray, salt: int) -> list[bytes]:
    view, at, out, key = memoryview(np.ascontiguousarray(raw)), 0, [], salt.to_bytes(4, "little")
    for e in ends.tolist():
        out.append(hashlib.blake2b(view[at:e], digest_size=ID_BYTES, salt=key).digest())
        at = e
    return out


def _blocks(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, raw, offs in W.blocks(W.text_array(column)):
        yield i, j, W.LOWER[raw], offs


def recipes(docs: DataFrame, salt: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, text_sha256 (of the normalised
    text) and recipe, the concatenated identifiers of its chunks."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sizes, shas, lists = [], [], []
            for i, j, raw, offs in _blocks(batch.column(1)):
                ends, counts = chunk_ends(raw, offs)
                ids, view, at = _identified(raw, ends, salt), memoryview(raw), 0
                for k, n in enumerate(counts.tolist()):
                    sizes.append(int(offs[k + 1] - offs[k]))
                    shas.append(hashlib.sha256(view[int(offs[k]) : int(offs[k + 1])]).hexdigest())
                    lists.append(b"".join(ids[at : at + n]))
                    at += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(lists, pa.binary())],
                                             ["doc_id", "n_bytes", "text_sha256", "recipe"])

    return base.mapInArrow(run, f"doc_id {kind}, n_bytes long, text_sha256 string, recipe binary")


def chunks(docs: DataFrame, salt: int = 0, text_col: str = "text") -> DataFrame:
    """One row per chunk occurrence: id, bytes. Chunks that repeat within a
    block are given once."""

    def run(batches):
        for batch in batches:
            for _, _, raw, offs in _blocks(batch.column(0)):
                ends, _ = chunk_ends(raw, offs)
                if not len(ends):
                    continue
                ids = pa.array(_identified(raw, ends, salt), pa.binary())
                bounds = np.concatenate([[0], ends]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))])
                yield pa.RecordBatch.from_arrays([ids, data], ["id", "bytes"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "id binary, bytes binary")


def ambiguous(docs: DataFrame, salt: int = 0, text_col: str = "text") -> DataFrame:
    """Identifiers that stand for more than one byte string."""
    return chunks(docs, salt, text_col).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")


def verified_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`recipes` as a written table with a row number, under the first
    salt whose identifiers all stand for one byte string each."""
    for salt in range(SALTS):
        if ambiguous(docs, salt, text_col).isEmpty():
            return written(recipes(docs, salt, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "recipes")
    raise RuntimeError(f"chunk identifiers collide under {SALTS} salts")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (largest doc_id of equal
    texts), group_size, kept, text_sha256, n_bytes, n_chunks."""
    rows = verified_recipes(docs, id_col, text_col)
    groups = rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    out = join_back(rows, groups, "recipe", "group_size", rows.count())
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
                      "text_sha256", "n_bytes", (F.length("recipe") / ID_BYTES).cast("long").alias("n_chunks"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns unchanged, one for each different text:
    that of the largest doc_id. Of rows equal in doc_id and text any one stays."""
    taken = {c.lower() for c in docs.columns}
    key = next(n for n in ("_sha", "_sha_", "_sha__") if n not in taken)
    own = next(n for n in ("_own", "_own_", "_own__") if n not in taken)
    stay = duplicates(docs, id_col, text_col).where("kept").select(F.col("text_sha256").alias(key), F.col("doc_id").alias(own))
    lowered = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), LOWER, LOWER.lower())
    marked = docs.withColumn(key, F.sha2(lowered.cast("binary"), 256)).alias("d").join(
        stay.alias("s"), (F.col(f"d.{key}") == F.col(f"s.{key}")) & F.col(f"d.{id_col}").eqNullSafe(F.col(f"s.{own}")), "left_semi")
    return marked.dropDuplicates([key]).drop(key)


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
