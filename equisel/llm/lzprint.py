"""Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed into dictionary phrases (each the shortest
piece not seen before); the phrases' hashes are the text's set, and its ``k``
least values the signature. Likeness is the share of common values among the
``k`` least of two signatures' union, an estimate of the phrase sets' Jaccard
index: texts that would compress each other are alike. Dictionaries start anew
every ``SEGMENT`` bytes, so memory stays bounded for a very long text.

Scale: one shuffle by ranges of doc_id (descending), whose limits are actual
ids. The first document of each range also travels, marked, to the range before
it, so every task sees each of its documents with the next one and no task sees
more than its range.

Defined cases: a null text is empty and has an empty signature; two empty
signatures have likeness 1, an empty and another 0; rows with equal ids are
ordered by text hash; null ids come last; a single row is its own next; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import words as W
from .store import tasks

K = 128
SEGMENT = 1 << 20


def _parse(data: bytes, seen: set, start: int, stop: int, cuts: list) -> int:
    """Parse on from ``start``; phrases end at the positions added to ``cuts``.
    Returns where the unfinished phrase begins."""
    add, cut = seen.add, cuts.append
    for end in range(max(start, cuts[-1] if cuts else start) + 1, stop + 1):
        piece = data[start:end]
        if piece not in seen:
            add(piece)
            cut(end)
            start = end
    return start


def _hashes(data: bytes, start: int, cuts: list) -> np.ndarray:
    """Hashes of the phrases that follow each other from ``start``."""
    if not cuts:
        return np.zeros(0, dtype=W.U)
    ends = np.array(cuts)
    begins = np.concatenate([[start], ends[:-1]])
    return W.segment_hashes(np.frombuffer(data, dtype=np.uint8)[start : cuts[-1]], begins - start, ends - begins)


def least(hashes: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` least 32-bit values, sorted."""
    short = (hashes >> W.U(32)).astype(np.uint32)
    return np.unique(np.partition(short, k)[: k + 1] if len(short) > 4 * k else short)[:k]


class Parsed:
    """Phrase signature of one text, with what a changed ending needs."""

    def __init__(self, text: str, k: int = K):
        self.text, self.k = text, k
        n = len(text)
        self.kept = text[: n - n // 2]
        self.data = text.encode()
        self.short = len(self.data) <= SEGMENT
        if not self.short:
            self.signature = _whole(self.data, k)
            return
        # the kept beginning is parsed once for the text and its changed form
        at = len(self.kept.encode())
        self.seen, cuts = set(), []
        self.open = _parse(self.data, self.seen, 0, at, cuts)
        self.head = _hashes(self.data, 0, cuts)
        self.at = at
        self.signature = self._with(self.data)

    def _with(self, data: bytes) -> np.ndarray:
        """Signature of the kept beginning with another ending."""
        cuts: list[int] = []
        added = _Added(self.seen)
        _continue(data, added, self.open, self.at, cuts)
        added.undo()
        return least(np.concatenate([self.head, _hashes(data, self.open, cuts)]), self.k)

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """The text with its last half replaced, and that text's signature."""
        n = len(self.text)
        text = self.kept + following[: n // 2]
        data = text.encode()
        if self.short and len(data) <= SEGMENT:
            return text, self._with(data)
        return text, _whole(data, self.k)


class _Added:
    """A phrase dictionary that forgets what was added since."""

    def __init__(self, seen: set):
        self.seen, self.new = seen, []

    def undo(self) -> None:
        self.seen.difference_update(self.new)


def _continue(data: bytes, into: _Added, start: int, at: int, cuts: list) -> None:
    seen, new = into.seen, into.new
    for end in range(at + 1, len(data) + 1):
        piece = data[start:end]
        if piece not in seen:
            seen.add(piece)
            new.append(piece)
            cuts.append(end)
            start = end


def _whole(data: bytes, k: int) -> np.ndarray:
    out = np.zeros(0, dtype=np.uint32)
    for s in range(0, len(data), SEGMENT):
        part, cuts = data[s : s + SEGMENT], []
        _parse(part, set(), 0, len(part), cuts)
        out = np.unique(np.concatenate([out, least(_hashes(part, 0, cuts), k)]))[:k]
    return out


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True)).mean())


def text_of(signature: np.ndarray) -> str:
    return base64.b64encode(signature.astype("<u4").tobytes()).decode()


def signature_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u4")


#: Text ids that the limits of ranges are taken from.
SAMPLED = 10_000


def _in_order(doc_id):
    """Spark's order of ids."""
    return doc_id.encode() if isinstance(doc_id, str) else doc_id


def _dealt(docs: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Rows with range ``p`` and mark ``tail`` (first row of the next range)."""
    known = docs.where("doc_id IS NOT NULL")
    if isinstance(docs.schema["doc_id"].dataType, T.NumericType):
        ids = known.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000).alias("q"), F.max("doc_id").alias("top")).first()
        limits = sorted({x for x in [*(ids["q"] or []), ids["top"]] if x is not None}, reverse=True)
    else:  # ranges of text ids from a sample; every id lies in one, whatever was sampled
        some = sorted((r[0] for r in known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLED).collect()), key=_in_order)
        top = known.agg(F.max("doc_id")).first()[0]
        limits = sorted({*(some[len(some) * i // n] for i in range(1, n) if some), *([top] if some else [])}, key=_in_order, reverse=True)
    if len(limits) < 2:
        return docs.select("*", F.lit(0).alias("p"), F.lit(0).alias("tail")), 1
    held = F.array(*(F.lit(x) for x in limits))
    p = F.coalesce(F.size(F.filter(held, lambda x: x >= F.col("doc_id"))) - 1, F.lit(len(limits) - 1))
    # a limit is the first id of its range, and follows the range before (after the last: the first)
    to = F.when(F.col("doc_id").isin(limits), F.array(
        F.struct(F.col("own").alias("p"), F.lit(0).alias("tail")),
        F.struct(F.pmod(F.col("own") - 1, F.lit(len(limits))).alias("p"), F.lit(1).alias("tail")))).otherwise(
        F.array(F.struct(F.col("own").alias("p"), F.lit(0).alias("tail"))))
    return docs.withColumn("own", F.when(F.col("doc_id").isNull(), len(limits) - 1).otherwise(p)).select(
        *docs.columns, F.inline(to)), len(limits)


def fingerprints(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    dealt, n = _dealt(base, tasks(docs.sparkSession))
    ordered = dealt.withColumn("h", F.xxhash64("text")).repartitionById(n, F.col("p")).sortWithinPartitions(
        "p", "tail", F.col("doc_id").desc_nulls_last(), "h").select("doc_id", "text", "p", "tail")
    shape = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = first = None  # the last document, the first of the range
        here, over, kept = None, False, None

        def out():
            cols = list(zip(*rows))
            rows.clear()
            types = [kept, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        def close(doc, parsed, following):
            text, changed = parsed.edited(following.text)
            rows.append((doc, len(parsed.text), hashlib.sha256(text.encode()).hexdigest(), text_of(parsed.signature),
                         text_of(changed), likeness(parsed.signature, changed, k), likeness(parsed.signature, following.signature, k)))

        for batch in batches:
            kept = batch.schema.field(0).type
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256).to_pydict()
                for doc, text, p, tail in zip(part["doc_id"], part["text"], part["p"], part["tail"]):
                    if p != here:
                        if held:  # a range without a marked row: it is the only one
                            close(*held, first)
                        held, first, here, over = None, None, p, False
                    if over:
                        continue
                    parsed = Parsed(text, k)
                    if held:
                        close(*held, parsed)
                        held = None
                    if tail:
                        over = True
                    else:
                        held, first = (doc, parsed), first or parsed
                if len(rows) >= 512:
                    yield out()
        if held:
            close(*held, first)
        if rows:
            yield out()

    return ordered.mapInArrow(run, shape)
