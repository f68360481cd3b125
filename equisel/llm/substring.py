"""Repeated passages by super-k-mer partitioning.

A window is ``k`` consecutive words of one document; its minimiser is the
least hash among the ``m``-word pieces inside it (the leftmost on ties).
Consecutive windows that share the minimising piece form one super-k-mer and
travel as one packed string to the bucket of that piece, where the windows are
hashed again, sorted and counted. Equal windows have equal minimisers, so a
bucket sees every copy.

Steps, each a Spark shuffle on evenly spread keys:

1. Minimisers are counted (map-side sums). A piece that occurs once in the
   whole corpus cannot hold a repeated window, so its strings never travel.
2. The repeated pieces go back to their documents (one short list a document).
3. Documents pack the super-k-mers of those pieces; a bucket with more than
   ``hot`` strings is dealt over ``ceil(count / hot)`` salts.
4. Every partition sorts its windows. A window met twice is repeated; of a
   salted bucket one row per distinct window is compared with the other salts.
5. Repeated ranges are gathered per document and the words removed.

Counting uses (minimiser, window hash), 128 bits in all.

Defined cases: null and empty texts have no words; a document shorter than
``k`` words keeps all; repeated rows repeat each other's windows; extra columns
are kept by :func:`dedup`; texts without a removed word stay byte for byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .store import files_for, free_name, tasks, tidy, written

K = 35
M = 8
HOT = 2000
_LOW = W.U((1 << 24) - 1)


def _super_kmers(texts: pa.Array, k: int, m: int) -> Iterator[tuple]:
    """Per block: (first row, words, row, minimiser, first window, last window)
    of every super-k-mer; the last five are arrays."""
    for i, _, raw, offs in W.blocks(texts):
        w = W.Words(raw, offs, W.WHITE)
        piece = W.runs(w.hashes(), m)
        n = len(w.start) - k + 1
        if n <= 0:
            continue
        # order by the upper 40 bits, then by place: the leftmost piece wins a tie
        least = W.sliding_min((piece & ~_LOW) | (np.arange(len(piece), dtype=W.U) & _LOW), k - m + 1)[:n]
        whole = w.doc[:n] == w.doc[k - 1 :]
        begin = whole.copy()
        begin[1:] &= (least[1:] != least[:-1]) | ~whole[:-1] | (w.doc[1:n] != w.doc[: n - 1])
        end = whole.copy()
        end[:-1] &= begin[1:] | ~whole[1:]
        a, b = np.flatnonzero(begin), np.flatnonzero(end)
        low = (least[a] & _LOW).astype(np.int64)
        place = a + ((low - a) & int(_LOW))
        yield i, w, w.doc[a], piece[place].view(np.int64), a, b


def _pieces(k: int, m: int) -> Callable:
    """Document key and minimisers, one row per super-k-mer's piece."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, doc, least, _, _ in _super_kmers(W.text_array(batch.column(1)), k, m):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i + doc]), pa.array(least)], ["rk", "mz"])

    return run


def _pack(k: int, m: int) -> Callable:
    """Packed strings of the super-k-mers whose piece is in the row's list."""

    def run(batches):
        for batch in batches:
            keys = batch.column("rk").to_numpy(zero_copy_only=False)
            column = batch.column("hits")
            flat = column.flatten()  # null and empty lists hold nothing
            wanted, salts = (flat.field(j).to_numpy(zero_copy_only=False) for j in (0, 1))
            size = np.array([0 if x is None else x for x in _lengths(column)], dtype=np.int64)
            owner = np.repeat(np.arange(len(size)), size)
            lookup = {(o, z): s for o, z, s in zip(owner.tolist(), wanted.tolist(), salts.tolist())}
            if not lookup:
                continue
            rows = batch.select(["text"]).column(0)
            for i, w, doc, least, a, b in _super_kmers(W.text_array(rows), k, m):
                out: tuple[list, ...] = ([], [], [], [], [])
                start, end, first = w.start, w.end, w.first
                data = w.raw.tobytes()
                some = np.isin(doc + i, owner)
                for d, z, s, t in zip(doc[some].tolist(), least[some].tolist(), a[some].tolist(), b[some].tolist()):
                    n = lookup.get((i + d, z))
                    if n is None:
                        continue
                    key = int(keys[i + d])
                    at = s - int(first[d])
                    for v, x in zip(out, (z, (key ^ (at * 0x9E3779B1)) % n if n > 1 else -1, key, at, data[start[s] : end[t + k - 1]])):
                        v.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                         pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], ["mz", "salt", "rk", "at", "packed"])

    return run


def _lengths(column) -> list:
    offs = column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return np.where(valid, np.diff(offs), 0).tolist()


#: Windows that a task holds before it counts the buckets that are complete.
HELD_WINDOWS = 1_000_000


def _count(k: int) -> Callable:
    """Sort the windows of each bucket's strings; the rows come sorted by bucket,
    so what is held does not grow with the partition. Rows out: a repeated range
    (``wh`` null) or, from a salted bucket, one row of each distinct window (``wh`` set)."""

    def run(batches):
        parts: list[tuple] = []
        held = 0
        for batch in batches:
            mz, salt, rk, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mz", "salt", "rk", "at"))
            for i, j, raw, offs in W.blocks(batch.column("packed").cast(pa.string())):
                w = W.Words(raw, offs, W.WHITE)
                wh = W.runs(w.hashes(), k)
                n = len(wh)
                keep = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
                row = w.doc[keep]
                parts.append((wh[keep].view(np.int64), mz[i + row], rk[i + row], at[i + row] + keep - w.first[row], salt[i + row]))
                held += len(keep)
                if held >= HELD_WINDOWS:
                    wh, mzs, rks, pos, salts = (np.concatenate(x) for x in zip(*parts))
                    before = np.flatnonzero((mzs != mzs[-1]) | (salts != salts[-1]))  # all but the last bucket
                    cut = int(before[-1]) + 1 if len(before) else 0
                    yield from _counted(wh[:cut], mzs[:cut], rks[:cut], pos[:cut], salts[:cut] >= 0, k)
                    parts = [tuple(x[cut:].copy() for x in (wh, mzs, rks, pos, salts))]
                    held = len(wh) - cut
        if parts:
            wh, mzs, rks, pos, salts = (np.concatenate(x) for x in zip(*parts))
            yield from _counted(wh, mzs, rks, pos, salts >= 0, k)

    return run


def _counted(wh, mz, rk, pos, salted, k: int) -> Iterator[pa.RecordBatch]:
    if not len(wh):
        return
    order = np.lexsort((mz, wh))
    same = (wh[order][1:] == wh[order][:-1]) & (mz[order][1:] == mz[order][:-1])
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    repeated = np.zeros(len(order), dtype=bool)
    repeated[order] = twice
    # one row of every distinct window of a salted bucket meets the other salts
    lead = np.zeros(len(order), dtype=bool)
    lead[order[np.concatenate([[True], ~same])]] = True
    alone = salted & lead
    yield from _ranges(rk[repeated], pos[repeated], k)
    for s in range(0, int(alone.sum()), 50_000):
        pick = np.flatnonzero(alone)[s : s + 50_000]
        yield _out(rk[pick], pos[pick], pos[pick] + k, wh[pick], mz[pick])


def _out(rk, a, b, wh=None, mz=None) -> pa.RecordBatch:
    none = pa.nulls(len(rk), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(rk), pa.array(a), pa.array(b), none if wh is None else pa.array(wh), none if mz is None else pa.array(mz)],
        ["rk", "lo", "hi", "wh", "mz"])


def _ranges(rk: np.ndarray, pos: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Word ranges covered by the windows, joined where they touch."""
    if not len(rk):
        return
    order = np.lexsort((pos, rk))
    rk, pos = rk[order], pos[order]
    cut = np.flatnonzero((rk[1:] != rk[:-1]) | (pos[1:] > pos[:-1] + k)) + 1
    a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(rk)]]) - 1
    for s in range(0, len(a), 50_000):
        yield _out(rk[a[s : s + 50_000]], pos[a[s : s + 50_000]], pos[b[s : s + 50_000]] + k)


def repeated_ranges(keyed: DataFrame, k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """(rk, ranges): for each row key the word ranges ``[lo, hi)`` covered by a
    window that also starts elsewhere. ``keyed`` has ``rk`` (long) and ``text``."""
    spark = keyed.sparkSession
    n, files = tasks(spark), files_for(keyed)
    pieces = keyed.select("rk", "text").mapInArrow(tidy(_pieces(k, m)), "rk long, mz long")
    often = pieces.groupBy("mz").count().where("count > 1").select(
        "mz", F.ceil(F.col("count") / hot).cast("int").alias("salts"))
    often = written(often, "pieces", files)
    hits = (pieces.join(often, "mz").groupBy("rk").agg(F.collect_set(F.struct("mz", "salts")).alias("hits")))
    packed = keyed.select("rk", "text").join(hits, "rk").mapInArrow(
        _pack(k, m), "mz long, salt long, rk long, at long, packed binary")
    counted = packed.repartition(n, "mz", "salt").sortWithinPartitions("mz", "salt").mapInArrow(tidy(_count(k)), "rk long, lo long, hi long, wh long, mz long")
    counted = written(counted, "windows", files)
    sure = counted.where("wh IS NULL").select("rk", "lo", "hi")
    across = (counted.where("wh IS NOT NULL").groupBy("mz", "wh").agg(F.collect_list(F.struct("rk", "lo", "hi")).alias("at"))
              .where(F.size("at") > 1).select(F.explode("at").alias("at")).select("at.*"))
    return sure.unionByName(across).groupBy("rk").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def _removed(texts: pa.Array, ranges: list) -> Iterator[tuple[int, int, bytes | None]]:
    """Per text: words, words removed, kept words joined by spaces (None: all kept)."""
    for i, j, raw, offs in W.blocks(texts):
        w = W.Words(raw, offs, W.WHITE)
        data = raw.tobytes()
        for row in range(j - i):
            spans = ranges[i + row]
            count, first = int(w.count[row]), int(w.first[row])
            if not spans:
                yield count, 0, None
                continue
            keep = np.ones(count, dtype=bool)
            for s in spans:
                keep[s["lo"] : s["hi"]] = False
            at = np.flatnonzero(keep) + first
            yield count, count - len(at), b" ".join([data[s:e] for s, e in zip(w.start[at].tolist(), w.end[at].tolist())])


def _joined(docs: DataFrame, text_col: str, id_col: str, k: int, m: int, hot: int) -> DataFrame:
    """``docs`` with the array of removed word ranges as a last column. The row
    key hashes id and text; rows that share both share their ranges, which are
    the same."""
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    keyed = docs.select(key.alias("rk"), F.col(text_col).alias("text"))
    rk, ranges = (free_name(docs.columns, c) for c in ("_rk", "_ranges"))
    found = repeated_ranges(keyed, k, m, hot).select(F.col("rk").alias(rk), F.col("ranges").alias(ranges))
    return docs.withColumn(rk, key).join(found, rk, "left").select(*(F.col(f"`{c}`") for c in docs.columns), ranges)


def passages(docs: DataFrame, k: int = K, m: int = M, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the kept words
    joined by one space)."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = _joined(base, "text", "doc_id", k, m, hot)
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = W.text_array(batch.column("text"))
            rows = list(_removed(texts, batch.column(batch.num_columns - 1).to_pylist()))
            kept = [b" ".join(t.encode().split()) if x is None else x for (_, _, x), t in zip(rows, texts.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.mapInArrow(tidy(run), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")


def dedup(docs: DataFrame, k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; other columns as they
    are. A text that loses no word stays unchanged."""
    at = docs.columns.index("text")
    joined = _joined(docs, "text", "doc_id", k, m, hot)

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            rows = list(_removed(W.text_array(column), batch.column(batch.num_columns - 1).to_pylist()))
            new = [t if x is None else x.decode() for (_, _, x), t in zip(rows, column.to_pylist())]
            arrays = [pa.array(new, pa.string()) if c == at else batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names[:-1])

    return joined.mapInArrow(tidy(run), docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from :func:`passages`'s."""
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


_SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = f"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, {_SQL_WORDS} AS w FROM documents),
wind AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS win
         FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM doc WHERE len(w) >= 35)),
rep AS (SELECT win FROM wind GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM wind JOIN rep USING (win)),
cut AS (SELECT r, list(p) AS ps, count(*) AS n FROM gone GROUP BY r),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM doc),
kept AS (SELECT word.r, string_agg(x, ' ' ORDER BY word.p) AS t FROM word LEFT JOIN gone ON gone.r = word.r AND gone.p = word.p
         WHERE gone.p IS NULL GROUP BY word.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)
"""
