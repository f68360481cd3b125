"""Benchmark decontamination with a generalised suffix automaton.

The normalised items of a benchmark become one automaton over word ids. Every
document is streamed through it; the state keeps the longest item passage that
ends at the current word. Where that length reaches the window (13 words, or a
whole shorter item) the covered words are hit. Hit spans are reported
(``contamination``), those over a length limit can be cut from the texts
(``cut``), and documents over the coverage limit are contaminated and can be
left out (``remove``).

Scale: documents are never shuffled; each task holds one automaton. The
automaton's size follows the benchmark, not the corpus: items are dealt by
hash into as many shards as keep each below ``shard_chars`` characters, each
shard is one broadcast and one pass, and shard results are combined per row.
A word outside the shard's vocabulary ends every match, so only runs of known
words at least as long as the shortest window are walked in Python.

Defined cases: a null or empty text has no words and is clean; a null or empty
item has no window; repeated items are reported under each of their ids;
repeated documents give one row each; an empty benchmark leaves all clean;
columns beyond ids and texts are ignored here and kept by ``remove`` and ``cut``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .store import free_name, tidy, written

WINDOW = 13
SHARD_CHARS = 8_000_000


class Automaton:
    """Generalised suffix automaton of word-id sequences.

    ``next`` transitions, ``link`` suffix links, ``size`` longest length per
    state. ``items`` maps a state to the items whose whole short text or whose
    ``window`` words it stands for (filled by :meth:`mark`)."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.items: dict[int, set] = {}
        self.shorter: list[int] = []

    def _state(self, size: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """State for exactly the strings of ``q`` that are one word longer than ``p``."""
        if self.size[q] == self.size[p] + 1:
            return q
        c = self._state(self.size[p] + 1)
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
                continue
            new, p = self._state(self.size[last] + 1), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            self.link[new] = 0 if p < 0 else self._split(p, word, self.next[p][word])
            last = new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """Longest matched passage after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.size[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, length + 1)

    def _holder(self, state: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def mark(self, sequences: list[tuple[object, list[int]]], window: int) -> None:
        """Note which items each window (or whole shorter item) belongs to."""
        short: dict[int, int] = {}
        for item, sequence in sequences:
            state, length, least = 0, 0, min(window, len(sequence))
            for word in sequence:
                state, length = self.step(state, length, word)
                if length >= least:
                    at = self._holder(state, least)
                    self.items.setdefault((at, least), set()).add(item)
                    if least < window:
                        short.setdefault(at, set()).add(least)
                    if length > window:  # keep the walk on passages of window size
                        state, length = self._holder(state, window), window
        # nearest state up the links (itself included) that ends a short item
        self.short = short
        order = sorted(range(len(self.size)), key=self.size.__getitem__)
        self.shorter = [-1] * len(self.size)
        for s in order[1:]:
            self.shorter[s] = s if s in short else self.shorter[self.link[s]]

    def hits(self, run: list[int], window: int) -> Iterator[tuple[int, int, tuple]]:
        """(end word, window length, key of ``items``) of every occurrence."""
        state = length = 0
        for i, word in enumerate(run):
            state, length = self.step(state, length, word)
            if length >= window:
                at = self._holder(state, window)
                if (at, window) in self.items:
                    yield i + 1, window, (at, window)
                state, length = at, window
            s = self.shorter[state] if self.shorter else -1
            while s >= 0:
                for least in self.short[s]:
                    if least <= length:
                        yield i + 1, least, (s, least)
                s = self.shorter[self.link[s]]


class Shard:
    """Automaton of some items with the vocabulary that leads to it."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        texts = W.text_array(pa.array([t for _, t in items], type=pa.string()))
        found = [np.zeros(0, dtype=W.U)] * len(items)
        for i, _, raw, offs in W.blocks(texts):
            w = W.Words(W.LOWER[raw], offs, W.NON_ALNUM)
            h = w.hashes()
            for k in range(len(offs) - 1):
                found[i + k] = h[w.first[k] : w.first[k + 1]]
        self.words = np.unique(np.concatenate([np.zeros(0, dtype=W.U), *found]))
        sequences = [(item, (np.searchsorted(self.words, h) + 1).tolist()) for (item, _), h in zip(items, found) if len(h)]
        self.window = window
        self.least = min([window, *(len(s) for _, s in sequences)])
        self.automaton = Automaton()
        for _, s in sequences:
            self.automaton.add(s)
        self.automaton.mark(sequences, window)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary id of every word, 0 for a word that no item has."""
        if not len(self.words):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, 0)


def _search(shard: Shard, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray | None, set]]:
    """Per text: row, words, hit mask (None: no hit) and the items that occur."""
    for i, j, raw, offs in W.blocks(texts):
        w = W.Words(W.LOWER[raw], offs, W.NON_ALNUM)
        ids = shard.ids(w.hashes())
        known = ids > 0
        edge = np.zeros(len(ids) + 1, dtype=bool)
        edge[w.first] = True
        if len(ids):
            begin = known.copy()
            begin[1:] &= ~known[:-1] | edge[1:-1]
            end = known.copy()
            end[:-1] &= ~known[1:] | edge[1:-1]
            a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
            long = b - a >= shard.least
            a, b = a[long], b[long]
        else:
            a = b = np.zeros(0, dtype=np.int64)
        masks: dict[int, np.ndarray] = {}
        items: dict[int, set] = {}
        for s, e in zip(a.tolist(), b.tolist()):
            row = int(w.doc[s])
            for at, length, key in shard.automaton.hits(ids[s:e].tolist(), shard.window):
                mask = masks.get(row)
                if mask is None:
                    mask = masks[row] = np.zeros(w.count[row], dtype=bool)
                to = s - w.first[row] + at
                mask[to - length : to] = True
                items.setdefault(row, set()).update(shard.automaton.items[key])
        for row in range(j - i):
            yield i + row, int(w.count[row]), masks.get(row), items.get(row, set())


def _shards(benchmark: DataFrame, window: int, shard_chars: int, item_col: str, text_col: str) -> Iterator[Shard]:
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-int(chars) // shard_chars))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield Shard([(r["item"], r["text"]) for r in part.collect()], window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5, shard_chars: int = SHARD_CHARS,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted array),
    spans (hit ranges ``[from, to)`` in words), text_hash, contaminated
    (n_hit > 0 and 100 * n_hit >= percent * n_words)."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    found = None
    for shard, more in _marked_last(_shards(benchmark, window, shard_chars, item_col, "text")):
        held = docs.sparkSession.sparkContext.broadcast(shard)
        part = base.mapInArrow(tidy(_task(held)), _shape(base))
        if found is None and not more:
            break
        # one of several shards: keep its hits (equal rows have equal hits) and let the automaton go
        part = written(part.where("size(items) > 0").dropDuplicates(["doc_id", "th"]), "hits")
        found = part if found is None else found.unionByName(part)
        held.unpersist()
    if found is not None:
        each = found.groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                                                 F.flatten(F.collect_list("spans")).alias("spans")).withColumnRenamed("doc_id", "id_")
        part = base.join(each.withColumnRenamed("th", "th_"), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")), "left").select(
            "doc_id", "text", "th", "items", "spans").mapInArrow(_merged, _shape(base))
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return part.select("doc_id", "n_words", length.alias("n_hit"), "items", "spans", F.col("th").alias("text_hash")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))


def _marked_last(shards: Iterator[Shard]) -> Iterator[tuple[Shard, bool]]:
    """Each shard with whether another one follows; one is held at a time."""
    last = next(shards)
    for shard in shards:
        yield last, True
        last = shard
    yield last, False


def _shape(base: DataFrame) -> str:
    return f"doc_id {base.schema['doc_id'].dataType.simpleString()}, th long, n_words long, items array<string>, spans array<struct<from:long,to:long>>"


_SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def _batch(ids, th, n_words, items, spans) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, th, pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)],
                                      ["doc_id", "th", "n_words", "items", "spans"])


def _task(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_search(held.value, W.text_array(batch.column(1))))
            yield _batch(batch.column(0), batch.column(2), [n for _, n, _, _ in rows], [sorted(x) for *_, x in rows],
                         [[] if m is None else _ranges(m) for _, _, m, _ in rows])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts, and the spans of several shards as one set of ranges."""
    for batch in batches:
        n_words, spans = [], []
        texts = W.text_array(batch.column(1))
        for _, _, raw, offs in W.blocks(texts):
            n_words += W.Words(W.LOWER[raw], offs, W.NON_ALNUM).count.tolist()
        for n, found in zip(n_words, batch.column(4).to_pylist()):
            mask = np.zeros(n if found else 0, dtype=bool)
            for s in found or []:
                mask[s["from"] : s["to"]] = True
            spans.append(_ranges(mask))
        items = [x or [] for x in batch.column(3).to_pylist()]
        yield _batch(batch.column(0), batch.column(2), n_words, items, spans)


def _ranges(mask: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return [{"from": int(a), "to": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def remove(docs: DataFrame, benchmark: DataFrame, percent: int = 5, window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Documents whose coverage stays below the limit, columns unchanged."""
    shards = _marked_last(_shards(benchmark, window, shard_chars, "item_id", "text"))
    shard, more = next(shards)
    if more:
        own, th = free_name(docs.columns, "_id"), free_name(docs.columns, "_th")
        bad = contamination(docs, benchmark, window, percent, shard_chars).where("contaminated").select(
            F.col("doc_id").alias(own), F.col("text_hash").alias(th)).distinct()
        return docs.join(written(bad, "contaminated"), F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(th)), "left_anti")
    held, at = docs.sparkSession.sparkContext.broadcast(shard), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            rows = list(_search(held.value, W.text_array(batch.column(at))))
            count = np.array([n for _, n, _, _ in rows], dtype=np.int64)
            hit = np.array([0 if m is None else int(m.sum()) for _, _, m, _ in rows], dtype=np.int64)
            yield batch.filter(pa.array((hit == 0) | (100 * hit < percent * count)))

    return docs.mapInArrow(tidy(run), docs.schema)


def cut(docs: DataFrame, benchmark: DataFrame, limit: int = WINDOW - 1, window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``docs`` with the hit spans of more than ``limit`` words cut from
    ``text``, from a span's first byte to its last; what is outside the spans
    and the other columns stay as they are. Words that meet over a cut are not
    searched again."""
    shards = _marked_last(_shards(benchmark, window, shard_chars, "item_id", "text"))
    shard, more = next(shards)
    names, joined, held = docs.columns, docs, None
    at = names.index("text")
    if more:
        own, th, marks = (free_name(docs.columns, c) for c in ("_id", "_th", "_spans"))
        found = contamination(docs, benchmark, window, shard_chars=shard_chars).where("size(spans) > 0").select(
            F.col("doc_id").alias(own), F.col("text_hash").alias(th), F.col("spans").alias(marks)).dropDuplicates([own, th])
        same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(th))
        joined = docs.join(written(found, "spans"), same, "left").select(*(F.col(f"`{c}`") for c in docs.columns), marks)
    else:
        held = docs.sparkSession.sparkContext.broadcast(shard)

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            if held is None:
                spans = [s or [] for s in batch.column(batch.num_columns - 1).to_pylist()]
            else:
                spans = [[] if m is None else _ranges(m) for _, _, m, _ in _search(held.value, W.text_array(column))]
            over = [[(s["from"], s["to"]) for s in x if s["to"] - s["from"] > limit] for x in spans]
            new = [_without(t, x) if x else t for t, x in zip(column.to_pylist(), over)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == at else batch.column(c) for c in range(len(names))], names)

    return joined.mapInArrow(tidy(run), docs.schema)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans, which are in words."""
    raw = text.encode()
    w = W.Words(W.LOWER[np.frombuffer(raw, dtype=np.uint8)], np.array([0, len(raw)]), W.NON_ALNUM)
    ends = [0, *(int(w.end[b - 1]) for _, b in spans)]
    return b"".join(raw[a:b] for a, b in zip(ends, [*(int(w.start[a]) for a, _ in spans), len(raw)])).decode()


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from :func:`contamination`'s."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
wind AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
         FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM wind),
doc AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
occ AS (SELECT d.doc_id, d.i, d.size, wind.item
        FROM (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
              FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, sizes WHERE len(w) >= size)) d
        JOIN wind ON wind.win = d.win AND wind.size = d.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
