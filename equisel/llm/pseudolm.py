"""Masked pseudo-likelihood scores.

A network with a window on both sides predicts every token from its
neighbours: position-weighted embeddings of ``SPAN`` tokens to the left and to
the right, a tanh layer, and a softmax in two steps (group, then token in the
group). A document's score is the sum of the conditional log-probabilities of
its tokens (pseudo-log-likelihood; Salazar et al., 2020) and their mean.

Tokens are lower-case words; the most frequent have an id each, the others
share hash buckets. A bucket word's probability is its bucket's times the
word's share of the bucket's count (:func:`likelihoods`; :func:`scored` leaves
the share out and scores ids). Word counts come from all documents. Every
position of every document is a training target once, in one of ``ROUNDS``
passes by hash; its own word is never an input. Every task trains in numpy on
its documents from the common parameters, and the parameters are averaged by
tokens (two levels, so the driver receives about the square root of the number
of tasks).

Scale: passes are map-side; word counts, parameter vectors and, to look up
counts, the rarer words of each document are shuffled. A word with at least
1 / ``HELD`` of all tokens is looked up in the task, so no joined word is hot.
The network's size is a parameter and does not follow the corpus.

Defined cases: null and empty texts have no tokens, log-likelihood 0 and a null
mean; a repeated row gets the same score again; neighbours beyond the text's ends are a
padding token; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .store import written

GROUPS = 32
PER_GROUP = 32
BUCKETS = 256
WIDTH = 16
SPAN = 3
ROUNDS = 2
HELD = 1 << 18
BATCH = 8192
RATE = 0.01


def _shape(v: int) -> list[tuple[str, tuple]]:
    return [("embed", (v + 1, WIDTH)), ("place", (2 * SPAN, WIDTH)), ("shift", (WIDTH,)), ("group", (GROUPS, WIDTH)), ("group_bias", (GROUPS,)),
            ("token", (GROUPS, v // GROUPS, WIDTH)), ("token_bias", (GROUPS, v // GROUPS))]


class Network:
    """Parameters in one float32 vector, with views by name."""

    def __init__(self, v: int = GROUPS * PER_GROUP, flat: np.ndarray | None = None):
        self.v = v
        sizes = [int(np.prod(s)) for _, s in _shape(v)]
        self.flat = np.zeros(sum(sizes), dtype=np.float32) if flat is None else flat
        at = 0
        for (name, shape), n in zip(_shape(v), sizes):
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, counts: np.ndarray) -> "Network":
        """Small seeded weights; biases that give each token its frequency."""
        net, rng = cls(len(counts)), np.random.default_rng(7)
        net.embed[:] = rng.normal(0, 0.1, net.embed.shape)
        net.place[:] = 1.0 / SPAN
        net.token[:] = rng.normal(0, 0.1, net.token.shape)
        net.group[:] = rng.normal(0, 0.1, net.group.shape)
        by = (counts + 1.0).reshape(-1, GROUPS).T  # token id = slot * GROUPS + group
        net.group_bias[:] = np.log(by.sum(axis=1) / by.sum())
        net.token_bias[:] = np.log(by / by.sum(axis=1, keepdims=True))
        return net

    def hidden(self, around: np.ndarray) -> np.ndarray:
        z = np.repeat(self.shift[None, :], around.shape[1], axis=0)
        for k in range(len(around)):
            z += (self.embed * self.place[k])[around[k]]
        return np.tanh(z, out=z)

    def scores(self, around: np.ndarray, target: np.ndarray, grads: "Network | None" = None) -> np.ndarray:
        """Log-probability of each target; adds the gradient of their negative
        sum to ``grads``. Rows are taken in the order of their groups."""
        order = _order(target % GROUPS, GROUPS)
        around, target = around[:, order], target[order]
        h = self.hidden(around)
        g, slot = target % GROUPS, target // GROUPS
        rows = np.arange(len(target))
        p = h @ self.group.T
        p += self.group_bias
        p -= p.max(axis=1, keepdims=True)
        out = p[rows, g]
        np.exp(p, out=p)
        total = p.sum(axis=1)
        out -= np.log(total)
        dh = None
        if grads is not None:
            p /= total[:, None]
            p[rows, g] -= 1
            grads.group += p.T @ h
            grads.group_bias += p.sum(axis=0)
            dh = p @ self.group
        cut = np.searchsorted(g, np.arange(GROUPS + 1)).tolist()
        for k in range(GROUPS):
            a, b = cut[k], cut[k + 1]
            if a == b:
                continue
            own = h[a:b]
            q = own @ self.token[k].T
            q += self.token_bias[k]
            q -= q.max(axis=1, keepdims=True)
            mine = rows[: b - a]
            out[a:b] += q[mine, slot[a:b]]
            np.exp(q, out=q)
            q_total = total[a:b] = q.sum(axis=1)
            if dh is not None:
                q /= q_total[:, None]
                q[mine, slot[a:b]] -= 1
                grads.token[k] += q.T @ own
                grads.token_bias[k] += q.sum(axis=0)
                dh[a:b] += q @ self.token[k]
        out -= np.log(total)
        if dh is not None:
            dz = dh * (1 - h * h)
            grads.shift += dz.sum(axis=0)
            for k in range(len(around)):
                ids = _order(around[k], self.v + 1)
                found = around[k][ids]
                first = np.flatnonzero(np.diff(found, prepend=-1))
                used, part = found[first], np.add.reduceat(dz[ids], first, axis=0)
                grads.place[k] += (self.embed[used] * part).sum(axis=0)
                grads.embed[used] += part * self.place[k]
        back = np.empty_like(out)
        back[order] = out
        return back


def _order(ids: np.ndarray, n: int) -> np.ndarray:
    """Stable order of ids below ``n``; 16 bits are sorted by digits."""
    return np.argsort(ids.astype(np.uint16) if n <= 1 << 16 else ids, kind="stable")


class Vocabulary:
    """Ids of word hashes: frequent words first, then hash buckets."""

    def __init__(self, hashes: np.ndarray, v: int):
        order = np.argsort(hashes)
        self.hashes, self.ids, self.v = hashes[order], order, v

    def of(self, h: np.ndarray) -> np.ndarray:
        rare = (self.v - BUCKETS) + (h % W.U(BUCKETS)).astype(np.int64)
        if not len(self.hashes):
            return rare
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ids[at], rare)


class Shares:
    """Log share of a bucket word in its bucket's count, for the words that
    ``hashes`` and ``n`` list; for others without the log of their own count."""

    def __init__(self, hashes: np.ndarray, n: np.ndarray, buckets: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.logs, self.buckets = hashes[order], np.log(n[order]), np.log(np.maximum(buckets, 1))

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log share of every hash, and which hashes are not listed."""
        out = -self.buckets[(h % W.U(BUCKETS)).astype(np.int64)]
        if not len(self.hashes):
            return out, np.ones(len(h), dtype=bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        out[known] += self.logs[at[known]]
        return out, ~known


def _tokens(texts: pa.Array) -> Iterator[tuple[int, W.Words, np.ndarray]]:
    for i, _, raw, offs in W.blocks(texts):
        w = W.Words(W.LOWER[raw], offs, W.NON_ALNUM)
        yield i, w, w.hashes()


def around(ids: np.ndarray, doc: np.ndarray, at: np.ndarray, pad: int) -> np.ndarray:
    """Neighbour ids of the positions ``at``, one row for each place in the
    window; ``pad`` beyond the document."""
    out = np.full((2 * SPAN, len(at)), pad, dtype=np.int64)
    for k, shift in enumerate([*range(-SPAN, 0), *range(1, SPAN + 1)]):
        to = at + shift
        ok = (to >= 0) & (to < len(ids))
        to = np.clip(to, 0, max(0, len(ids) - 1))
        ok &= doc[to] == doc[at]
        out[k, ok] = ids[to[ok]]
    return out


def turns(w: W.Words, h: np.ndarray, rounds: int) -> np.ndarray:
    """The round in which each position is a target, by its word and its place
    in the document."""
    place = np.arange(len(h)) - np.repeat(w.first[:-1], w.count)
    return W.mix(h + place.astype(W.U) * W.U(0x9E3779B97F4A7C15)) % W.U(rounds)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, n) of every word hash, summed in each task first."""

    def merged(parts):
        h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        keys, back = np.unique(h, return_inverse=True)
        return keys, np.bincount(back, weights=n).astype(np.int64)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for _, _, h in _tokens(W.text_array(batch.column(0))):
                if len(h):
                    parts.append(np.unique(h, return_counts=True))
                    held += len(parts[-1][0])
                if held > 1_000_000:
                    keys, n = merged(parts)
                    parts, held = [(keys, n)], len(keys)
                    if held > 500_000:
                        yield _rows(keys, n)
                        parts, held = [], 0
        if parts:
            yield _rows(*merged(parts))

    def _rows(keys, n):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _mean(vectors: DataFrame, tasks: int) -> np.ndarray | None:
    """Mean of the tasks' parameter vectors by weight, on two levels."""

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("task").to_pylist(), table.column("weight").to_pylist(), table.column("flat").to_pylist()))
        total = sum(np.frombuffer(f, dtype=np.float64) for _, _, f in rows)
        return pa.table({"task": pa.array([rows[0][0]], pa.int64()), "weight": pa.array([sum(w for _, w, _ in rows)]),
                         "flat": pa.array([total.tobytes()], pa.binary())})

    some = F.pmod(F.col("task"), F.lit(max(1, int(tasks**0.5))))
    rows = vectors.groupBy(some.alias("some")).applyInArrow(add, vectors.schema).collect()
    weight = sum(r["weight"] for r in rows)
    if not weight:
        return None
    return (sum(np.frombuffer(r["flat"], dtype=np.float64) for r in sorted(rows, key=lambda r: r["task"])) / weight).astype(np.float32)


def train(docs: DataFrame, rounds: int = ROUNDS, groups: int = GROUPS, per_group: int = PER_GROUP) -> tuple[Vocabulary, Network, DataFrame, np.ndarray]:
    """Vocabulary and network from all texts of ``docs`` (column text), the
    written count table (h, n) of all words and the count of every id."""
    v = groups * per_group
    counted = written(word_counts(docs), "counts")
    top = counted.orderBy(F.desc("n"), "h").limit(v - BUCKETS).collect()
    frequent = np.array([r["h"] for r in top], dtype=np.int64).view(W.U)
    vocabulary = Vocabulary(frequent, v)
    counts = np.zeros(v)
    counts[: len(top)] = [r["n"] for r in top]
    # int64 remainder of the unsigned hash: BUCKETS is a power of two
    rare = counted.join(F.broadcast(counted.sparkSession.createDataFrame([(int(r["h"]),) for r in top], "h long")), "h", "left_anti")
    for r in rare.groupBy(F.col("h").bitwiseAND(BUCKETS - 1).alias("b")).agg(F.sum("n").alias("n")).collect():
        counts[v - BUCKETS + r["b"]] = r["n"]
    net = Network.start(counts)
    texts = docs.select("text")
    for turn in range(rounds):
        start, rate = net.flat, RATE / (1 + turn)

        def run(batches, start=start, rate=rate, turn=turn):
            own = Network(v, start.copy())
            step = _Adam(own, rate)
            held, seen = [], 0
            for batch in batches:
                for _, w, h in _tokens(W.text_array(batch.column(0))):
                    ids = vocabulary.of(h)
                    at = np.flatnonzero(turns(w, h, rounds) == turn)
                    if len(at):
                        held.append((around(ids, w.doc, at, v), ids[at]))
                        seen += len(at)
                    if sum(len(t) for _, t in held) >= BATCH:
                        held = step.over(held)
            step.over(held, last=True)
            if seen:
                flat = own.flat.astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(seen)]),
                                                  pa.array([flat.tobytes()], pa.binary())], ["task", "weight", "flat"])

        vectors = written(texts.mapInArrow(run, "task long, weight double, flat binary"), "parameters")
        mean = _mean(vectors, vectors.count())
        if mean is None:
            break
        net = Network(v, mean)
    return vocabulary, net, counted, counts


class _Adam:
    """Adam steps of one task on batches of targets."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.t = net, rate, 0
        self.m, self.s = np.zeros_like(net.flat), np.zeros_like(net.flat)

    def over(self, held: list, last: bool = False) -> list:
        if not held:
            return []
        ctx, target = np.concatenate([c for c, _ in held], axis=1), np.concatenate([t for _, t in held])
        stop = len(target) if last else len(target) - len(target) % BATCH
        for a in range(0, stop, BATCH):
            b = min(stop, a + BATCH)
            grads = Network(self.net.v)
            self.net.scores(ctx[:, a:b], target[a:b], grads)
            g = grads.flat / (b - a)
            self.t += 1
            self.m += 0.1 * (g - self.m)
            self.s += 0.01 * (g * g - self.s)
            self.net.flat -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.s / (1 - 0.99**self.t)) + 1e-6)
        return [(ctx[:, stop:], target[stop:])] if stop < len(target) else []


def _pass(base: DataFrame, vocabulary: Vocabulary, net: Network, shares: Shares | None = None) -> DataFrame:
    """Scores of the ids, one row per document. With ``shares``, also those of
    the words, a key ``row``, and the words (``h``) without a listed count with
    their number of occurrences (``times``), still to be added."""
    kind = base.schema["doc_id"].dataType.simpleString()
    held = base.sparkSession.sparkContext.broadcast((vocabulary, net.v, net.flat, shares))
    names = ["doc_id", "n_tokens", "log_likelihood"] + ["row", "h", "times"] * (shares is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, v, flat, shares = held.value
        own, row = Network(v, flat), TaskContext.get().partitionId() << 40
        for batch in batches:
            count, total = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
            size, rest = np.zeros(batch.num_rows, dtype=np.int64), []
            for i, w, h in _tokens(W.text_array(batch.column(1))):
                ids = known.of(h)
                for a in range(0, len(ids), 4 * BATCH):
                    at = np.arange(a, min(len(ids), a + 4 * BATCH))
                    logs = own.scores(around(ids, w.doc, at, v), ids[at]).astype(np.float64)
                    total[i : i + len(w.count)] += np.bincount(w.doc[at], weights=logs, minlength=len(w.count))
                count[i : i + len(w.count)] = w.count
                if shares is not None:
                    at = np.flatnonzero(ids >= v - BUCKETS)
                    logs, unlisted = shares.of(h[at])
                    total[i : i + len(w.count)] += np.bincount(w.doc[at], weights=logs, minlength=len(w.count))
                    doc, words, times = _distinct(w.doc[at[unlisted]], h[at[unlisted]])
                    size[i : i + len(w.count)] = np.bincount(doc, minlength=len(w.count))
                    rest.append((words, times))
            arrays = [batch.column(0), pa.array(count), pa.array(total)]
            if shares is not None:
                words, times = (np.concatenate([np.zeros(0, dtype=np.int64), *(x.view(np.int64) for x in c)]) for c in (zip(*rest) if rest else ((), ())))
                offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                arrays += [pa.array(row + np.arange(batch.num_rows)), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (words, times))]
                row += batch.num_rows
            yield pa.RecordBatch.from_arrays(arrays, names)

    return base.mapInArrow(run, f"doc_id {kind}, n_tokens long, log_likelihood double" + ", row long, h array<long>, times array<long>" * (shares is not None))


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, word) by document, with how often each occurs."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def _with_mean(out: DataFrame) -> DataFrame:
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def scored(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of the network's ids, one row per document: doc_id, n_tokens,
    log_likelihood, mean_log_prob. A bucket word counts as its whole bucket;
    see :func:`likelihoods` for the words themselves."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _with_mean(_pass(base, *train(base, rounds)[:2]))


def likelihoods(docs: DataFrame, rounds: int = ROUNDS, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of the words, one row per document: doc_id, n_tokens,
    log_likelihood, mean_log_prob. Words with at least 1 / ``held`` of all
    tokens (so at most ``held`` words) are looked up in the tasks, the others
    by a join with the count table."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary, net, counted, counts = train(base, rounds)
    listed = F.col("n") * F.lit(held) >= F.lit(int(counts.sum()))
    top = counted.where(listed).toArrow()
    shares = Shares(*(top.column(c).to_numpy().view(t) for c, t in (("h", W.U), ("n", np.int64))), counts[net.v - BUCKETS :])
    # written: the row keys below belong to this one pass
    each = written(_pass(base, vocabulary, net, shares), "scores")
    words = each.select("row", F.explode(F.arrays_zip("h", "times")).alias("w")).select("row", "w.h", "w.times")
    more = words.join(counted.where(~listed), "h").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("more"))
    whole = each.select("row", "doc_id", "n_tokens", "log_likelihood").join(more, "row", "left")
    return _with_mean(whole.select("doc_id", "n_tokens", (F.col("log_likelihood") + F.coalesce("more", F.lit(0.0))).alias("log_likelihood")))
