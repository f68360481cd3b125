"""Quality scores by positive-unlabelled learning.

Trusted positives (documents labelled good in the learning fold) and unlabelled
web text (everything else) train a linear model on shape features of the whole
text. The loss is the non-negative unbiased risk (Kiryo et al., 2017) with
sigmoid loss, ``prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])``,
minimised by Adam steps; where the second part turns negative the step goes
back along its own gradient. E_u runs over all documents. The class prior is
estimated from scores alone: the least ratio of unlabelled to positive
documents above a threshold, with a confidence margin (best-bin estimate),
from a first convex fit of positives against all.

Scale: features are formed once, map-side, and written (a few hundred bytes a
document, never the text); every step is one pass with map-side sums over all
documents, and a few thousand sums reach the driver. Labels are joined to the
features. Negative labels are not used.

Defined cases: null and empty texts have the features of an empty text and get
a score like any other; a document with several labels counts as positive if
one is; rows are scored each by its text; without positives all scores are the
prior's start value; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .store import written

STEPS = 50
RATE = 0.15
FIRST_STEPS = 6
FIRST_RIDGE = 1e-2
RIDGE = 1e-4
CLIP = 6.0
#: Byte groups whose shares are features.
GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b"\t", b".", b",", b"!", b"?", b";:",
          b"'\"`", b"-_", b"|", b"*", b"#", b"$", b"%", b"&", b"@", b"<>", b"{}[]()", b"=+~^", b"/\\"]


def features(texts: pa.Array) -> np.ndarray:
    """One row of shape features per text (float32)."""
    group = np.zeros((256, len(GROUPS) + 2))
    for i, g in enumerate(GROUPS):
        group[list(g), i] = 1
    group[128:, -2] = 1
    group[group.sum(axis=1) == 0, -1] = 1
    out = []
    for _, _, raw, offs in W.blocks(texts):
        w = W.Words(raw, offs, W.WHITE)
        h = w.hashes()
        four = W.runs(h, 4)
        size = w.end - w.start
        head, tail = raw[w.start], raw[w.end - 1]
        upper = (head >= 65) & (head <= 90)
        shout = upper & (size > 1) & (raw[np.minimum(w.start + 1, len(raw) - 1)] >= 65) & (raw[np.minimum(w.start + 1, len(raw) - 1)] <= 90)
        letter = np.zeros(256, dtype=bool)
        letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
        odd_end = ~letter[tail] & ~np.isin(tail, np.frombuffer(b".,!?;:", dtype=np.uint8))
        odd = (~letter[head] & ~odd_end) | odd_end
        sums = [np.concatenate([[0], np.cumsum(x, dtype=np.float64)]) for x in (size, size * size, upper, shout, odd, size == 1, size > 20)]
        data = raw.tobytes()
        for d in range(len(offs) - 1):
            a, b, f, n = int(offs[d]), int(offs[d + 1]), int(w.first[d]), int(w.count[d])
            size_d = max(1, b - a)
            count = np.bincount(raw[a:b], minlength=256)
            share = count @ group / size_d
            per = [(s[f + n] - s[f]) / max(1, n) for s in sums]
            distinct = len(np.unique(h[f : f + n])) / max(1, n)
            grams = four[f : f + n - 3] if n > 3 else four[:0]
            again = 1 - len(np.unique(grams)) / len(grams) if len(grams) else 0.0
            lines = data[a:b].split(b"\n")
            same = 1 - len(set(lines)) / len(lines)
            spread = count[count > 0] / size_d
            entropy = float(-(spread * np.log(spread)).sum())
            out.append([*np.sqrt(share), *per[:1], max(0.0, per[1] - per[0] ** 2) ** 0.5, *per[2:], distinct, again, np.sqrt(again), same,
                        np.sqrt(same), entropy, np.log1p(b - a), np.log1p(n), n / size_d, np.log1p(len(lines)), np.log1p(n / len(lines)),
                        len(zlib.compress(data[a:b], 1)) / (size_d + 16)])
    width = len(GROUPS) + 2 + 7 + 12
    return np.array(out, dtype=np.float32).reshape(len(out), width)


def learning_fold(id_col: str = "doc_id"):
    """Rows whose labels may be learned from."""
    return ~held_out(id_col)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id and x, the features as float32 bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                x = features(W.text_array(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x binary")


def _matrix(column) -> np.ndarray:
    """The rows of a column of equally long float32 bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(len(column), -1).astype(np.float64)


def _sums(table: DataFrame, task) -> np.ndarray:
    """Sum over all rows of the vector that ``task(x, positive)`` gives for a
    batch: one vector a task, added up in a second stage."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                v = task(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    rows = table.select("x", "positive").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class Scaler:
    """Standardised and clipped features, their squares and a constant."""

    def __init__(self, mean, deviation):
        self.mean, self.deviation = mean, deviation + 1e-6

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -CLIP, CLIP)
        return np.concatenate([z, z * z / CLIP, np.ones((len(z), 1))], axis=1)


def estimate_prior(positive: np.ndarray, every: np.ndarray, n_positive: float, n_every: float, risk: float = 0.1) -> float:
    """Share of positives, from the tails of both score histograms (shares of
    documents at or above each threshold)."""
    margin = np.sqrt(np.log(4 / risk) / 2 / max(n_positive, 1)) + np.sqrt(np.log(4 / risk) / 2 / max(n_every, 1))
    bound = np.where(positive >= min(0.5, max(0.02, 50 / max(n_positive, 1))), (every + margin) / np.maximum(positive, 1e-12), np.inf)
    best = int(np.argmin(bound))
    return float(np.clip(every[best] / max(positive[best], 1e-12), 0.01, 0.99))


def fit(table: DataFrame, steps: int = STEPS) -> tuple[Scaler, np.ndarray, float]:
    """(scaler, weights, prior) from rows (x, positive)."""
    first = _sums(table, lambda x, p: np.concatenate([[len(x), p.sum()], x.sum(0), (x * x).sum(0)]))
    if not len(first):
        return Scaler(0.0, 1.0), np.zeros(1), 0.5
    n, n_pos = first[:2]
    d = (len(first) - 2) // 2
    mean = first[2 : 2 + d] / n
    scale = Scaler(mean, np.sqrt(np.maximum(first[2 + d :] / n - mean**2, 0)))
    w = np.zeros(2 * d + 1)
    if not n_pos:
        return scale, w, 0.5

    def newton(w):
        def task(x, pos):
            z = scale(x)
            g, h = np.zeros(len(w)), np.zeros((len(w), len(w)))
            for rows, target, weight in ((z[pos], 1.0, 0.5 / n_pos), (z, 0.0, 0.5 / n)):
                q = _sigmoid(rows @ w)
                g += weight * (rows.T @ (q - target))
                h += weight * ((rows * (q * (1 - q))[:, None]).T @ rows)
            return np.concatenate([g, h.ravel()])

        return task

    for _ in range(FIRST_STEPS):
        s = _sums(table, newton(w))
        g, h = s[: len(w)], s[len(w) :].reshape(len(w), len(w))
        w = w - np.linalg.solve(h + FIRST_RIDGE * np.eye(len(w)), g + FIRST_RIDGE * w)

    edges = np.linspace(-12, 12, 961)

    def histogram(x, pos, w=w):
        at = np.searchsorted(edges, scale(x) @ w)
        return np.concatenate([np.bincount(at[pos], minlength=len(edges) + 1), np.bincount(at, minlength=len(edges) + 1)]).astype(float)

    bins = _sums(table, histogram).reshape(2, -1)[:, ::-1].cumsum(axis=1)
    prior = estimate_prior(bins[0] / n_pos, bins[1] / n, n_pos, n)

    w = np.zeros(2 * d + 1)
    m = v = np.zeros(len(w))
    ridge = max(RIDGE, 0.5 / n_pos)
    for t in range(1, steps + 1):

        def task(x, pos, w=w):
            z = scale(x)
            q = _sigmoid(z @ w)
            slope = q * (1 - q)
            return np.concatenate([[q[pos].sum(), q.sum()], z[pos].T @ slope[pos], z.T @ slope])

        s = _sums(table, task)
        grad_pos, grad_all = s[2 : 2 + len(w)] / n_pos, s[2 + len(w) :] / n
        negative_part = s[1] / n - prior * s[0] / n_pos
        part = grad_all - prior * grad_pos
        g = (part - prior * grad_pos if negative_part >= 0 else -part) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return scale, w, prior


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
           steps: int = STEPS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    trusted = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where("label = 1").where(
        learning_fold("doc_id")).select("doc_id", F.lit(True).alias("positive")).distinct()
    table = feature_table(base).join(trusted, "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    table = written(table, "features")
    scale, w, prior = fit(table, steps)
    kind = table.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _sigmoid(scale(_matrix(batch.column(1))) @ w) if w.any() else np.full(batch.num_rows, prior)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    out = table.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
