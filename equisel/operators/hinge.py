"""Linear machines with hinge loss, one class against the rest, in joint passes.

``LinearSVC`` reads its rows once for every point that its line search looks at,
and ``OneVsRest`` does so for one class after the other: on rows that no line
parts, over a thousand Spark jobs for three classes. Here the rows are standardised
and packed into blocks once. A pass then gives loss and gradient at all points that
any class asks for, among them the next lengths of a line search, which are known
beforehand. The loss, the L2 term on standardised weights, the free intercept, the
step limit and the tolerance are those of ``LinearSVC``; the steps (L-BFGS,
bisecting search) are not its own, so weights agree with its own to the tolerance
only. A fit ends when the last 20 values differ by the tolerance at most.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in a packed block, blocks' bytes for a task, rows that a task looks at together.
BLOCK, TASK_BYTES, ROWS = 1 << 17, 4 << 20, 4096
#: Numbers that one task may send for a pass, and that all tasks may send to the driver.
MAX_NUMBERS, MAX_SENT = 1_000_000, 4_000_000
#: Lengths that a line search tries, steps that the direction remembers.
SEARCHED, MEMORY = 30, 10


class _NoStep(Exception):
    """No length lowers the value."""


def _direction(grad: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """L-BFGS direction; ``history``: steps and changes of the gradient, latest first."""
    scale = 1.0
    if history:
        s, y = history[0]
        scale = (s @ y) / (y @ y)
    out, used = grad.copy(), []
    for s, y in history:
        a = (s @ out) / (rho := s @ y)
        used.append((a, rho))
        out -= a * y
    out *= scale
    for (s, y), (a, rho) in zip(reversed(history), reversed(used), strict=True):
        out += (a - (y @ out) / rho) * s
    return -out


def _ahead(low: float, high: float, length: float) -> list[float]:
    """The length to look at, then those that its outcome may ask for next."""
    if high == math.inf:
        return [length, 2 * length, 4 * length, length / 2, length / 4]
    out, parts = [], [(low, high)]
    for _ in range(3):
        out += [(a + b) / 2 for a, b in parts]
        parts = [half for a, b in parts for half in ((a, (a + b) / 2), ((a + b) / 2, b))]
    return out


def minimiser(size: int, limit: int, tol: float, most: int = 7) -> Generator[list[np.ndarray], list[tuple[float, np.ndarray]], np.ndarray]:
    """Minimises a convex function with kinks from 0 (L-BFGS with the bisecting
    search of Lewis and Overton). Yields the points to look at (``most`` at
    once), is sent (value, gradient) of each, and returns the last point."""
    x = np.zeros(size)
    ((value, grad),) = yield [x]
    first, steps, values, history, failed = value, 0, [math.inf], [], False
    while True:
        level = len(values) > 1 and abs(value - max(values)) <= tol * first
        if steps >= limit or level or np.linalg.norm(grad) <= max(tol * value, 1e-8):
            return x
        try:
            way = _direction(grad, history)
            slope, known = float(grad @ way), {}
            if not slope < 0:
                raise _NoStep
            low, high, length = 0.0, math.inf, 1.0 if history else 0.5 / float(np.linalg.norm(grad))
            for _ in range(SEARCHED):
                if length not in known:
                    lengths = _ahead(low, high, length)[:most]
                    at = [x + a * way for a in lengths]
                    known |= {a: (p, *got) for a, p, got in zip(lengths, at, (yield at), strict=True)}
                new, lower, new_grad = known[length]
                if lower > value + 1e-4 * length * slope:
                    high = length
                elif float(new_grad @ way) < 0.9 * slope:
                    low = length
                else:
                    break
                length = (low + high) / 2 if high < math.inf else 2 * low
            else:
                new, lower, new_grad = min(known.values(), key=lambda k: k[1])  # at a kink: the lowest point seen
                if not lower < value:
                    raise _NoStep
        except _NoStep:
            if failed or not history:
                return x
            failed, history = True, []
            continue
        if (new - x) @ (new_grad - grad) > 0:
            history = [(new - x, new_grad - grad), *history][:MEMORY]
        x, value, grad = new, lower, new_grad
        steps, values, failed = steps + 1, [*values, value][-20:], False


def _blocks(train: DataFrame, features: str, label: str, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """Rows of bytes: a matrix with the standardised features, a constant and the label."""
    width = len(mean) + 2
    rows = max(1, BLOCK // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            m = np.concatenate([(x - mean) * scale, np.ones((len(y), 1)), y[:, None]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([m[a : a + rows].tobytes() for a in range(0, len(m), rows)], pa.binary())], ["block"])

    return train.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).mapInArrow(run, "block binary")


def _pass(blocks: DataFrame, tasks: int, asked: dict[int, list[np.ndarray]], size: int) -> dict[int, np.ndarray]:
    """For every class the summed hinge loss and its gradient at the points asked for."""
    points = {k: np.stack(p, axis=1) for k, p in asked.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((size + 1, w.shape[1])) for k, w in points.items()}
        for batch in batches:
            for block in batch.column(0):
                whole = np.frombuffer(block.as_buffer(), dtype=np.float64).reshape(-1, size + 1)
                for a in range(0, len(whole), ROWS):
                    part = whole[a : a + ROWS]
                    for k, w in points.items():
                        t = part[:, :-1] * np.where(part[:, -1] == k, 1.0, -1.0)[:, None]
                        slack = t @ w
                        np.subtract(1.0, slack, out=slack)
                        np.maximum(slack, 0.0, out=slack)
                        total[k][0] += slack.sum(axis=0)
                        total[k][1:] -= t.T @ (slack > 0).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.ravel() for v in total.values()], pa.list_(pa.float64()))], ["class", "part"])

    def added(t: pa.Table) -> pa.Table:
        parts = t.column("part").combine_chunks()
        parts = parts.flatten().to_numpy(zero_copy_only=False).reshape(len(parts), -1)
        return pa.table({"class": t.column("class").slice(0, 1), "part": pa.array([parts.sum(axis=0)], pa.list_(pa.float64()))})

    schema = "`class` int, part array<double>"
    sums = blocks.mapInArrow(run, schema)
    if tasks * (size + 1) * sum(w.shape[1] for w in points.values()) > MAX_SENT:
        sums = sums.groupBy("class").applyInArrow(added, schema)
    out = {k: np.zeros((size + 1, w.shape[1])) for k, w in points.items()}
    for r in sums.collect():  # a row for each class, and for each task where these are small
        out[r["class"]] += np.array(r["part"]).reshape(size + 1, -1)
    return out


def fit_machines(train: DataFrame, n: int, n_classes: int, mean: np.ndarray, std: np.ndarray, reg: float, features: str, label: str,
                 limit: int, tol: float) -> list[tuple[np.ndarray, float]]:
    """(coefficients, intercept) of each class against the rest; ``mean`` and
    ``std`` are those of the ``n`` train rows."""
    scale = np.divide(1.0, std, out=np.zeros_like(std), where=std != 0)
    size = len(mean) + 1
    tasks = max(1, math.ceil(n * (size + 1) * 8 / TASK_BYTES))
    ridge = np.append(np.full(size - 1, reg), 0.0)  # the intercept is free
    blocks = _blocks(train, features, label, mean, scale).coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        running = {k: minimiser(size, limit, tol, max(1, MAX_NUMBERS // (n_classes * (size + 1)))) for k in range(n_classes)}
        asked, found = {k: next(g) for k, g in running.items()}, {}
        while asked:
            sums = _pass(blocks, tasks, asked, size)
            for k, points in list(asked.items()):
                got = [(float(s[0]) / n + 0.5 * float(ridge @ p**2), s[1:] / n + ridge * p) for p, s in zip(points, sums[k].T, strict=True)]
                try:
                    asked[k] = running[k].send(got)
                except StopIteration as e:
                    found[k] = e.value
                    del asked[k]
    finally:
        blocks.unpersist()
    return [(w[:-1] * scale, float(w[-1] - (w[:-1] * scale) @ mean)) for w in (found[k] for k in range(n_classes))]
