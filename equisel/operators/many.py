"""Training many model configurations over the same rows at once.

A study tries dozens of configurations on one train table. Fitted one by one,
each reads the table once per optimiser step. Here a step is one pass for all of
them: every task adds up the partial loss, gradient and (linear models)
curvature of every configuration that is still running, the parts are summed in
Spark, and the driver, which only ever holds weights, moves each configuration
with its own optimiser. A configuration leaves the passes when it has converged,
reached its step limit or was pruned. The passes needed are those of the slowest
configuration, not their sum, and a configuration's weights do not depend on the
others beside it.

Models (parameters as in the search space of H1):

* ``SVClinear``: L2-regularised squared hinge loss, Newton steps
* ``SVC``: the same on RBF kernel values with ``landmarks`` train rows
* ``LogisticRegression``: L2-regularised logistic loss, Newton steps
* ``Perceptron``: batch perceptron (M3), one epoch a pass
* ``MLPClassifier``: ReLU network, softmax loss with L2 ``alpha``, Adam on all rows

More than two classes: linear models train one machine per class against the
rest (M6); ``converged`` holds only if all of them converged.

Rows need ``x`` (array of doubles without nulls) and ``y`` (±1, or codes from 0).
"""

from __future__ import annotations

import ast
import bisect
import json
import time
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that one task may send for one pass.
MAX_NUMBERS = 8_000_000
LINEAR = ("SVClinear", "SVC", "LogisticRegression", "Perceptron")
#: Validation rows that a report is evaluated on, as the search's fixed prefix.
REPORT_ROWS = 128
BLOCK = 4096


# ---------------------------------------------------------------- units
@dataclass
class Unit:
    """One optimisation problem: a linear machine for one class, or a network."""

    config: int
    loss: str
    w: np.ndarray
    strength: float = 1.0  # C, eta0 or the learning rate
    target: int | None = None  # the class that counts as +1
    balanced: bool = False
    shapes: list = field(default_factory=list)
    alpha: float = 0.0
    limit: int = 100
    tol: float = 1e-6
    steps: int = 0
    done: bool = False
    converged: bool = False
    losses: list = field(default_factory=list)
    before: tuple | None = None
    halved: int = 0
    first: float | None = None
    moments: tuple | None = None
    stale: int = 0

    @property
    def size(self) -> int:
        d = len(self.w)
        return 1 + d + (d * (d + 1) // 2 if self.loss in ("squared_hinge", "logistic") else 0)

    # in tasks
    def partial(self, phi: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Loss, gradient and upper curvature of a block; ``s`` weighs rows."""
        if self.loss == "network":
            return _network_partial(self, phi, y)
        t = y if self.target is None else np.where(y == self.target, 1.0, -1.0)
        m = t * (phi @ self.w)
        if self.loss == "perceptron":
            wrong = m <= 0
            return np.concatenate([[wrong.sum()], phi[wrong].T @ (s[wrong] * t[wrong])])
        if self.loss == "squared_hinge":
            slack = np.maximum(0.0, 1.0 - m)
            value, slope, curve = s @ slack**2, -2 * s * t * slack, 2 * s * (slack > 0)
        else:
            p = 1.0 / (1.0 + np.exp(-np.clip(m, -700, 700)))
            value, slope, curve = s @ np.logaddexp(0.0, -m), -s * t * (1 - p), s * p * (1 - p)
        return np.concatenate([[value], phi.T @ slope, ((phi * curve[:, None]).T @ phi)[np.triu_indices(len(self.w))]])

    # on the driver
    def advance(self, total: np.ndarray, n: int) -> None:
        self.steps += 1
        if self.loss == "perceptron":
            self.losses.append(float(total[0]))
            if not total[0]:
                self.done = self.converged = True
                return
            self.w = self.w + self.strength * total[1:]
        elif self.loss == "network":
            self._adam(total, n)
        else:
            self._newton(total)
        self.done = self.done or self.steps >= self.limit

    def _newton(self, total: np.ndarray) -> None:
        d, c = len(self.w), self.strength
        ridge = np.ones(d)
        if self.loss == "logistic":
            ridge[-1] = 0.0  # the intercept is free
        value = c * total[0] + 0.5 * float(ridge @ self.w**2)
        if self.before is not None and value > self.before[1] * (1 + 1e-12) + 1e-12 and self.halved < 30:
            self.w, self.halved = (self.w + self.before[0]) / 2, self.halved + 1  # the step was too long
            return
        self.losses.append(value)
        g = c * total[1 : d + 1] + ridge * self.w
        size = float(np.abs(g).max())
        self.first = size if self.first is None else self.first
        if size <= self.tol * max(1.0, self.first) or self.halved >= 30:
            self.done = True
            self.converged = size <= 1e-3 * max(1.0, self.first)
            return
        h = np.zeros((d, d))
        h[np.triu_indices(d)] = c * total[d + 1 :]
        h = h + np.triu(h, 1).T + np.diag(ridge + 1e-10)
        self.before, self.halved = (self.w, value), 0
        self.w = self.w - np.linalg.solve(h, g)

    def _adam(self, total: np.ndarray, n: int) -> None:
        mask = np.concatenate([np.concatenate([np.ones(a * b), np.zeros(b)]) for a, b in self.shapes])
        value = total[0] / n + 0.5 * self.alpha * float(mask @ self.w**2) / n
        g = total[1:] / n + self.alpha * mask * self.w / n
        self.stale = self.stale + 1 if self.losses and value > min(self.losses) - self.tol else 0
        self.losses.append(value)
        if self.stale >= 10:
            self.done = self.converged = True
            return
        m, v = self.moments or (np.zeros_like(g), np.zeros_like(g))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        self.moments = m, v
        k = len(self.losses)
        self.w = self.w - self.strength * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)


def _layers(unit: Unit) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in unit.shapes:
        out.append((unit.w[at : at + a * b].reshape(a, b), unit.w[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _activations(unit: Unit, x: np.ndarray) -> list[np.ndarray]:
    """Input, hidden layers, and the class probabilities last."""
    out, layers = [x], _layers(unit)
    for w, b in layers[:-1]:
        out.append(np.maximum(0.0, out[-1] @ w + b))
    z = out[-1] @ layers[-1][0] + layers[-1][1]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return [*out, z / z.sum(axis=1, keepdims=True)]


def _network_partial(unit: Unit, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    code = np.where(y > 0, 1, 0) if unit.target == -1 else y.astype(int)
    act = _activations(unit, x[:, :-1])  # without the constant of the linear models
    picked = act[-1][np.arange(len(code)), code]
    delta = act[-1].copy()
    delta[np.arange(len(code)), code] -= 1.0
    grads = []
    for (w, _), below in zip(reversed(_layers(unit)), reversed(act[:-1]), strict=True):
        grads.append(np.concatenate([(below.T @ delta).ravel(), delta.sum(axis=0)]))
        delta = (delta @ w.T) * (below > 0)
    return np.concatenate([[-np.log(np.maximum(picked, 1e-300)).sum()], *reversed(grads)])


# ---------------------------------------------------------------- models
@dataclass
class Fitted:
    """A trained configuration: its units, feature map and how training went."""

    trial: int
    config: dict
    units: list
    space: tuple  # ("linear",) or ("rbf", gamma)
    state: str = "COMPLETE"
    error: str | None = None
    pruned_at: int | None = None
    seconds: float = 0.0

    @property
    def n_steps(self) -> int:
        return max((u.steps for u in self.units), default=0)

    @property
    def converged(self) -> bool:
        return bool(self.units) and all(u.converged for u in self.units)

    @property
    def has_probability(self) -> bool:
        return self.config["model_type"] in ("LogisticRegression", "MLPClassifier")

    def predict(self, phi: np.ndarray, classes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """(label, score of the last class: a probability, or NaN where the
        model gives none)."""
        none = np.full(len(phi), np.nan)
        first = self.units[0]
        if first.loss == "network":
            p = _activations(first, phi[:, :-1])[-1]
            return np.asarray(classes)[p.argmax(axis=1)], p[:, -1]
        margins = np.stack([phi @ u.w for u in self.units], axis=1)
        if len(self.units) == 1:
            label = np.where(margins[:, 0] > 0, classes[-1], classes[0])
            return label, 1 / (1 + np.exp(-np.clip(margins[:, 0], -700, 700))) if first.loss == "logistic" else none
        return np.asarray(classes)[margins.argmax(axis=1)], none


def _units(trial: int, cfg: dict, dim: int, d: int, classes: Sequence[int], limit: int) -> list[Unit]:
    kind, several = cfg["model_type"], len(classes) > 2
    balanced = cfg.get("class_weight") == "balanced"
    if kind == "MLPClassifier":
        hidden = ast.literal_eval(str(cfg.get("hidden_layer_sizes", "(100,)")))
        sizes = [d, *([hidden] if isinstance(hidden, int) else hidden), len(classes)]
        shapes = list(zip(sizes[:-1], sizes[1:], strict=True))
        # drawn from the configuration itself, so it starts alike in any company
        r = np.random.default_rng(zlib.crc32(json.dumps({k: str(v) for k, v in cfg.items()}, sort_keys=True).encode()))
        w = np.concatenate([np.concatenate([r.uniform(-1, 1, a * b) * np.sqrt(6 / (a + b)), np.zeros(b)]) for a, b in shapes])
        return [Unit(trial, "network", w, float(cfg.get("learning_rate", 0.01)), None if several else -1, False, shapes, float(cfg.get("alpha", 1e-4)), limit, 1e-4)]
    loss, strength, steps = {
        "SVClinear": ("squared_hinge", cfg.get("C", 1.0), limit), "SVC": ("squared_hinge", cfg.get("C", 1.0), limit),
        "LogisticRegression": ("logistic", cfg.get("C", 1.0), limit), "Perceptron": ("perceptron", cfg.get("eta0", 1.0), int(cfg.get("epochs", 10)))}[kind]
    return [Unit(trial, loss, np.zeros(dim), float(strength), c if several else None, balanced, limit=steps) for c in (classes if several else [None])]


def _mapped(x: np.ndarray, space: tuple, marks: np.ndarray) -> np.ndarray:
    """Features with a constant at the end: the row itself, or its RBF kernel
    values with the landmarks."""
    if space[0] == "rbf":
        x = np.exp(-space[1] * np.maximum(0.0, (x**2).sum(axis=1)[:, None] - 2 * x @ marks.T + (marks**2).sum(axis=1)[None, :]))
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Study:
    """Trains and scores configurations on one train table."""

    def __init__(self, train: DataFrame, key: str = "row_id", landmarks: int = 50):
        self.train = train.select("x", F.col("y").cast("int").alias("y"))
        stats = self.train.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).orderBy("y").collect()  # ≤ 20 classes
        if not stats or any(r["y"] is None for r in stats):
            raise ValueError("the train rows need labels")
        self.classes, self.counts = [r["y"] for r in stats], {r["y"]: r["n"] for r in stats}
        if len(self.classes) == 1:
            raise ValueError("the train rows have one class only")
        self.n, self.d = sum(self.counts.values()), stats[0]["d"]
        rows = train.orderBy(F.xxhash64(key), key).limit(landmarks).select("x").collect()  # ``landmarks`` rows
        self.marks = np.array([r["x"] for r in rows])
        self._scale: float | None = None

    def scale(self) -> float:
        """The RBF width 1 / (d · variance of all entries)."""
        if self._scale is None:
            entry = lambda fn: F.aggregate("x", F.lit(0.0), lambda a, v: a + fn(v))
            r = self.train.agg(F.sum(entry(lambda v: v)).alias("s"), F.sum(entry(lambda v: v * v)).alias("q")).first()
            m = self.n * self.d
            self._scale = 1.0 / max(1e-12, self.d * (r["q"] / m - (r["s"] / m) ** 2))
        return self._scale

    def space(self, cfg: dict) -> tuple:
        if cfg["model_type"] != "SVC":
            return ("linear",)
        return ("rbf", self.scale() if cfg.get("gamma") in (None, "scale") else float(cfg["gamma"]))

    def _pass(self, units: list[Unit], spaces: list[tuple]) -> list[np.ndarray]:
        """One pass over the train rows: the summed parts of every unit."""
        if sum(u.size for u in units) > MAX_NUMBERS:
            raise ValueError(f"more than {MAX_NUMBERS} numbers a pass: too many features or configurations")
        classes, counts, n, marks = self.classes, self.counts, self.n, self.marks
        weight = {c: n / (len(classes) * counts[c]) for c in classes}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = [np.zeros(u.size) for u in units]
            for batch in batches:
                for a in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(a, BLOCK)
                    x, y = _matrix(part.column(0)), part.column(1).to_numpy().astype(float)
                    if not np.isfinite(x).all():
                        raise ValueError("a feature is not a finite number")
                    by_class = np.select([y == c for c in classes], [weight[c] for c in classes])
                    ones, phi = np.ones(len(y)), {s: _mapped(x, s, marks) for s in set(spaces)}
                    for i, (u, s) in enumerate(zip(units, spaces, strict=True)):
                        totals[i] += u.partial(phi[s], y, _row_weights(u, y, by_class, ones, classes, counts, n))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(units), dtype=np.int32)), pa.array(totals, pa.list_(pa.float64()))], ["unit", "part"])

        def added(t: pa.Table) -> pa.Table:
            return pa.table({"unit": t.column("unit").slice(0, 1), "part": pa.array([_matrix(t.column("part")).sum(axis=0)], pa.list_(pa.float64()))})

        got = self.train.mapInArrow(run, "unit int, part array<double>").groupBy("unit").applyInArrow(added, "unit int, part array<double>").collect()
        return [np.array(r["part"]) for r in sorted(got, key=lambda r: r["unit"])]  # one row per unit

    def fit(self, configs: Sequence[dict], limit: int = 60, first: int = 0, validation: DataFrame | None = None, metric: str = "neg_loss",
            interval: int = 1, halving: "Halving | None" = None) -> tuple[list[Fitted], list[tuple]]:
        """Train ``configs`` (trial numbers from ``first``). Returns the models
        and the reports (trial, report index, step, value): after each
        ``interval`` passes the mean loss since (negated), or F1 / accuracy on the
        first ``REPORT_ROWS`` rows of ``validation``. ``halving`` prunes by them."""
        if metric not in ("neg_loss", "f1", "accuracy"):
            raise ValueError(f"unknown intermediate metric {metric!r}")
        known, reports, passes = [], [], 0
        for i, cfg in enumerate(configs):
            model = Fitted(first + i, dict(cfg), [], ("linear",))
            try:  # a configuration that cannot be built is recorded, the others go on
                if cfg.get("model_type") not in (*LINEAR, "MLPClassifier"):
                    raise ValueError(f"no such model type: {cfg.get('model_type')}")
                model.space = self.space(cfg)
                dim = (len(self.marks) if model.space[0] == "rbf" else self.d) + 1
                model.units = _units(model.trial, cfg, dim, self.d, self.classes, limit)
            except (ValueError, TypeError, SyntaxError) as e:
                model.state, model.error = "FAIL", f"{type(e).__name__}: {e}"
            known.append(model)
        look = self._looked(validation) if validation is not None and metric != "neg_loss" else None
        began = time.time()
        while True:
            running = [m for m in known if m.state == "COMPLETE" and m.pruned_at is None and any(not u.done for u in m.units)]
            pairs = [(m, u) for m in running for u in m.units if not u.done]
            if not pairs:
                break
            passes += 1
            for (_, u), total in zip(pairs, self._pass([u for _, u in pairs], [m.space for m, _ in pairs]), strict=True):
                u.advance(total, self.n)
            for m in running:
                m.seconds = time.time() - began
                if not all(np.isfinite(u.w).all() for u in m.units):
                    m.state, m.error = "FAIL", "FloatingPointError: weights are not finite"
                elif passes % interval == 0:
                    value = self._report(m, metric, interval, look)
                    index = passes // interval - 1
                    reports.append((m.trial, index, passes, value))
                    if halving is not None and not halving.keeps(m.trial, index, value):
                        m.state, m.pruned_at = "PRUNED", passes
        return known, reports

    def _looked(self, validation: DataFrame) -> tuple:
        rows = validation.orderBy("row_id").limit(REPORT_ROWS).select("x", F.col("y").cast("int")).collect()
        return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

    def _report(self, m: Fitted, metric: str, interval: int, look: tuple | None) -> float:
        if look is None or not len(look[1]):
            return -float(np.mean([np.mean(u.losses[-interval:]) for u in m.units]))
        label, _ = m.predict(_mapped(look[0], m.space, self.marks), self.classes)
        if metric == "accuracy":
            return float((label == look[1]).mean())
        scores = []
        for c in self.classes[-1:] if len(self.classes) == 2 else sorted({*look[1].tolist(), *label.tolist()}):
            hit = int(((label == c) & (look[1] == c)).sum())
            all_ = int((label == c).sum() + (look[1] == c).sum())
            scores.append(2 * hit / all_ if all_ else 0.0)
        return float(np.mean(scores))

    def score(self, rows: DataFrame, models: Sequence[Fitted], keep: Sequence[str] = ("row_id", "split", "y")) -> DataFrame:
        """``keep``, trial, y_pred and score (NULL where the model gives no
        probability) of every row and every trained configuration."""
        done = [m for m in models if m.state == "COMPLETE"]
        classes, marks, names = self.classes, self.marks, list(keep)
        base = rows.select(*names, "x")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1]) + ", trial int, y_pred int, score double"

        def run(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(a, BLOCK)
                    x = _matrix(part.column(len(names)))
                    phi = {s: _mapped(x, s, marks) for s in {m.space for m in done}}
                    for m in done:
                        label, p = m.predict(phi[m.space], classes)
                        yield pa.RecordBatch.from_arrays(
                            [*part.columns[: len(names)], pa.array(np.full(len(x), m.trial, dtype=np.int32)), pa.array(label.astype(np.int32)),
                             pa.array(p, mask=np.isnan(p))], [*names, "trial", "y_pred", "score"])

        return base.mapInArrow(run, schema)


def _row_weights(u: Unit, y: np.ndarray, by_class: np.ndarray, ones: np.ndarray, classes, counts, n) -> np.ndarray:
    if not u.balanced:
        return ones
    if u.target is None:
        return by_class
    own = counts[u.target]  # one class against the rest
    return np.where(y == u.target, n / (2 * own), n / (2 * (n - own)))


class Halving:
    """Asynchronous successive halving (Li et al. 2018) on report indices."""

    def __init__(self, min_resource: int = 1, eta: int = 3):
        self.least, self.eta = min_resource, eta
        self.values: dict[int, list[float]] = {}
        self.rung: dict[int, int] = {}

    def keeps(self, trial: int, index: int, value: float) -> bool:
        rung = self.rung.get(trial, 0)
        if index != self.least * self.eta**rung:
            return True
        known = self.values.setdefault(rung, [])
        self.rung[trial] = rung + 1
        if np.isnan(value):
            return False
        bisect.insort(known, value)
        return len(known) - bisect.bisect_right(known, value) < max(1, len(known) // self.eta)
