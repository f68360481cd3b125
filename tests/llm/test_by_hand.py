"""op2: training against the risk from its definition; op9: buckets counted as they complete."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from equisel.llm import quality, substring


def test_training_follows_the_non_negative_risk(spark, frame, words):
    """Three Adam steps again, with gradients of the risk by finite differences."""
    rows = [(i, words(30 + i % 40, i)) for i in range(60)] + [(100 + i, "x9# " * (5 + i)) for i in range(20)]
    table = quality.feature_table(frame(rows)).withColumn("positive", quality.F.col("doc_id") % 3 == 0).cache()
    got = table.collect()
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in got]).astype(float)
    pos = np.array([r["positive"] for r in got])
    loss = lambda z: 1 / (1 + np.exp(np.clip(z, -50, 50)))  # noqa: E731  (sigmoid loss)
    for steps in (1, 3):
        scale, w, prior = quality.fit(table, steps)
        z = scale(x)
        risk_pos = lambda v: prior * loss(z[pos] @ v).mean()
        risk_neg = lambda v: loss(-(z @ v)).mean() - prior * loss(-(z[pos] @ v)).mean()

        def slope(f, v):
            out = np.zeros(len(v))
            for i in range(len(v)):
                e = np.zeros(len(v))
                e[i] = 1e-5
                out[i] = (f(v + e) - f(v - e)) / 2e-5
            return out

        v = m = s = np.zeros(len(w))
        ridge = max(quality.RIDGE, 0.5 / pos.sum())
        for t in range(1, steps + 1):
            g = slope(lambda u: risk_pos(u) + risk_neg(u), v) if risk_neg(v) >= 0 else -slope(risk_neg, v)
            g = g + ridge * v
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            v = v - quality.RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        big = np.abs(w) > 1e-6  # Adam's first step has the size of RATE whatever the gradient
        assert np.allclose(w[big], v[big], rtol=2e-2, atol=2e-3) and 0.01 <= prior <= 0.99
    scores = quality._sigmoid(scale(x) @ w)
    assert ((scores > 0) & (scores < 1)).all()


def strings(n, seed, k):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        mz = r.randrange(6)
        rows.append((mz, r.choice([0, 1, 2]) if mz == 3 else -1, i, r.randrange(50), " ".join(f"w{r.randrange(4)}" for _ in range(k + r.randrange(6)))))
    return sorted(rows)


def counted(rows, k, size):
    out = []
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + size], strict=True), (pa.int64(),) * 4 + (pa.string(),), strict=True)],
                                          ["mz", "salt", "rk", "at", "packed"]) for a in range(0, len(rows), size)]
    for b in substring._count(k)(iter(batches)):
        out += b.to_pylist()
    return out


@pytest.mark.parametrize("held", [1, 40, 10**6])
def test_buckets_are_counted_as_they_complete(monkeypatch, held):
    k = 3
    rows = strings(150, 3, k)
    monkeypatch.setattr(substring, "HELD_WINDOWS", held)
    got = counted(rows, k, 7)
    where = collections.defaultdict(list)
    for mz, salt, rk, at, text in rows:
        w = text.split()
        for i in range(len(w) - k + 1):
            where[mz, tuple(w[i : i + k])].append((salt, rk, at + i))
    hit = {(rk, p) for r in got if r["wh"] is None for rk, p in [(r["rk"], p) for p in range(r["lo"], r["hi"])]}
    leads = collections.Counter((r["mz"], r["wh"]) for r in got if r["wh"] is not None)
    for (mz, _), places in where.items():
        for salt, rk, p in places:
            own = [x for x in places if x[0] == salt]
            if len(own) > 1:  # twice in its bucket: every one of its words is covered
                assert all((rk, q) in hit for q in range(p, p + k))
    # a salted bucket gives one row per distinct window to meet the other salts, as do several in one table at most
    distinct = {(mz, s, win) for (mz, win), places in where.items() for s, _, _ in places if s >= 0}
    assert len({(m, h) for m, h in leads}) == len({(mz, win) for mz, _, win in distinct}) and sum(leads.values()) <= len(distinct)
    assert all(mz == 3 for mz, _ in leads)
