"""Streams with their own state: arrival orders, replays, eviction."""

import random

import pytest
from pyspark.sql import functions as F

from equisel.operators import train as M
from equisel.streaming import state as S

SCHEMA = "study long, trial long, step long, value double, ts timestamp"
T0 = 1_700_000_000


def reports(spark, rows):
    """(study, trial, step, value, seconds) rows."""
    return spark.createDataFrame([(*r[:4], r[4]) for r in rows], "study long, trial long, step long, value double, at long").select(
        "study", "trial", "step", "value", F.timestamp_seconds(F.col("at") + T0).alias("ts"))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def written(spark, folder, batches):
    for i, rows in enumerate(batches):
        reports(spark, rows).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{i:03d}")


def replay(batches, least=1, eta=3):
    """Sequential halving, report by report."""
    seen, rung, pruned, values, out = {}, {}, set(), {}, []
    for rows in batches:
        for study, trial, step, value, _ in sorted(rows, key=lambda r: (r[4], r[1], r[2])):
            k = study, trial
            index = seen.get(k, 0)
            seen[k] = index + 1
            r = rung.get(k, 0)
            if k in pruned or index != least * eta**r:
                continue
            rung[k] = r + 1
            known = values.setdefault((study, r), [])
            if value is None:
                kept = False
                out.append((study, trial, r, index, None, len(known), kept))
            else:
                known.append(value)
                rank = 1 + sum(v > value for v in known)
                kept = rank <= max(1, len(known) // eta)
                out.append((study, trial, r, index, rank, len(known), kept))
            if not kept:
                pruned.add(k)
    return sorted(out, key=str)


def some(seed, n=200):
    r = random.Random(seed)
    steps = {}
    rows = []
    for i in range(n):
        k = r.randrange(3), r.randrange(12)
        steps[k] = steps.get(k, -1) + 1
        rows.append((*k, steps[k], None if r.random() < 0.03 else round(r.random() + 0.05 * k[1], 2), i * 60))
    return rows


@pytest.mark.parametrize("order", ["one batch", "by time", "mixed"])
def test_halving_equals_a_sequential_replay(spark, tmp_path, order):
    rows = some(4)
    batches = [rows] if order == "one batch" else [rows[i : i + 50] for i in range(0, 200, 50)]
    if order == "mixed":  # reports reach the stream out of order, batch by batch
        random.Random(1).shuffle(rows)
        batches = [rows[i : i + 67] for i in range(0, 200, 67)]
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    written(spark, src, batches)
    got = S.async_halving(spark, stream(spark, src), folder=out).collect()
    assert sorted([(r.study, r.trial, r.rung, r.resource, r["rank"], r.n, r.kept) for r in got], key=str) == replay(batches)


def test_a_restarted_stream_goes_on(spark, tmp_path):
    rows = some(9)
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    written(spark, src, [rows[:120]])
    S.async_halving(spark, stream(spark, src), folder=out)
    reports(spark, rows[120:]).coalesce(1).write.parquet(f"{src}/001")
    got = S.async_halving(spark, stream(spark, src), folder=out).collect()
    assert sorted([(r.study, r.trial, r.rung, r.resource, r["rank"], r.n, r.kept) for r in got], key=str) == replay([rows[:120], rows[120:]])


def test_an_idle_study_starts_anew(spark, tmp_path):
    first = [(1, t, s, 0.5 + t, 60 * (3 * s + t)) for t in range(2) for s in range(2)]
    other = [(2, 0, 0, 0.1, 40 * 86400), (2, 0, 1, 0.1, 40 * 86400 + 1)]
    back = [(1, 0, 5, 0.9, 41 * 86400), (1, 0, 6, 0.2, 41 * 86400 + 1)]
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    written(spark, src, [first, other, back])
    got = S.async_halving(spark, stream(spark, src), idle="1 day", delay="1 hour", folder=out).collect()
    mine = sorted((r.trial, r.resource, r.n) for r in got if r.study == 1)
    assert mine == [(0, 1, 1), (0, 1, 1), (1, 1, 2)]  # after the pause trial 0 is a new one at an empty rung


def test_convergence_equals_the_batch_rule(spark, tmp_path):
    r, w = random.Random(6), 3
    rows = [(1, t, s, None if (t, s) == (2, 20) else 1 / (1 + s) + r.gauss(0, 0.02), 60 * s) for t in range(4) for s in range(30)]
    rows = [(*x[:3], float("nan") if x[3] is None else x[3], x[4]) for x in rows]
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    written(spark, src, [[x for x in rows if a <= x[2] < a + 7] for a in range(0, 30, 7)])
    got = S.running_convergence(spark, stream(spark, src), w, folder=out)
    want = M.loss_convergence(reports(spark, rows), w)
    cols = ["study", "trial", "converged", "converged_step"]
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(map(tuple, want.select(cols).collect()), key=str)
    assert {(x.n_steps, x.n_late) for x in got.collect()} == {(30, 0)}


def test_late_steps_are_counted_and_idle_trials_end(spark, tmp_path):
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    written(spark, src, [[(1, 1, s, 1.0, 60 * s) for s in (0, 1, 4)], [(1, 1, 2, 9.0, 300), (1, 1, 5, 1.0, 301)], [(1, 2, 0, 1.0, 9 * 86400)]])
    got = {x.trial: x for x in S.running_convergence(spark, stream(spark, src), 2, idle="1 day", delay="1 hour", folder=out).collect()}
    assert (got[1].n_steps, got[1].n_late, got[1].final) == (5, 1, True) and (got[2].n_steps, got[2].final) == (1, False)


def test_state_holds_the_trials_under_way_only(spark, tmp_path):
    """Ten batches of new trials: the state of the first ones is dropped."""
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    written(spark, src, [[(1, 10 * b + t, s, float(s), b * 86400 + 60 * s + t) for t in range(10) for s in range(3)] for b in range(10)])
    sizes = []
    got = S.finished_trials(spark, stream(spark, src), gap="6 hours", delay="1 hour", folder=out, progress=sizes)
    assert len(sizes) >= 10 and max(sizes) <= 20
    rows = {x.trial: (x.n_reports, x.last_value) for x in got.collect()}
    assert set(rows) >= set(range(80)) and set(rows.values()) == {(3, 2.0)} and 99 not in rows


@pytest.mark.parametrize("buckets", [1, 3])
def test_keys_that_share_a_bucket_keep_their_own_state(spark, tmp_path, monkeypatch, buckets):
    """State is kept per bucket of keys, and keys of a bucket start, go on and fall idle on their own."""
    monkeypatch.setattr(S, "BUCKETS", buckets)
    rows = some(7)
    batches = [rows[i : i + 60] for i in range(0, 200, 60)]
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    written(spark, src, batches)
    got = S.async_halving(spark, stream(spark, src), folder=out).collect()
    assert sorted([(r.study, r.trial, r.rung, r.resource, r["rank"], r.n, r.kept) for r in got], key=str) == replay(batches)
    src, out, day = f"{tmp_path}/src2", f"{tmp_path}/out2", 86400
    written(spark, src, [[(1, t, s, 1.0, 60 * s) for t in range(6) for s in range(3)], [(1, 0, 3, 1.0, 5 * day)], [(1, 0, 4, 1.0, 5 * day + 60), (1, 1, 0, 1.0, 5 * day + 70)]])
    got = {x.trial: (x.n_steps, x.final) for x in S.running_convergence(spark, stream(spark, src), 2, idle="1 day", delay="1 hour", folder=out).collect()}
    # trial 0 reports before the watermark passes its alarm and goes on; trial 1 after it, and starts anew
    assert got == {0: (5, False), 1: (1, False), **{t: (3, True) for t in range(2, 6)}}
