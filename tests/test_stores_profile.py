import hashlib
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from equisel.operators import profile as PR
from equisel.operators import target as T
from equisel.sources import stores as S


def test_config_key_matches_python_canonical_json(spark):
    rows = [(1, None, None, None, None, None), (2, 3, False, 25, 1, 2)]
    df = spark.createDataFrame(rows, "request_id long, trial_number int, use_proba boolean, subset_size int, "
                                     "class_index int, sample_index int")
    got = {r["request_id"]: (r["config_json"], r["config_key"]) for r in S.config_key(df).collect()}
    for rid, tn, up, ss, ci, si in rows:
        cfg = {"trial_number": tn, "use_proba": True if up is None else up, "subset_size": 50 if ss is None else ss,
               "class_index": 0 if ci is None else ci, "sample_index": 0 if si is None else si}
        text = json.dumps(cfg, sort_keys=True, separators=(",", ":"))
        assert got[rid] == (text, hashlib.sha256(text.encode()).hexdigest())


def test_patch_and_upsert_rules(spark):
    store = spark.createDataFrame([("a", "running", 0.1), ("b", "done", 0.2)], "job_id string, status string, best_value double")
    with pytest.raises(ValueError, match="the store has no column"):
        S.patch(store, spark.createDataFrame([("a", 1)], "job_id string, nope int"), "job_id")
    p = S.patch(store, spark.createDataFrame([("a", 0.9), ("zzz", 0.5)], "job_id string, best_value double"), "job_id")
    got = {r["job_id"]: (r["status"], r["best_value"]) for r in p.collect()}
    assert got == {"a": ("running", 0.9), "b": ("done", 0.2)}  # missing key: no-op
    u = S.upsert(store, spark.createDataFrame([("b", "failed", None), ("c", "pending", None)],
                                              "job_id string, status string, best_value double"), "job_id")
    got = {r["job_id"]: r["status"] for r in u.collect()}
    assert got == {"a": "running", "b": "failed", "c": "pending"}  # records win
    assert S.mark_stale_interrupted(store).where("status = 'interrupted'").count() == 1
    assert S.count_active_runs(store).first()["active"] == 1


def test_exact_quantiles_and_describe_match_pandas(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    vals = np.round(rng.normal(10, 3, 501), 2)
    pdf = pd.DataFrame({"a": vals, "b": (vals * 3).astype(int)})
    df = spark.createDataFrame(pdf)
    got = {(r["column"], r["stat"]): r["value"] for r in PR.describe(df).collect()}
    want = pdf.describe()
    for c in ("a", "b"):
        for stat in ("mean", "std", "min", "25%", "50%", "75%", "max"):
            assert got[(c, stat)] == pytest.approx(round(float(want.loc[stat, c]), 6), abs=1e-6)


def test_unseen_class_raises(spark):
    spec = T.TaskSpec("multiclass", 3, ["a", "b", "c"])
    df = spark.createDataFrame([("a",), ("d",)], "y string")
    with pytest.raises(Exception, match="Unknown class d"):
        T.encode_multiclass(df, spec).collect()
    dec = T.decode_labels(spark.createDataFrame([(0,), (2,), (7,)], "y_pred int"), spec).collect()
    assert [r["label"] for r in dec] == ["a", "c", "7"]


def test_asha_stream_equals_batch(spark):
    from equisel.operators.search import asha_prune
    from equisel.sources.views import reports
    from equisel.streaming import live as L
    from tests.conftest import SF_SMALL

    live = L.run_live_asha(spark, SF_SMALL).select("study", "trial", "rung", "kept")
    batch = asha_prune(reports(spark, SF_SMALL), 1, 3).select("study", "trial", "rung", F.col("kept").alias("k2"))
    j = live.join(batch, ["study", "trial", "rung"], "full")
    assert j.where(~F.col("kept").eqNullSafe(F.col("k2"))).count() == 0
