"""equisel: fair model selection and auditing as Spark DataFrame jobs.

Subpackages
-----------
sources    -- reading/writing tables, keyed record stores, derived test views
functions  -- reusable Column expressions (hashing, guarded division, prefix sums)
operators  -- profiling, cleaning, encoding, targets, splits, metrics, fairness,
              trial-log analytics, search spaces, kernels, training, attribution
plans      -- end-to-end compositions (prepare, audit report, trial evaluation)
streaming  -- Structured Streaming views over growing trial/report logs
"""

from equisel.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
