"""Keyed record stores as tables.

Upserts are unions ranked by precedence per key (each key has at most
one row per source, so the window partitions are tiny); patches are left
joins with ``coalesce``; deletes are anti joins. Results are DataFrames to
be written back with ``write_table`` (overwrite of a new version folder).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACTIVE_RUN = ("running", "pending")
ACTIVE_JOB = ("pending", "running")


def upsert(store: DataFrame, records: DataFrame, key: str | Sequence[str], newest: str | None = None) -> DataFrame:
    """Register-or-overwrite by key; ``records`` win over ``store``.
    Of several records for one key the one with the largest ``newest`` wins,
    then (or without it) the one with the least hash of its values, so the
    result never depends on the order of rows."""
    keys = [key] if isinstance(key, str) else list(key)
    u = store.withColumn("__prec", F.lit(1)).unionByName(records.withColumn("__prec", F.lit(0)), allowMissingColumns=True)
    rest = [c for c in u.columns if c not in keys and c != "__prec"]
    # winner per key by partial aggregation (min_by on precedence): a key with many
    # duplicate records is combined map-side instead of landing in one window partition
    tie = F.xxhash64(*[F.col(c) for c in rest]) if rest else F.lit(0)
    age = [F.max(F.col(newest)).alias("__n")] if newest else []
    if newest:  # the newest row of each side first, then the usual precedence
        u = u.join(u.groupBy(*keys, "__prec").agg(*age), [*keys, "__prec"]).where(F.col(newest).eqNullSafe(F.col("__n"))).drop("__n")
    win = u.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("__prec", tie.alias("t"))).alias("__w"))
    return win.select(*keys, *[F.col(f"__w.{c}").alias(c) for c in rest]).select(
        *[c for c in u.columns if c != "__prec"])


def one_per_key(df: DataFrame, keys: Sequence[str], newest: str | None = None) -> DataFrame:
    """One whole row per key: the largest ``newest``, then the least hash of
    its values, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    order = ([F.col(newest).alias("newest")] if newest else []) + [F.bitwise_not(F.xxhash64(*rest)).alias("tie")]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__one"))
    return best.select(*keys, "__one.*").select(*df.columns)


def patch(store: DataFrame, patches: DataFrame, key: str, newest: str | None = None) -> DataFrame:
    """S6 ``patch_runs``: partial update of the given columns; a column not
    in the store is an error (checked before planning); a patch for a
    missing key is a no-op (left join from the store). Of several patches for a
    key one is applied, see :func:`one_per_key`; ``newest`` may be a column of
    the patches only."""
    unknown = [c for c in patches.columns if c not in store.columns and c != newest]
    if unknown:
        raise ValueError(f"the store has no column {', '.join(sorted(unknown))}")
    cols = [c for c in patches.columns if c != key and c in store.columns]
    p = one_per_key(patches, [key], newest).select(key, *[F.col(c).alias(f"__p_{c}") for c in cols], F.lit(True).alias("__hit"))
    j = store.join(p, key, "left")
    return j.select(*[F.when(F.col("__hit"), F.col(f"__p_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
                      for c in store.columns])


def list_newest_first(store: DataFrame, ts: str = "started_at", key: str = "job_id") -> DataFrame:
    """S7 ``list_runs``: newest first."""
    return store.orderBy(F.col(ts).desc_nulls_last(), F.col(key))


def delete_keys(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """S7 ``delete_runs``: anti join on the ids to delete."""
    return store.join(keys.select(key), key, "left_anti")


def count_active_runs(runs: DataFrame) -> DataFrame:
    """Number of runs in running / pending."""
    return runs.agg(F.count_if(F.col("status").isin(*ACTIVE_RUN)).alias("active"))


def mark_stale_interrupted(runs: DataFrame) -> DataFrame:
    """Rewrite running / pending runs to ``interrupted`` (after a restart)."""
    return runs.withColumn("status", F.when(F.col("status").isin(*ACTIVE_RUN), F.lit("interrupted")).otherwise(F.col("status")))


def align_columns(df: DataFrame, schema: T.StructType, defaults: Mapping[str, F.Column] | None = None) -> DataFrame:
    """Add columns missing from ``df`` (default or NULL of the target type)."""
    defaults = defaults or {}
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(defaults.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def merge_store(src: DataFrame | None, dst: DataFrame | None, key: str | Sequence[str],
                defaults: Mapping[str, F.Column] | None = None) -> DataFrame:
    """S9 (one table): idempotent merge of ``src`` into ``dst`` by key with
    defaults for absent columns; an absent table is empty. Rows already in
    ``dst`` stay as they are."""
    if src is None and dst is None:
        raise ValueError("both tables absent")
    target = dst if dst is not None else src
    schema = T.StructType(list({f.name: f for f in (target.schema.fields + (src.schema.fields if src is not None else []))}.values()))
    d = align_columns(dst, schema, defaults) if dst is not None else None
    s = align_columns(src, schema, defaults) if src is not None else None
    if d is None:
        return s
    if s is None:
        return d
    return upsert(s, d, key)  # existing destination rows win


def merge_counts(src: DataFrame | None, dst: DataFrame | None, key: str | Sequence[str], table: str) -> DataFrame:
    """S9 ``dry_run``: per table the rows that would be inserted / are already present."""
    keys = [key] if isinstance(key, str) else list(key)
    spark = (src or dst).sparkSession
    if src is None:
        return spark.createDataFrame([(table, 0, 0)], "table string, inserted long, existing long")
    if dst is None:
        return src.agg(F.lit(table).alias("table"), F.count(F.lit(1)).alias("inserted"), F.lit(0).cast("long").alias("existing"))
    s = src.select(*keys).distinct()
    hit = s.join(dst.select(*keys).distinct().withColumn("__d", F.lit(1)), keys, "left")
    return hit.agg(F.lit(table).alias("table"), F.count_if(F.col("__d").isNull()).alias("inserted"),
                   F.count_if(F.col("__d").isNotNull()).alias("existing"))


def merge_all(src: Mapping[str, DataFrame | None], dst: Mapping[str, DataFrame | None], keys: Mapping[str, str | Sequence[str]],
              defaults: Mapping[str, Mapping[str, F.Column]] | None = None) -> tuple[dict, DataFrame]:
    """S9 over all tables of a store: the merged tables, and one row per table
    with the rows that were inserted and already present. A run without its own
    study storage key takes its database name."""
    src = dict(src)
    runs = src.get("runs")
    if runs is not None and "db_name" in runs.columns:
        own = F.col("study_storage_key") if "study_storage_key" in runs.columns else F.lit(None).cast("string")
        src["runs"] = runs.withColumn("study_storage_key", F.coalesce(own, F.col("db_name")))
    merged, counts = {}, None
    for name, key in keys.items():
        s, d = src.get(name), dst.get(name)
        if s is None and d is None:
            continue
        merged[name] = merge_store(s, d, key, (defaults or {}).get(name))
        c = merge_counts(s, d, key, name)
        counts = c if counts is None else counts.unionByName(c)
    return merged, counts


CONFIG_DEFAULTS = {"use_proba": True, "subset_size": 50, "class_index": 0, "sample_index": 0}


def normalised_config(df: DataFrame) -> F.Column:
    """The five analysis settings with defaults, as a struct in sorted key order."""
    return F.struct(
        F.coalesce(F.col("class_index").cast("int"), F.lit(0)).alias("class_index"),
        F.coalesce(F.col("sample_index").cast("int"), F.lit(0)).alias("sample_index"),
        F.coalesce(F.col("subset_size").cast("int"), F.lit(50)).alias("subset_size"),
        F.col("trial_number").cast("int").alias("trial_number"),
        F.coalesce(F.col("use_proba").cast("boolean"), F.lit(True)).alias("use_proba"),
    )


def config_key(df: DataFrame, out: str = "config_key") -> DataFrame:
    """Canonical JSON (sorted keys, no spaces, nulls kept) → sha256 hex."""
    js = F.to_json(normalised_config(df), {"ignoreNullFields": "false"})
    return df.withColumn("config_json", js).withColumn(out, F.sha2(F.col("config_json"), 256))


def request_snapshots(requests: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """One snapshot per (run, config_key) — the newest request wins —
    and whether a new job is needed (no active job for that snapshot)."""
    r = config_key(requests)
    # newest request per (run, key) by partial aggregation: a hot key is not one window partition
    newest = F.max_by(F.struct("config_json", "created_at", "request_id"),
                      F.struct(F.col("created_at"), -F.col("request_id")))
    snap = r.groupBy("optimization_id", "config_key").agg(newest.alias("__s")).select(
        "optimization_id", "config_key", "__s.config_json", "__s.created_at", "__s.request_id")
    if jobs is None:
        return snap.withColumn("new_job", F.lit(True))
    active = jobs.where(F.col("status").isin(*ACTIVE_JOB)).select("optimization_id", "config_key").distinct()
    return snap.join(active.withColumn("__a", F.lit(True)), ["optimization_id", "config_key"], "left").select(
        *snap.columns, F.col("__a").isNull().alias("new_job"))


def complete_snapshots(snapshots: DataFrame, results: DataFrame) -> DataFrame:
    """A completed job replaces the payload and bumps the revision. Several
    results for a snapshot count once, see :func:`one_per_key`."""
    r = one_per_key(results.select("optimization_id", "config_key", "payload"), ["optimization_id", "config_key"]).select("optimization_id", "config_key", F.col("payload").alias("__pl"), F.lit(True).alias("__done"))
    j = snapshots.join(r, ["optimization_id", "config_key"], "left")
    return j.select(*[c for c in snapshots.columns if c not in ("revision", "payload")],
                    (F.col("revision") + F.when(F.col("__done"), 1).otherwise(0)).alias("revision"),
                    F.when(F.col("__done"), F.col("__pl")).otherwise(F.col("payload")).alias("payload"))


def complete_jobs(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """The active jobs of the snapshots that got results become completed."""
    done = results.select("optimization_id", "config_key").distinct().withColumn("__done", F.lit(True))
    j = jobs.join(done, ["optimization_id", "config_key"], "left")
    over = F.col("__done") & F.col("status").isin(*ACTIVE_JOB)
    return j.select(*[F.when(over, "completed").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in jobs.columns])


def list_snapshots(snapshots: DataFrame) -> DataFrame:
    """Only completed revisions (revision > 0), newest first."""
    return snapshots.where(F.col("revision") > 0).orderBy(F.col("created_at").desc(), "config_key")


def delete_for_run(tables: Mapping[str, DataFrame], runs: DataFrame, key: str = "optimization_id",
                   via: Mapping[str, tuple[str, str]] | None = None) -> dict:
    """Cascade delete. Tables with ``key`` lose the rows of the given
    runs. ``via`` names, for a table without it, the table and column through
    which its rows belong to a run, e.g. ``{"jobs": ("snapshots",
    "snapshot_id")}``; chains of any length follow."""
    via = dict(via or {})
    gone = {}

    def of(name: str) -> DataFrame:
        """The rows of a table that go."""
        if name not in gone:
            t = tables[name]
            if name in via:
                parent, column = via[name]
                gone[name] = t.join(of(parent).select(column).distinct(), column, "left_semi")
            elif key in t.columns:
                gone[name] = t.join(runs.select(key).distinct(), key, "left_semi")
            else:
                raise ValueError(f"table {name!r} has no {key!r} and no way to one in via")
        return gone[name]

    out = {}
    for name, t in tables.items():
        if name in via:
            parent, column = via[name]
            out[name] = t.join(of(parent).select(column).distinct(), column, "left_anti")
        else:
            of(name)
            out[name] = t.join(runs.select(key).distinct(), key, "left_anti")
    return out



def json_rows(df: DataFrame, out: str = "json") -> DataFrame:
    """JSON-safe rows: NaN / ±inf → null, then ``to_json``."""
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    cols = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(F.col(c)).alias(c) if c in fl else F.col(c)
            for c in df.columns]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(out))


def parse_json_columns(df: DataFrame, schemas: Mapping[str, str], suffix: str = "") -> DataFrame:
    """JSON text columns of a store (``request_json``, ``best_params_json``,
    ``columns_json``) as typed columns via ``from_json``; malformed text → NULL."""
    return df.withColumns({f"{c}{suffix}": F.from_json(F.col(c), ddl, {"mode": "PERMISSIVE"}) for c, ddl in schemas.items()})
