"""Checked queries: profiling (P*), cleaning (C*), encoding (E*), targets (T*), splits (X*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equisel.operators import clean as C
from equisel.operators import encode as E
from equisel.operators import profile as PR
from equisel.operators import split as X
from equisel.operators import target as T
from equisel.sources import views as V
from equisel.functions.exprs import hash32
from equisel.sources.sql_views import H, with_views
from equisel.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def reg(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        SQL[name] = sql


FEAT = V.features
FEAT_COLS = [("p_partkey", False), ("p_size", False), ("p_retailprice", True), ("p_brand", False),
             ("p_type", False), ("flag", False), ("target", False)]
LI_COLS = [("l_orderkey", False), ("l_partkey", False), ("l_suppkey", False), ("l_linenumber", False),
           ("l_quantity", True), ("l_extendedprice", True), ("l_discount", True), ("l_tax", True),
           ("l_returnflag", False), ("l_linestatus", False), ("l_shipdate", False)]


def _profile_sql(src: str, cols) -> str:
    parts = []
    for c, is_float in cols:
        miss = f"CAST(count_if({c} IS NULL OR isnan({c})) AS BIGINT)" if is_float else f"CAST(count_if({c} IS NULL) AS BIGINT)"
        parts.append(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, {miss} AS n_missing, "
                     f"count(DISTINCT {c}) AS n_unique FROM {src}")
    return "\nUNION ALL ".join(parts)


reg("p01_p07_profile_features", lambda s, d: PR.profile(FEAT(s, d)).select("column", "n_rows", "n_missing", "n_unique"),
    with_views(_profile_sql("features", FEAT_COLS), "features"))
reg("p01_p07_profile_lineitem",
    lambda s, d: PR.profile(table(s, d, "lineitem")).select("column", "n_rows", "n_missing", "n_unique"),
    _profile_sql("lineitem", LI_COLS))
reg("p02_missing_counts_features", lambda s, d: PR.missing_counts(FEAT(s, d)),
    with_views(f"""SELECT "column", n_missing FROM ({_profile_sql('features', FEAT_COLS)})
       UNION ALL SELECT '__total__', CAST(sum(n_missing) AS BIGINT) FROM ({_profile_sql('features', FEAT_COLS)})""",
               "features"))
reg("p03_unique_counts_lineitem", lambda s, d: PR.unique_counts(table(s, d, "lineitem")),
    f'SELECT "column", n_unique FROM ({_profile_sql("lineitem", LI_COLS)})')

def _sketches(s, d):
    """Sketches stored per return flag, merged, held against exact counts."""
    li = table(s, d, "lineitem")
    merged = PR.merge_sketches(PR.sketch_profile(li, [c for c in li.columns if c != "l_returnflag"], ["l_returnflag"]))
    got = PR.read_sketches(merged).collect()  # one row per column
    # a count of distinct values for each column on its own: together they make a copy of every row per column
    counts = [li.agg(F.countDistinct(F.col(r["column"])).alias("n")).select(F.lit(f"d{i}").alias("name"), "n") for i, r in enumerate(got)]
    exact = {x["name"]: x["n"] for x in reduce(DataFrame.unionByName, counts).collect()}
    ranks = [x for i, r in enumerate(got) for k, q in enumerate(r["quantiles"] or []) for x in (
        F.avg((F.col(r["column"]).cast("double") <= q).cast("double")).alias(f"q{i}_{k}"),
        F.avg((F.col(r["column"]).cast("double") < q).cast("double")).alias(f"u{i}_{k}"))]
    if ranks:
        exact |= li.agg(*ranks).first().asDict()
    rows = []
    for i, r in enumerate(got):
        near = abs(r["distinct"] - exact[f"d{i}"]) <= 0.04 * exact[f"d{i}"]
        ranks = [exact[f"u{i}_{k}"] - 0.015 <= p <= exact[f"q{i}_{k}"] + 0.015 for k, p in enumerate((0.25, 0.5, 0.75) if r["quantiles"] else ())]
        rows.append((r["column"], r["n"], r["nulls"], exact[f"d{i}"], near, all(ranks) if ranks else None))
    return s.createDataFrame(rows, "column string, n long, nulls long, n_unique long, distinct_within_4_percent boolean, ranks_within_2_percent boolean")


_numbers = {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"}
reg("p03_p04_stored_sketches", _sketches, "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_unique, true AS distinct_within_4_percent,
       {'true' if c in _numbers else 'CAST(NULL AS BOOLEAN)'} AS ranks_within_2_percent FROM lineitem""" for c, *_ in LI_COLS if c != "l_returnflag"))

_cand = "\nUNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM features WHERE {c} IS NOT NULL"
    for c, _ in FEAT_COLS)
reg("p04_candidate_targets_features", lambda s, d: PR.candidate_targets(FEAT(s, d)),
    with_views(f"""SELECT "column", count(*) AS n_unique, list_sort(list(value)) AS "values"
       FROM ({_cand}) GROUP BY "column" HAVING count(*) <= 20""", "features"))

_num = ["p_partkey", "p_size", "p_retailprice"]
_desc = "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS DOUBLE) AS "count", avg({c}) AS mean, stddev_samp({c}) AS std,
        CAST(min({c}) AS DOUBLE) AS "min", quantile_cont(CAST({c} AS DOUBLE), 0.25) AS "25%",
        quantile_cont(CAST({c} AS DOUBLE), 0.5) AS "50%", quantile_cont(CAST({c} AS DOUBLE), 0.75) AS "75%",
        CAST(max({c}) AS DOUBLE) AS "max" FROM features""" for c in _num)
reg("p06_describe_features", lambda s, d: PR.describe(FEAT(s, d)),
    with_views(f"""SELECT "column", stat, round(coalesce(CASE WHEN isnan(value) THEN 0.0 ELSE value END, 0.0), 6) AS value
       FROM ({_desc}) UNPIVOT INCLUDE NULLS (value FOR stat IN ("count", mean, std, "min", "25%", "50%", "75%", "max"))""",
               "features"))
reg("p06_describe_lineitem", lambda s, d: PR.describe(table(s, d, "lineitem").select(
    "l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    (lambda cols: f"""SELECT "column", stat, round(coalesce(CASE WHEN isnan(value) THEN 0.0 ELSE value END, 0.0), 6) AS value
       FROM ({' UNION ALL '.join(f'''SELECT '{c}' AS "column", CAST(count({c}) AS DOUBLE) AS "count", avg({c}) AS mean,
        stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS "min", quantile_cont({c}, 0.25) AS "25%",
        quantile_cont({c}, 0.5) AS "50%", quantile_cont({c}, 0.75) AS "75%", CAST(max({c}) AS DOUBLE) AS "max"
        FROM lineitem''' for c in cols)})
       UNPIVOT INCLUDE NULLS (value FOR stat IN ("count", mean, std, "min", "25%", "50%", "75%", "max"))""")(
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))

reg("p08_class_distribution", lambda s, d: PR.class_distribution(V.split_input(s, d)),
    with_views('SELECT y AS value, count(*) AS "count" FROM split_input GROUP BY y', "split_input"))

reg("p09_select_usable_columns", lambda s, d: PR.select_usable_columns(FEAT(s, d), "target", "onehot"),
    with_views(f"""SELECT "column", reason IS NULL AS kept, reason FROM (
       SELECT "column", CASE WHEN "column" IN ('p_brand', 'p_type') AND n_unique > 10 THEN 'more than 10 categories' END AS reason
       FROM ({_profile_sql('features', [c for c in FEAT_COLS if c[0] != 'target'])}))""", "features"))

# ---------------------------------------------------------------- cleaning
reg("c01_c02_c05_select_rename",
    lambda s, d: C.standardise_target_name(C.safe_column_names(C.select_features(
        FEAT(s, d).select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"), "p_retailprice", "target"),
        ["k", "s", "p_retailprice"], "target")), "target", "y"),
    with_views('SELECT p_partkey AS "feat: k", p_size AS "feat: s", p_retailprice, target AS y FROM features', "features"))
reg("c03_drop_missing_rows", lambda s, d: C.drop_missing_rows(FEAT(s, d)),
    with_views("SELECT * FROM features WHERE " + " AND ".join(f"{c} IS NOT NULL" for c, _ in FEAT_COLS), "features"))
reg("c04_recode_many_to_one", lambda s, d: C.recode(V.split_input(s, d), "y", {"F": "done", "O": "open", "P": "open"}),
    with_views("SELECT row_id, CASE y WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' WHEN 'P' THEN 'open' ELSE y END AS y "
               "FROM split_input", "split_input"))
reg("c06_two_class_filter", lambda s, d: C.two_class_filter(V.vectors(s, d).select("vec_id", "label"), 0, 1),
    "SELECT vec_id, label, CASE WHEN label = 0 THEN -1 ELSE 1 END AS y FROM embeddings WHERE label IN (0, 1)")
reg("c07_minmax_normalise", lambda s, d: C.minmax_normalise(FEAT(s, d).select("p_partkey", "p_size", "p_retailprice"),
                                                          ["p_size", "p_retailprice"]).select(
    "p_partkey", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice")),
    with_views("""SELECT p_partkey,
       round(CASE WHEN max(p_size) OVER () = min(p_size) OVER () THEN 0.0 ELSE CAST(p_size - min(p_size) OVER () AS DOUBLE) / (max(p_size) OVER () - min(p_size) OVER ()) END, 6) AS p_size,
       round(CASE WHEN max(p_retailprice) OVER () = min(p_retailprice) OVER () THEN 0.0 ELSE (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) END, 6) AS p_retailprice
       FROM features""", "features"))

# ---------------------------------------------------------------- encoding
reg("e02_impute_median", lambda s, d: E.impute_median(FEAT(s, d).select("p_partkey", "p_size"), ["p_size"])[0],
    with_views("SELECT p_partkey, coalesce(CAST(p_size AS DOUBLE), (SELECT quantile_cont(p_size, 0.5) FROM features)) AS p_size "
               "FROM features", "features"))
reg("e03_impute_missing_category", lambda s, d: E.impute_missing_category(FEAT(s, d).select("p_partkey", "p_type", "flag"),
                                                                       ["p_type", "flag"]),
    with_views("SELECT p_partkey, coalesce(p_type, 'missing') AS p_type, coalesce(CAST(flag AS VARCHAR), 'missing') AS flag "
               "FROM features", "features"))


def _ordinal(c: str) -> str:
    cats = f"(SELECT list_sort(list(DISTINCT coalesce(CAST({c} AS VARCHAR), 'missing'))) FROM features)"
    return (f"(list_position({cats}, coalesce(CAST({c} AS VARCHAR), 'missing')) - 1) / "
            f"CAST(greatest(len({cats}) - 1, 1) AS DOUBLE)")


_med = "(SELECT quantile_cont({c}, 0.5) FROM features)"
_enc_num = (f"coalesce(CAST(p_size AS DOUBLE), {_med.format(c='p_size')}) AS p_size, "
            f"coalesce(p_retailprice, {_med.format(c='p_retailprice')}) AS p_retailprice")
reg("e04_e06_encode_ordinal",
    lambda s, d: E.encode_features(FEAT(s, d), "ordinal", keep=["p_partkey", "target"])[0],
    with_views(f"""SELECT p_partkey, {_enc_num}, {_ordinal('p_brand')} AS p_brand, {_ordinal('p_type')} AS p_type,
       coalesce(CAST(flag AS DOUBLE), 0.0) AS flag, target FROM features""", "features"))

_ptypes = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "missing"]
reg("e05_e06_encode_onehot",
    lambda s, d: E.encode_features(FEAT(s, d).drop("p_brand"), "onehot", keep=["p_partkey", "target"])[0],
    with_views(f"""SELECT p_partkey, {_enc_num},
       {', '.join(f"CAST(coalesce(p_type, 'missing') = '{k}' AS DOUBLE) AS p_type_{k}" for k in _ptypes)},
       coalesce(CAST(flag AS DOUBLE), 0.0) AS flag, target FROM features""", "features"))

reg("e07_encoding_metadata",
    lambda s, d: E.encode_features(FEAT(s, d), "ordinal", keep=["p_partkey", "target"])[1],
    with_views("""
SELECT 'p_size' AS "column", 'numeric' AS kind, NULL::VARCHAR[] AS categories, CAST(count_if(p_size IS NULL) AS BIGINT) AS imputed, ['p_size'] AS out_columns FROM features
UNION ALL SELECT 'p_retailprice', 'numeric', NULL, CAST(count_if(p_retailprice IS NULL) AS BIGINT), ['p_retailprice'] FROM features
UNION ALL SELECT 'p_brand', 'ordinal', list_sort(list(DISTINCT coalesce(p_brand, 'missing'))), CAST(count_if(p_brand IS NULL) AS BIGINT), ['p_brand'] FROM features
UNION ALL SELECT 'p_type', 'ordinal', list_sort(list(DISTINCT coalesce(p_type, 'missing'))), CAST(count_if(p_type IS NULL) AS BIGINT), ['p_type'] FROM features
UNION ALL SELECT 'flag', 'numeric', NULL, CAST(count_if(flag IS NULL) AS BIGINT), ['flag'] FROM features""", "features"))

reg("e07_passthrough_columns",
    lambda s, d: E.passthrough_columns(E.encode_features(FEAT(s, d).drop("p_brand"), "onehot", keep=["p_partkey", "target"])[1]),
    "SELECT 'p_type' AS \"column\", 'p_type_' || k AS out_column FROM (SELECT unnest(list_sort(list(DISTINCT coalesce(CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END, 'missing')))) AS k FROM part)")


def _z(c, src="features"):
    return (f"round((({c} - avg({c}) OVER ()) / CASE WHEN coalesce(stddev_pop({c}) OVER (), 0) = 0 THEN 1.0 "
            f"ELSE stddev_pop({c}) OVER () END), 6) AS {c}")


reg("e08_zscore_all_rows",
    lambda s, d: E.zscore(FEAT(s, d).select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]).select(
        "p_partkey", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice")),
    with_views(f"SELECT p_partkey, {_z('p_size')}, {_z('p_retailprice')} FROM features", "features"))

reg("e08_zscore_lineitem",
    lambda s, d: E.zscore(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"),
                          ["l_quantity", "l_extendedprice"]).select(
        "l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"),
        F.round("l_extendedprice", 6).alias("l_extendedprice")),
    f"SELECT l_orderkey, l_linenumber, {_z('l_quantity')}, {_z('l_extendedprice')} FROM lineitem")


def _mm(c, lo=-1.0, hi=1.0):
    rng = f"(CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 1.0 ELSE max({c}) OVER () - min({c}) OVER () END)"
    sc = f"({hi - lo!r} / {rng})"
    return f"round(({c} * {sc} + ({lo!r} - min({c}) OVER () * {sc})) * 1.0, 6) AS {c}"


reg("e09_minmax_scale",
    lambda s, d: E.minmax_scale(FEAT(s, d).select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice", "p_size"],
                                lo=-1.0, hi=1.0, fit_on="all").select(
        "p_partkey", F.round("p_retailprice", 6).alias("p_retailprice"), F.round("p_size", 6).alias("p_size")),
    with_views(f"SELECT p_partkey, {_mm('p_retailprice')}, {_mm('p_size')} FROM features", "features"))

reg("e10_amplitude_encode",
    lambda s, d: E.amplitude_encode(E.assemble_array(table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"),
        ["l_quantity", "l_extendedprice", "l_discount"]), "x", scaling=0.5).select(
        "l_orderkey", "l_linenumber", *[F.round(F.col("x")[i], 6).alias(f"a{i}") for i in range(4)]),
    """SELECT l_orderkey, l_linenumber, round(a0 / nrm, 6) AS a0, round(a1 / nrm, 6) AS a1, round(a2 / nrm, 6) AS a2,
       round(a3 / nrm, 6) AS a3 FROM (
       SELECT *, sqrt(((0.0 + a0 * a0) + a1 * a1) + a2 * a2 + a3 * a3) AS nrm FROM (
         SELECT l_orderkey, l_linenumber, l_quantity * 0.5 AS a0, l_extendedprice * 0.5 AS a1, l_discount * 0.5 AS a2,
                1.0 / 4 AS a3 FROM lineitem))""")

reg("e11_pad_multiple_of_3",
    lambda s, d: E.pad_multiple_of_3(V.vectors(s, d).select("vec_id", F.col("embedding").cast("array<double>").alias("x"))),
    "SELECT vec_id, list_concat(CAST(embedding AS DOUBLE[]), [0.0::DOUBLE for i in range(((3 - len(embedding)) % 3 + 3) % 3)]) AS x FROM embeddings")


def _pca(s, d):
    v = V.vectors(s, d)
    v = v.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    v = X.stratified_split(v.withColumn("y", F.lit(1)), key="vec_id", label="y", frac=0.75)
    return E.pca_project(v, [f"e{i}" for i in range(64)], 3).select("vec_id", "split", "pca")


reg("e13_pca_project", _pca)


def _pca_two(s, d):
    """Two standardised columns: the components are their sum and difference."""
    v = V.vectors(s, d).select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(2)])
    v = v.withColumn("split", F.when(hash32("vec_id", 5) % 4 < 3, "train").otherwise("test"))
    out = E.pca_project(v, ["e0", "e1"], 2)
    return out.select("vec_id", "split", *(F.round(F.abs(F.col("pca")[i]), 6).alias(f"c{i + 1}") for i in range(2)))


reg("e13_pca_two_columns", _pca_two, with_views(f"""
SELECT vec_id, split, round(abs(z0 + sign(r) * z1) / sqrt(2.0), 6) AS c1, round(abs(z0 - sign(r) * z1) / sqrt(2.0), 6) AS c2
FROM (SELECT vec_id, split, r, (e0 - m0) / s0 AS z0, (e1 - m1) / s1 AS z1
      FROM p CROSS JOIN (SELECT avg(e0) AS m0, avg(e1) AS m1, stddev_pop(e0) AS s0, stddev_pop(e1) AS s1, corr(e0, e1) AS r FROM p WHERE split = 'train'))""",
    extra={"p": f"""SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS e0, CAST(embedding[2] AS DOUBLE) AS e1,
       CASE WHEN {H('vec_id', 5)} % 4 < 3 THEN 'train' ELSE 'test' END AS split FROM embeddings"""}))

# ---------------------------------------------------------------- targets
reg("t01_task_spec", lambda s, d: T.task_spec_frame(V.split_input(s, d), "y"),
    with_views("""SELECT CASE WHEN count(DISTINCT y) = 2 THEN 'binary' ELSE 'multiclass' END AS kind,
       CAST(count(DISTINCT y) AS INTEGER) AS n_classes, list_sort(list(DISTINCT y)) AS class_labels,
       NULL::VARCHAR AS favorable_class, NULL::INTEGER AS favorable_code FROM split_input""", "split_input"))


def _enc_bin(s, d):
    f = FEAT(s, d).select("p_partkey", "target")
    return T.encode_binary(f, T.derive_task_spec(f, "target"), "target", "y")


reg("t02_encode_binary", _enc_bin,
    with_views("SELECT p_partkey, target, CASE WHEN target = (SELECT max(target) FROM features) THEN 1 ELSE -1 END AS y "
               "FROM features", "features"))


def _enc_mc(s, d):
    f = V.split_input(s, d)
    return T.encode_multiclass(f, T.derive_task_spec(f, "y"), "y", "code")


reg("t03_encode_multiclass", _enc_mc,
    with_views("SELECT row_id, y, CAST(dense_rank() OVER (ORDER BY y) - 1 AS INTEGER) AS code FROM split_input", "split_input"))


def _dec(s, d):
    spec = T.derive_task_spec(V.split_input(s, d), "y")
    return T.decode_labels(V.predictions_mc(s, d).select("row_id", "y_pred"), spec, "y_pred", "label")


reg("t04_decode_labels", _dec,
    with_views("SELECT row_id, y_pred, (SELECT list_sort(list(DISTINCT o_orderstatus)) FROM orders)[y_pred + 1] AS label "
               "FROM predictions_mc", "predictions_mc"))
reg("t06_validate_codes", lambda s, d: T.validate_codes(V.predictions(s, d), 2, "y_true"),
    with_views("SELECT DISTINCT CAST(y_true AS INTEGER) AS code FROM predictions WHERE y_true NOT IN (-1, 1)", "predictions"))
reg("t07_ovr_indicators", lambda s, d: T.ovr_indicators(V.predictions_mc(s, d).select("row_id", "y_true"), 3, "y_true"),
    with_views("SELECT row_id, y_true, k AS class_code, CASE WHEN y_true = k THEN 1 ELSE -1 END AS y_k "
               "FROM predictions_mc CROSS JOIN (SELECT CAST(range AS INTEGER) AS k FROM range(3))", "predictions_mc"))
reg("t08_binarize_favorable", lambda s, d: __import__("equisel.operators.fairness", fromlist=["x"]).binarize_favorable(
    V.predictions_mc(s, d).select("row_id", "y_true", "y_pred"), 2),
    with_views("SELECT row_id, CAST(y_true = 2 AS INTEGER) AS y_true, CAST(y_pred = 2 AS INTEGER) AS y_pred FROM predictions_mc",
               "predictions_mc"))
reg("t09_balanced_class_weights", lambda s, d: T.balanced_class_weights(V.split_input(s, d), "y"),
    with_views("SELECT y, row_id, count(*) OVER () / (count(*) OVER (PARTITION BY y) * (SELECT count(DISTINCT y) FROM split_input)) "
               "AS weight FROM split_input", "split_input"))

# ---------------------------------------------------------------- splits
_SPLIT = f"""
s_ AS (SELECT *, {H('row_id', 42)} AS h FROM split_input),
c_ AS (SELECT y, count(*) AS n_c FROM s_ GROUP BY y),
q_ AS (SELECT y, n_c, floor(n_c * 0.75::DOUBLE) AS base, n_c * 0.75::DOUBLE - floor(n_c * 0.75::DOUBLE) AS rem,
              floor(sum(n_c) OVER () * 0.75::DOUBLE) - sum(floor(n_c * 0.75::DOUBLE)) OVER () AS left_ FROM c_),
qq_ AS (SELECT y, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, y) <= left_ THEN 1 ELSE 0 END AS quota FROM q_),
split_ AS (SELECT row_id, y, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY h, row_id) <= quota THEN 'train' ELSE 'test' END AS split
           FROM s_ JOIN qq_ USING (y))
"""


def _split(s, d):
    return X.stratified_split(V.split_input(s, d), "row_id", "y", 0.75, 42)


reg("x01_stratified_split", _split, with_views("SELECT * FROM split_", "split_input").replace(
    "\nSELECT * FROM split_", "," + _SPLIT + "SELECT * FROM split_"))

_VAL = f"""
t_ AS (SELECT *, {H('row_id', 42)} AS h FROM split_ WHERE split = 'train'),
tc_ AS (SELECT y, count(*) AS n_c FROM t_ GROUP BY y),
tq_ AS (SELECT y, floor(n_c * 0.2::DOUBLE) AS base, n_c * 0.2::DOUBLE - floor(n_c * 0.2::DOUBLE) AS rem,
               ceil(sum(n_c) OVER () * 0.2::DOUBLE) - sum(floor(n_c * 0.2::DOUBLE)) OVER () AS left_ FROM tc_),
tqq_ AS (SELECT y, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, y) <= left_ THEN 1 ELSE 0 END AS quota FROM tq_)
"""
def _one_alone(s, d):
    """The split input with a class of a single row: the split is unstratified."""
    v = V.split_input(s, d)
    alone = v.agg(F.min("row_id").alias("k"))
    return v.crossJoin(F.broadcast(alone)).withColumn("y", F.when(F.col("row_id") == F.col("k"), "alone").otherwise(F.col("y"))).drop("k")


reg("x02_split_fallback", lambda s, d: X.stratified_split(_one_alone(s, d), "row_id", "y", 0.75, 42),
    with_views(f"""SELECT row_id, CASE WHEN row_id = (SELECT min(row_id) FROM split_input) THEN 'alone' ELSE y END AS y,
       CASE WHEN row_number() OVER (ORDER BY {H('row_id', 42)}, row_id) <= floor(count(*) OVER () * 0.75::DOUBLE) THEN 'train' ELSE 'test' END AS split
       FROM split_input""", "split_input"))

reg("x03_validation_split", lambda s, d: X.validation_split(_split(s, d), "row_id", "y", 0.2, 42),
    with_views("X", "split_input").replace("\nX", "," + _SPLIT + "," + _VAL + """
SELECT row_id, y, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY h, row_id) <= quota THEN 'val' ELSE 'train' END AS split
FROM t_ JOIN tqq_ USING (y)
UNION ALL SELECT row_id, y, split FROM split_ WHERE split <> 'train'"""))

reg("x04_align_sensitive",
    lambda s, d: X.align_sensitive(_split(s, d), table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderpriority"),
                                   "o_orderpriority"),
    with_views("X", "split_input").replace("\nX", "," + _SPLIT + """
SELECT s.row_id, s.y, s.split, o.o_orderpriority AS sensitive FROM split_ s LEFT JOIN orders o ON o.o_orderkey = s.row_id"""))

reg("x05_minibatch", lambda s, d: X.minibatch(V.split_input(s, d), 1000, 7, "row_id"),
    with_views(f"""SELECT b.row_id, b.y, r.id AS draw FROM
       (SELECT *, row_number() OVER (ORDER BY row_id) AS pos FROM split_input) b
       JOIN (SELECT range AS id, {H('range', 7)} % (SELECT count(*) FROM split_input) + 1 AS pos FROM range(1000)) r
       ON r.pos = b.pos""", "split_input"))

reg("x06_prefix_subset", lambda s, d: X.prefix_subset(V.split_input(s, d), 128, "row_id"),
    with_views("SELECT * FROM split_input ORDER BY row_id LIMIT 128", "split_input"))

reg("x07_even_downsample", lambda s, d: X.even_downsample(V.split_input(s, d), "row_id", max_points=500),
    with_views("""SELECT row_id, y FROM (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS pos, count(*) OVER () AS n FROM split_input)
       WHERE n <= 500 OR pos IN (SELECT CAST(round_even(CAST(i * ((SELECT count(*) FROM split_input) - 1) AS DOUBLE) / 499, 0) AS BIGINT)
                                  FROM range(500) r(i))""", "split_input"))

reg("x08_balanced_take", lambda s, d: X.balanced_take(V.vectors(s, d).select("vec_id", "label").where(F.col("label").isin(0, 1)),
                                                    40, "label", "vec_id"),
    """SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn
       FROM embeddings WHERE label IN (0, 1)) WHERE rn <= 20""")

reg("x09_bootstrap_rows", lambda s, d: X.bootstrap_rows(_split(s, d), 500, 42, "split", "row_id"),
    with_views("X", "split_input").replace("\nX", "," + _SPLIT + f"""
SELECT b.row_id, b.y, b.split, r.id AS draw FROM
  (SELECT *, row_number() OVER (PARTITION BY split ORDER BY row_id) AS pos, count(*) OVER (PARTITION BY split) AS n FROM split_) b
  JOIN (SELECT 'test' AS split, range AS id, {H('range', 42)} AS hh FROM range(500)
        UNION ALL SELECT 'train', range, {H('range', 43)} FROM range(500)) r
  ON r.split = b.split AND b.pos = r.hh % b.n + 1"""))

# ---------------------------------------------------------------- sources (S1–S4), head, E1, E14, T5
from equisel.sources import tables as IO  # noqa: E402


def _scratch(s, name):
    import uuid

    from equisel.session import checkpoint_dir
    return f"{checkpoint_dir(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


reg("s01_read_table", lambda s, d: IO.read_table(s, f"{d}/lineitem.parquet", ["l_quantity", "l_extendedprice", "l_discount"],
                                                 "l_returnflag"),
    "SELECT l_quantity, l_extendedprice, l_discount, l_returnflag FROM lineitem")


def _headerless(s, d):
    path = _scratch(s, "headerless")
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    o.write.option("header", False).csv(path)  # a header-less CSV derived from the table
    return IO.read_headerless_xy(s, path, schema="x0 bigint, x1 double, y string")


reg("s02_read_headerless_xy", _headerless,
    "SELECT o_orderkey AS x0, o_totalprice AS x1, o_orderstatus AS y FROM orders")


def _attach(s, d):
    o = table(s, d, "orders")
    feats = o.select(F.col("o_orderkey").alias("row_id"), "o_totalprice", "o_orderdate")
    targets = o.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("y"))
    return IO.attach_target(feats, targets, "row_id")


reg("s03_attach_target", _attach,
    "SELECT o_orderkey AS row_id, o_totalprice, o_orderdate, o_orderstatus AS y FROM orders")


def _roundtrip(s, d):
    path = _scratch(s, "written")
    src = V.features(s, d)
    IO.write_table(src, path, "csv")
    schema = src.schema
    return s.read.option("header", True).schema(schema).csv(path)


reg("s04_write_table_csv_roundtrip", _roundtrip,
    with_views("SELECT * FROM features", "features"))

reg("p05_head", lambda s, d: PR.head(FEAT(s, d), 10, "p_partkey"),
    with_views("SELECT * FROM features ORDER BY p_partkey LIMIT 10", "features"))
reg("e01_bool_to_double", lambda s, d: E.bool_to_double(FEAT(s, d).select("p_partkey", "flag")),
    with_views("SELECT p_partkey, CAST(flag AS DOUBLE) AS flag FROM features", "features"))


def _e14(s, d):
    sp = _split(s, d).join(table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice"), "row_id")
    z = E.zscore(sp, ["o_totalprice"], fit_on="train")
    return z.select("row_id", "split", F.round("o_totalprice", 6).alias("o_totalprice"))


SQL_E14 = with_views("X", "split_input").replace("\nX", "," + _SPLIT + """,
j_ AS (SELECT s.row_id, s.split, o.o_totalprice FROM split_ s JOIN orders o ON o.o_orderkey = s.row_id),
st_ AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM j_ WHERE split = 'train')
SELECT row_id, split, round((o_totalprice - m) / CASE WHEN coalesce(sd, 0) = 0 THEN 1.0 ELSE sd END, 6) AS o_totalprice
FROM j_ CROSS JOIN st_""")
reg("e14_standardise_fit_on_train", _e14, SQL_E14)

reg("t05_pass_through_if_encoded", lambda s, d: T.pass_through_if_encoded(V.predictions(s, d).select("row_id", "y_true"),
                                                                        "y_true", "y")[0],
    with_views("SELECT row_id, y_true, CAST(y_true AS INTEGER) AS y FROM predictions", "predictions"))
