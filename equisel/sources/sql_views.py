"""DuckDB (ANSI SQL) text of the derived views, for the correctness oracle.

Each entry is the body of a CTE with the same name and columns as the
Spark view in ``equisel.sources.views``. ``with_views(sql, *names)``
prefixes a query with the CTEs it needs.
"""

from __future__ import annotations

from equisel.sources.views import CLASSICAL_MODELS, MODEL_TYPES, RUN_STATUS, TRIAL_C, TRIAL_LAYERS, TRIAL_LR


def H(key: str, seed) -> str:
    """h(key, seed) in DuckDB: first 8 hex digits of md5 as BIGINT."""
    seed_sql = f"':{seed}'" if isinstance(seed, int) else f"':' || CAST({seed} AS VARCHAR)"
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || {seed_sql}), 1, 8) AS BIGINT)"


def U(key: str, seed) -> str:
    return f"({H(key, seed)} / 4294967296.0::DOUBLE)"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values, h: str) -> str:
    return f"{_list(values)}[({h} % {len(values)}) + 1]"


VIEWS: dict[str, str] = {}

VIEWS["predictions"] = f"""
SELECT o.o_orderkey AS row_id,
       CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE -1 END AS y_true,
       (350 * CAST(o.o_orderstatus = 'F' AS INTEGER)
        + floor(650 * {H('o.o_orderkey', 7)} / 4294967296.0::DOUBLE)) / 1000 AS score,
       c.c_mktsegment AS sensitive,
       o.o_orderpriority AS alt_group,
       CASE WHEN (350 * CAST(o.o_orderstatus = 'F' AS INTEGER)
        + floor(650 * {H('o.o_orderkey', 7)} / 4294967296.0::DOUBLE)) / 1000 >= 0.5 THEN 1 ELSE -1 END AS y_pred
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""

VIEWS["predictions_by_trial"] = f"""
SELECT t.trial, o.o_orderkey AS row_id,
       CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE -1 END AS y_true,
       s.score,
       c.c_mktsegment AS sensitive,
       CASE WHEN s.score >= 0.5 THEN 1 ELSE -1 END AS y_pred
FROM (SELECT *, {H('o_orderkey', 100)} AS hh FROM orders) o JOIN customer c ON o.o_custkey = c.c_custkey
CROSS JOIN (SELECT CAST(range AS INTEGER) AS trial FROM range(12)) t
CROSS JOIN LATERAL (
  SELECT ((200 + 25 * t.trial) * CAST(o.o_orderstatus = 'F' AS INTEGER)
          + floor((1000 - (200 + 25 * t.trial))
                  * ((o.hh * ((7919 * t.trial + 12345) * 2 + 1) + 104729 * t.trial) % 4294967296) / 4294967296.0::DOUBLE)) / 1000
         AS score) s
"""

_w = [f"(floor(1000 * ((hh * {2 * (7919 * k + 12345) + 1} + {104729 * k}) % 4294967296) / 4294967296.0::DOUBLE) "
      f"+ CASE WHEN y_true = {k} THEN 600 ELSE 0 END)" for k in range(3)]
VIEWS["predictions_mc"] = f"""
SELECT row_id, y_true,
       CASE WHEN w0 >= w1 AND w0 >= w2 THEN 0 WHEN w1 >= w2 THEN 1 ELSE 2 END AS y_pred,
       w0 / (w0 + w1 + w2) AS p0, w1 / (w0 + w1 + w2) AS p1, w2 / (w0 + w1 + w2) AS p2,
       sensitive,
       [w0 / (w0 + w1 + w2), w1 / (w0 + w1 + w2), w2 / (w0 + w1 + w2)] AS proba
FROM (
  SELECT row_id, y_true, sensitive, {_w[0]} AS w0, {_w[1]} AS w1, {_w[2]} AS w2
  FROM (SELECT o_orderkey, o_orderkey AS row_id, o_orderpriority AS sensitive,
               CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y_true, {H('o_orderkey', 11)} AS hh
        FROM orders)
)
"""

VIEWS["doc_quality"] = """
SELECT d.doc_id AS row_id, l.quality * 2 - 1 AS y_true,
       least(d.n_chars, 10000) / 10000 AS score,
       d.lang AS sensitive, d.source AS alt_group,
       CASE WHEN least(d.n_chars, 10000) / 10000 >= 0.1 THEN 1 ELSE -1 END AS y_pred
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

VIEWS["features"] = """
SELECT p_partkey,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size,
       p_retailprice, p_brand,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS p_type,
       (CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END) > 25 AS flag,
       CASE WHEN p_retailprice >= 950 THEN 'high' ELSE 'low' END AS target
FROM part
"""

VIEWS["split_input"] = "SELECT o_orderkey AS row_id, o_orderstatus AS y FROM orders"

VIEWS["trials"] = f"""
SELECT user_id AS study, event_id AS trial,
       CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'signup' THEN 'PRUNED' ELSE 'COMPLETE' END AS state,
       round(value / (value + 1), 6) AS f1,
       round({U('event_id', 3)}, 6) AS disparity,
       {_pick(MODEL_TYPES, H('event_id', 5))} AS model_type,
       {_pick(TRIAL_C, H('event_id', 6))} AS "C",
       {_pick(TRIAL_LR, H('event_id', 7))} AS learning_rate,
       {_pick(TRIAL_LAYERS, H('event_id', 8))} AS n_layers,
       CAST({H('event_id', 9)} % 200 + 1 AS INTEGER) AS n_steps,
       32 AS batch_size,
       ts AS start_ts,
       make_timestamp(epoch_us(ts) + ({H('event_id', 10)} % 600) * 1000000) AS end_ts,
       CASE WHEN event_type = 'error' THEN 'ValueError: trial ' || CAST(event_id AS VARCHAR) || ' failed' END AS error
FROM events
"""

VIEWS["reports"] = """
SELECT user_id AS study, event_id % 9 AS trial, event_id // 9 AS step, value, ts FROM events
"""

_status = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RUN_STATUS.items())
VIEWS["runs"] = f"""
SELECT 'job-' || CAST(event_id AS VARCHAR) AS job_id,
       'ds-' || CAST(user_id % 25 AS VARCHAR) AS dataset_id,
       user_id AS study,
       CASE event_type {_status} ELSE 'unknown' END AS status,
       ts AS started_at,
       CASE WHEN event_type = 'view' THEN round(value / (value + 1), 6) END AS best_value,
       CASE WHEN event_type = 'view' THEN '{{"C": ' || CAST({H('event_id', 6)} % 100 AS VARCHAR) || '}}' END AS best_params_json
FROM events
"""

VIEWS["datasets"] = """
SELECT 'ds-' || CAST(n_nationkey AS VARCHAR) AS dataset_id, n_name AS name, 'uci' AS source,
       CAST(n_regionkey * 100 + n_nationkey AS BIGINT) AS "rows"
FROM nation
"""

CLASSICAL_SQL = "(" + ", ".join(f"'{m}'" for m in CLASSICAL_MODELS) + ")"


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with ``WITH name AS (...)`` for each named view (in order)."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in names]
    parts += [f"{n} AS ({body})" for n, body in (extra or {}).items()]
    if not parts:
        return sql
    return "WITH " + ",\n".join(parts) + "\n" + sql

VIEWS["analysis_requests"] = """
SELECT event_id AS request_id, 'run-' || CAST(user_id AS VARCHAR) AS optimization_id,
       CASE WHEN event_type <> 'click' THEN CAST(event_id % 5 AS INTEGER) END AS trial_number,
       event_type <> 'error' AS use_proba,
       CASE WHEN event_type <> 'view' THEN CAST(50 + (event_id % 3) * 25 AS INTEGER) END AS subset_size,
       CAST(event_id % 2 AS INTEGER) AS class_index, NULL::INTEGER AS sample_index, ts AS created_at, event_type
FROM events
"""

VIEWS["config_keys"] = """
SELECT *, sha256(config_json) AS config_key FROM (
  SELECT *, to_json(struct_pack(class_index := coalesce(class_index, 0), sample_index := coalesce(sample_index, 0),
                                subset_size := coalesce(subset_size, 50), trial_number := trial_number,
                                use_proba := coalesce(use_proba, true))) AS config_json
  FROM analysis_requests)
"""
