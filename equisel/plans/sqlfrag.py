"""Small DuckDB SQL fragments shared by the oracle texts."""

from __future__ import annotations


def sdiv(num: str, den: str) -> str:
    """Guarded division (0/0 → 0), double result."""
    return f"(CASE WHEN ({den}) = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / ({den}) END)"


def r6(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def counts_sql(src: str, group: str | None, by: list[str], fav: str = "1") -> str:
    """``(by, group, tp, fp, fn, tn, n)`` on favorable indicators."""
    g = [*by] + ([f'CAST({group} AS VARCHAR) AS "group"'] if group else [])
    gb = ", ".join(str(i + 1) for i in range(len(g))) if g else ""
    return (
        f"SELECT {', '.join(g) + ',' if g else ''} "
        f"count_if(y_true = {fav} AND y_pred = {fav}) AS tp, count_if(y_true <> {fav} AND y_pred = {fav}) AS fp, "
        f"count_if(y_true = {fav} AND y_pred <> {fav}) AS fn, count_if(y_true <> {fav} AND y_pred <> {fav}) AS tn, "
        f"count(*) AS n FROM {src}" + (f" GROUP BY {gb}" if gb else "")
    )


def rates_sql(src: str, cols: list[str]) -> str:
    c = ", ".join(cols) + ", " if cols else ""
    return (
        f"SELECT {c}"
        f"{sdiv('tp + tn', 'n')} AS accuracy, {sdiv('tp', 'tp + fp')} AS precision, "
        f"{sdiv('tp', 'tp + fn')} AS recall, {sdiv('2 * tp', '2 * tp + fp + fn')} AS f1, "
        f"{sdiv('tp + fp', 'n')} AS selection_rate, {sdiv('fp', 'fp + tn')} AS false_positive_rate, "
        f"{sdiv('fn', 'fn + tp')} AS false_negative_rate, CAST(n AS DOUBLE) AS count FROM {src}"
    )


GROUP_METRICS = ["accuracy", "precision", "recall", "f1", "selection_rate", "false_positive_rate",
                 "false_negative_rate", "count"]


def percls_sql(src: str, by: list[str]) -> str:
    """Per-class tp/fp/fn/support over labels in true ∪ pred."""
    b = ", ".join(by) + ", " if by else ""
    on = " AND ".join([f"t.{k} IS NOT DISTINCT FROM p.{k}" for k in by] + ["t.label = p.label"])
    sel_by = ", ".join(f"coalesce(t.{k}, p.{k}) AS {k}" for k in by) + (", " if by else "")
    gbt = ", ".join(by + ["y_true"])
    gbp = ", ".join(by + ["y_pred"])
    return f"""(SELECT {sel_by} coalesce(t.label, p.label) AS label,
        CAST(coalesce(t.tp, 0) AS BIGINT) AS tp, CAST(coalesce(p.fp, 0) AS BIGINT) AS fp,
        CAST(coalesce(t.fn, 0) AS BIGINT) AS fn, CAST(coalesce(t.support, 0) AS BIGINT) AS support
      FROM (SELECT {b} y_true AS label, count_if(y_true = y_pred) AS tp, count_if(y_true <> y_pred) AS fn,
                   count(*) AS support FROM {src} GROUP BY {gbt}) t
      FULL OUTER JOIN (SELECT {b} y_pred AS label, count_if(y_true <> y_pred) AS fp FROM {src} GROUP BY {gbp}) p
      ON {on})"""


def cum_sql(src: str, by: list[str], y: str = "y_true", score: str = "score", pos: str = "1") -> str:
    """Per distinct score (descending) with cumulative pos/neg and totals P/N."""
    b = ", ".join(by) + ", " if by else ""
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    return f"""(SELECT *, sum(pos) OVER ({part}ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
              sum(neg) OVER ({part}ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg,
              sum(pos) OVER ({part.strip()}) AS "P", sum(neg) OVER ({part.strip()}) AS "N"
       FROM (SELECT {b} {score} AS score, count_if({y} = {pos}) AS pos, count_if({y} <> {pos}) AS neg
             FROM {src} WHERE {score} IS NOT NULL GROUP BY {', '.join(by + [score]) if by else score}))"""
