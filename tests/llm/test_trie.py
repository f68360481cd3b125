import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from equisel.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, key(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[c][h:])
    nodes = {}
    for c, t in full.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        children = [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p]
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        ends = sorted(c for c in members if full[c] == p)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children), len(leaves),
                    sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, /, parts=3, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)
    return sorted(map(tuple, T.digest(T.trie(df, **kw)).collect()), key=str)


def some(n, seed, ids=None):
    r = random.Random(seed)
    rows = []
    for c in ids or range(n):
        for t in range(r.randrange(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["hi", "Hello thére", "", "long text " * 5]) if r.random() < 0.6 else f"t{r.randrange(9)}"))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard,size", [(4096, 1 << 18), (5, 1 << 18), (4096, 20), (1, 3)])
def test_against_brute_force(spark, shard, size):
    rows = some(130, 3)
    assert found(spark, rows, shard=shard, rows=size) == brute(rows)


def test_nulls_ties_repeated_rows_and_ids(spark):
    rows = [(5, None, "user", "first"), (5, 0, None, "a"), (5, 0, "user", None), (5, 0, "user", None), (5, 3, None, None), (None, 1, "user", "nobody"),
            (100, 0, "user", "a"), (100, 1, "user", "b"), (103, 0, "x", "y"), (-7, 0, "user", "neg"), (-7, 9, "user", "neg2"), (0, 2, "user", "zero"),
            (10**12 + 1, 0, "user", "far"), (250, 0, "user", "no base")]
    rows += [(201, i, "user", "z") for i in range(7)] + [(200, 0, "user", "w")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, shard=2, rows=4) == brute(rows)


def test_turnless_conversations_end_at_the_root(spark):
    c = next(c for c in range(301, 399) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "only"), (c, 1, "user", "two")]  # its hundred is absent and h covers its turns
    got = found(spark, rows)
    assert got == brute(rows) and len(got) == 1 and got[0][7] == hashlib.sha256(str(c).encode()).hexdigest()


def test_long_conversation_and_many_equal_ones(spark):
    rows = [(7, i, "user", f"w{i % 3}") for i in range(900)]
    rows += [(c, i, "user", f"same{i}") for c in range(1000, 1200) for i in range(3)]
    got = found(spark, rows, shard=16, rows=100)
    assert got == sorted(duckdb_rows(rows), key=str)  # brute force takes too long here; the SQL is checked against it below
    root = next(g for g in got if g[1] == 0)
    assert root[3] == 201 and max(g[1] for g in got) >= 895


def duckdb_rows(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return con.execute(T.SQL).fetchall()


def test_sql_agrees_with_brute_force():
    rows = some(60, 11)
    assert sorted(duckdb_rows(rows), key=str) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    assert found(spark, []) == []
    rows = some(12, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("key", "n_chars", "h", "part", "path", "shard", "salt", "rank"):
        df = df.withColumn(c, F.lit("mine"))
    assert sorted(map(tuple, T.digest(T.trie(df)).collect()), key=str) == brute(rows)


def test_roles_and_texts_are_told_apart(spark):
    rows = [(1, 0, "ab", "c"), (1, 1, "x", ""), (2, 0, "a", "bc"), (3, 0, "", "abc"), (4, 0, "abc", "")] + [(c, t, "user", f"m{t}") for c in range(1, 5) for t in range(2, 9)]
    assert found(spark, rows) == brute(rows)
