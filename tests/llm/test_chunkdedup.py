import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from equisel.llm import chunkdedup as C, hot, words as W

LOWER = {i: i + 32 for i in range(65, 91)}


def norm(t):
    return (t or "").translate(LOWER)


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        ids = [x for x in g if x is not None]
        out.append((i, max(ids) if ids else None, len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()], key=str)


def check(rows, df):
    got = df.collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted({b[3] for b in brute(rows)})  # one of every text
    assert all(r.doc_id == r.keep_id for r in kept)


def test_odd_rows_against_brute_force(frame, odd_rows, clashing):
    check(odd_rows, C.duplicates(frame(odd_rows)))
    check(odd_rows, C.duplicates(clashing(odd_rows)))
    out = C.dedup(clashing(odd_rows).withColumn("_sha", F.lit("mine")).withColumn("keep_id", F.lit(0)).withColumn("recipe", F.lit(1)))
    assert sorted(hashlib.sha256(norm(r.text).encode()).hexdigest() for r in out.collect()) == sorted({b[3] for b in brute(odd_rows)})
    assert "_sha" in out.columns and out.where("_sha = 'mine'").count() == out.count()


def test_empty_table_and_text_ids(frame, spark):
    assert C.duplicates(frame([])).count() == 0 and C.dedup(frame([])).count() == 0
    rows = [("a", "x y"), ("b", "X y"), ("c", "z")]
    check(rows, C.duplicates(spark.createDataFrame(rows, "doc_id string, text string")))


def test_every_row_of_one_text(frame):
    """One group holds all rows: its recipe is broadcast, nothing moves."""
    rows = [(i, "Same Text " * 400) for i in range(60)] + [(99, "other")]
    check(rows, C.duplicates(frame(rows)))


def test_texts_that_differ_in_one_place(frame, words):
    base = words(4000, 3)
    rows = [(0, base), (1, base + " "), (2, "x" + base), (3, base[:9000] + "Q" + base[9001:]), (4, base.upper()), (5, "É" + base), (6, "é" + base)]
    check(rows, C.duplicates(frame(rows)))


def test_chunks_cover_the_text_and_follow_content():
    r = random.Random(5)
    text = bytes(r.randrange(97, 123) for _ in range(60_000))
    other = text[:20_000] + b"inserted words here" + text[20_000:]

    def cuts(b):
        raw = np.frombuffer(b, dtype=np.uint8)
        ends, counts = C.chunk_ends(raw, np.array([0, len(b)]))
        assert counts.sum() == len(ends) and ends[-1] == len(b)
        sizes = np.diff(np.concatenate([[0], ends]))
        assert (sizes[:-1] >= C.LEAST).all() and (sizes <= C.MOST).all()
        at, out = 0, []
        for e in ends:
            out.append(b[at:e])
            at = e
        return out

    a, b = cuts(text), cuts(other)
    assert len(a) > 15 and len(set(a) & set(b)) >= len(a) - 3  # an insertion changes the chunks beside it only
    same = np.frombuffer(b"x" * 70_000, dtype=np.uint8)
    ends, _ = C.chunk_ends(same, np.array([0, 70_000]))
    assert ends[-1] == 70_000 and (np.diff(np.concatenate([[0], ends])) <= C.MOST).all()


def test_cut_points_do_not_depend_on_blocks():
    r = np.random.default_rng(1)
    raw = r.integers(97, 123, 50_000).astype(np.uint8)
    alone, _ = C.chunk_ends(raw[7000:31_000], np.array([0, 24_000]))
    together, counts = C.chunk_ends(raw, np.array([0, 7000, 31_000, 50_000]))
    assert (together[counts[0] : counts[0] + counts[1]] - 7000).tolist() == alone.tolist()


def test_identifiers_that_collide_are_drawn_anew(frame, monkeypatch):
    """Under the first salt all chunks get one identifier: the verification
    sees it and the recipes use the next salt."""
    true, seen = C._identified, []

    def weak(raw, ends, salt):
        return [b"0" * C.ID_BYTES] * len(ends) if salt == 0 else true(raw, ends, salt)

    rows = [(1, "one"), (2, "two"), (3, "ONE")]
    docs = frame(rows)
    assert C.ambiguous(docs).isEmpty()
    monkeypatch.setattr(C, "ambiguous", lambda d, salt=0, text_col="text": seen.append(salt) or (d if salt == 0 else d.limit(0)))
    check(rows, C.duplicates(docs))
    assert seen == [0, 1]
    raw = np.frombuffer(b"onetwo", dtype=np.uint8)
    assert len(set(weak(raw, np.array([3, 6]), 0))) == 1 and len(set(weak(raw, np.array([3, 6]), 1))) == 2
    monkeypatch.setattr(C, "ambiguous", lambda d, salt=0, text_col="text": d)
    with pytest.raises(RuntimeError):
        C.duplicates(docs)


def test_ambiguous_finds_collisions(spark):
    pairs = spark.createDataFrame([(b"a", b"1"), (b"a", b"2"), (b"b", b"3"), (b"b", b"3")], "id binary, bytes binary")
    got = pairs.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id").collect()
    assert [bytes(r.id) for r in got] == [b"a"]


def test_join_back_splits_at_the_share(spark):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (3, 1)) for i in range(n)], "k int, i int")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for share in (1, 2, 1000):
        assert sorted(map(tuple, hot.join_back(rows, groups, "k", "n", 54, share).select("k", "i", "n").collect())) == sorted(
            (k, i, n) for k, n in ((1, 50), (2, 3), (3, 1)) for i in range(n))


def test_word_blocks_are_lowered():
    raw = np.frombuffer("AbÉ".encode(), dtype=np.uint8)
    assert bytes(W.LOWER[raw]) == "abÉ".encode()
