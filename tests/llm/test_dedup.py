import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from equisel.llm import components, neardup, substring

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])


def brute_components(rows, size=4):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return [(i, len(sets[x]), least.get(find(x))) for x, (i, _) in enumerate(rows)]


def family(words, seed, n, base=60):
    """Copies of one text with more and more words changed."""
    import random

    r, out = random.Random(seed), []
    text = words(base, seed).split()
    for k in range(n):
        t = list(text)
        for _ in range(r.randrange(0, 6)):
            t[r.randrange(len(t))] = f"z{r.randrange(10_000)}"
        out.append(" ".join(t))
    return out


def test_components_against_union_find(spark):
    import random

    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(500, 560)] + [(700, i) for i in range(701, 760)]
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    assert all(got.get(x, x) == find(x) for e in edges for x in e)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_against_brute_force(frame, words, monkeypatch):
    rows, n = [], 0
    for seed, size in ((1, 40), (2, 6), (3, 1)):
        for t in family(words, seed, size):
            rows.append((n, t))
            n += 1
    rows += [(n + 1, rows[0][1].upper()), (n + 2, "a b"), (n + 3, "A  b\n"), (n + 4, "a"), (n + 5, None), (n + 6, "")]
    for cold, size in ((48, 4), (4, 4), (4, 5)):  # a small COLD sends the large family through the frequent lists
        monkeypatch.setattr(neardup, "COLD", cold)
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(frame(rows), size=size).collect())
        assert got == sorted((i, n, c, i == c) for i, n, c in brute_components(rows, size))


def test_near_duplicates_on_the_given_documents(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    monkeypatch.setattr(neardup, "COLD", 2)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, size=4).collect())
    assert got == sorted(brute_components(rows))


def test_rows_that_share_an_id_go_by_their_own_text(clashing, words):
    first = words(90, 1)
    docs = [(1, first), (5, first + " more"), (5, words(90, 2)), (5, None), (5, ""), (6, words(90, 2)), (None, first), (None, None), (1, first)]
    left = neardup.dedup(clashing(docs))
    assert sorted(map(str, (tuple(r)[:2] for r in left.collect()))) == sorted(map(str, [d for d in docs if d not in (docs[1], docs[5])]))


def test_near_duplicates_of_odd_rows(clashing, odd_rows, frame):
    got = neardup.near_duplicates(clashing(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["n_shingles"] == 0 and by[1]["kept"] and by[2]["component_id"] == 2
    assert by[7]["component_id"] == 6 and not by[7]["kept"] and by[10]["component_id"] == 6
    assert all(r["kept"] for r in got if r["doc_id"] is None)
    docs = clashing(odd_rows)
    left = neardup.dedup(docs)
    assert left.schema == docs.schema
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == sorted(i or 0 for i, _ in odd_rows if i not in (7, 10))
    assert neardup.near_duplicates(frame([])).count() == 0 and neardup.dedup(frame([])).count() == 0


def brute_passages(rows, k):
    lists = [WORD.findall(t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i : i + k]) for w in lists for i in range(len(w) - k + 1))
    out = []
    for (i, _), w in zip(rows, lists):
        gone = {p for s in range(len(w) - k + 1) if count[tuple(w[s : s + k])] > 1 for p in range(s, s + k)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("k,m,hot", [(35, 8, 2000), (35, 8, 1), (6, 2, 2), (5, 5, 1)])
def test_passages_against_brute_force(frame, words, k, m, hot):
    common = words(50, 77)
    rows = [(n, f"{words(20 + n, n)} {common if n % 3 else ''} {words(15, 100 + n)}") for n in range(12)]
    rows += [(20, " ".join(["again and again"] * 30)), (21, words(80, 5)), (22, words(80, 5)), (23, None), (24, ""), (25, "a  b")]
    found = substring.digest(substring.passages(frame(rows), k=k, m=m, hot=hot)).collect()
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found)
    assert got == brute_passages(rows, k)


def test_passages_of_odd_rows(clashing, odd_rows, frame):
    docs = clashing(odd_rows)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])
                 for r in substring.digest(substring.passages(docs)).collect())
    assert got == brute_passages(odd_rows, 35)
    cut = substring.dedup(docs)
    assert cut.schema == docs.schema and cut.count() == len(odd_rows)
    texts = {r["doc_id"]: r["text"] for r in cut.where("doc_id IS NOT NULL").collect()}
    assert texts[3] == "   \n\t " and texts[1] is None and texts[6] == "" and texts[12] == dict(odd_rows)[12]
    assert cut.select(F.countDistinct("_rk")).first()[0] == 1
    assert substring.passages(frame([])).count() == 0 and substring.dedup(frame([])).count() == 0
