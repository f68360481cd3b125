import hashlib
import re

import pytest

from equisel.llm import decontam, urls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs, items, window=13):
    wind = {}
    for item, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wind.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in wind}
    out = []
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                got = wind.get(tuple(w[s : s + n]))
                if got:
                    found |= got
                    hit |= set(range(s, s + n))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((-1 if i is None else i, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.fixture(scope="module")
def items(spark, words):
    rows = [(1, words(30, 200, 50)), (2, words(13, 201, 50)), (10, "short one"), (11, "short one"), (12, None), (13, "!?"), (14, words(40, 202, 9)),
            (15, "w1"), (16, words(30, 200, 50)), (None, words(20, 203))]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("shard_chars", [8_000_000, 150])
def test_contamination_against_brute_force(frame, words, items, odd_rows, clashing, shard_chars):
    rows, table = items
    docs = [(100 + n, f"{words(n * 7, n, 50)}. {words(30, 200, 50).upper()[:60 * (n % 3)]} Short-ONE {words(25, 300 + n, 9)}") for n in range(12)]
    docs += odd_rows
    found = decontam.contamination(clashing(docs), table, shard_chars=shard_chars)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:]) for r in decontam.digest(found).collect())
    want = brute(docs, [r for r in rows if r[0] is not None])
    # an item without an id is reported as the text None would be: it hits, but has no id
    assert [g[:3] for g in got] == [w[:3] for w in brute(docs, rows)]
    assert len(got) == len(want)


def test_items_and_removal(frame, clashing, odd_rows, words, items):
    rows, table = items
    rows = [r for r in rows if r[0] is not None]
    table = table.where("item_id IS NOT NULL")
    docs = [(1, f"x {words(30, 200, 50)} y"), (2, f"{words(600, 8, 90_000)} short one"), (3, None), (4, "clean text of no item"), (5, "Short, one")]
    got = sorted(tuple(r) for r in decontam.digest(decontam.contamination(frame(docs), table)).collect())
    assert got == brute(docs, rows)
    for shard_chars in (8_000_000, 150):
        kept = decontam.remove(clashing(docs), table, shard_chars=shard_chars)
        assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, *_, bad in brute(docs, rows) if not bad]
        assert kept.schema == clashing(docs).schema


@pytest.mark.parametrize("shard_chars", [8_000_000, 150])
def test_long_spans_are_cut_against_brute_force(clashing, words, items, odd_rows, shard_chars):
    rows, table = items
    whole = words(30, 200, 50)
    docs = [(1, f"été {whole} y"), (2, f"{words(1000, 8, 90_000)} {whole.upper()}! {words(1000, 9, 90_000)}"), (3, f"{whole}; {words(13, 201, 50)}"),
            (4, f"x {words(13, 201, 50)} 中文 short one"), (None, f"a {whole}"), (1, f"other {whole} z"), *odd_rows]
    wind = {tuple(w[i : i + min(13, len(w))]) for w in (WORD.findall((t or "").translate(LOWER)) for _, t in rows) for i in range(max(0, len(w) - 13) + 1) if w}

    def brute_cut(text, limit):
        found = list(WORD.finditer((text or "").translate(LOWER)))
        w, hit = [m.group() for m in found], set()
        for n in {len(x) for x in wind}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wind:
                    hit |= set(range(i, i + n))
        out, at, i = "", 0, 0
        while i < len(w):
            j = i
            while j in hit:
                j += 1
            if j - i > limit:
                out, at = out + text[at : found[i].start()], found[j - 1].end()
            i = max(j, i + 1)
        return text if text is None else out + text[at:]

    for limit in (12, 0, 20):
        left = decontam.cut(clashing(docs), table, limit=limit, shard_chars=shard_chars)
        assert left.schema == clashing(docs).schema
        assert sorted((str(r["doc_id"]), str(r["text"])) for r in left.collect()) == sorted((str(i), str(brute_cut(t, limit))) for i, t in docs)
    left = {r["doc_id"]: r["text"] for r in decontam.cut(clashing(docs[1:2]), table).collect()}
    assert len(WORD.findall(left[2])) == 2000  # below 5 % of the words, so remove() keeps the item


def test_empty_benchmark_and_documents(spark, frame, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] or r["n_hit"] for r in decontam.contamination(frame(odd_rows), none).collect())
    assert decontam.contamination(frame([]), none).count() == 0
    assert decontam.remove(frame(odd_rows), none).count() == len(odd_rows)


PAGES = "page_id long, url string, html string"


def link(to):
    return f'<html><head><LINK rel="canonical" href="{to}"></head></html>'


def test_rules_hosts_and_paths(spark):
    rows = [(1, "HTTP://WWW.Example.COM/en/x?y#z", None), (2, "http://a.example.com/en/", ""), (3, "http://example.com/e", None), (4, None, None),
            (5, "no scheme", None), (6, "http://x.net?q=/es/", None), (7, "http://x.net/es/1", None), (8, "http://badexample.com/en/", None),
            (9, "http://", None), (9, "http://", None), (None, "ftp://x.net/fr/", None), (10, "x://h#/en/", None)]
    docs = spark.createDataFrame(rows, PAGES)
    got = {r["page_id"]: tuple(r)[1:5] for r in urls.judge(docs).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[3][2:] == ("com/", "allow") and got[4] == ("", "", None, "allow") == got[5] == got[9]
    assert got[6] == ("x.net", "", None, "allow") and got[7][2:] == ("net/es/", "block")
    assert got[8][2:] == ("com/", "allow") and got[None][2:] == ("net/fr/", "block") and got[10][:2] == ("h", "")
    listed = sorted(map(str, urls.judge(docs).collect()))
    table = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    assert sorted(map(str, urls.judge(docs, table).select(urls.judge(docs).columns).collect())) == listed
    assert urls.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_aliases_carry_blocks_unless_allowed(spark):
    rows = [
        (1, "http://a.org/1", link("http://b.org/2")), (2, "https://b.org/2#x", '<meta http-equiv="refresh" content="0; url=/3">'),
        (3, "http://b.org/3", link("http://bad.net/es/9")),  # blocked although the target is no page
        (4, "http://c.org/1", link("http://bad.net/es/8")), (5, "http://c.org/2", link("/1")), (6, "http://good.com/", link("http://c.org/2")),
        (7, "http://d.org/x/y", '<link href="z" rel=canonical>'), (8, "http://d.org/x/z", None), (9, "http://e.org/", "<link rel=stylesheet href=http://bad.net/es/9>"),
        (10, "http://b.org/2", None)]
    got = {r["page_id"]: (r["verdict"], r["component"]) for r in urls.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[i][0] for i in (1, 2, 3, 10)] == ["block"] * 4
    assert [got[i][0] for i in (4, 5, 6)] == ["allow"] * 3  # an explicitly allowed member outweighs the block
    assert got[7][1] == got[8][1] == "d.org/x/y" and got[9] == ("allow", None)


def test_given_pages_have_no_aliases(spark):
    assert urls.alias_edges(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).count() == 0
