"""op5: words of any length, whole scores by hand, settings; clashing names; text ids; links in any form."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from equisel.llm import decontam, lzprint, neardup, toxicity, urls

CLEAN = [f"w{c}{d}rd" for c in "abcdefghij" for d in "klmnopqrst"]


def texts(insult, n=600, seed=1, spaced=False):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice(CLEAN) for _ in range(30)] + ["of", "it", "a", "I"]
        if i % 3 == 0:
            words[r.randrange(30)] = insult
        r.shuffle(words)
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def held_out_caught(spark, frame, rows):
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.scored(frame([(i, t) for i, t, _ in rows]), labels).where("held_out").collect()}
    toxic = [i for i, _, t in rows if t and i in out]
    clean = [i for i, _, t in rows if not t and i in out]
    return np.mean([out[i].predicted for i in toxic]), np.mean([out[i].predicted for i in clean]), len(toxic)


@pytest.mark.parametrize("insult", ["zqx", "zq", "§", "zqxwv", "q" * 3 + "zumplerquastenbolzentroetel"])
def test_insults_of_any_length_are_learnt(spark, frame, insult):
    caught, wrong, n = held_out_caught(spark, frame, texts(insult))
    if insult == "§":  # a lone sign is cut as outer punctuation or kept as a word, as words_of says
        assert n > 50 and (caught == 1.0) == (insult in toxicity.words_of(f"a {insult} b"))
    else:
        assert n > 50 and caught == 1.0 and wrong == 0.0


def test_pieces_of_short_and_long_words(spark):
    words = ["a", "ab", "abc", "abcd", "abcdefgh", "x" * 60]
    got = {r.word: set(r.p) for r in spark.createDataFrame([(w,) for w in words], "word string").withColumn("p", toxicity._pieces((4, 5))).collect()}
    assert got == {w: toxicity.pieces_of(w, (4, 5)) for w in words}
    assert got["a"] == {"\x02a\x03"} and got["ab"] == {"\x02ab\x03"} and "\x02abc" in got["abc"]


def test_settings_bound_the_sample_only(spark, frame):
    rows = texts("zqxwv")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    docs = frame([(i, t) for i, t, _ in rows])
    small = toxicity.Settings(sample=200, landmarks=20, positives=5, negatives=60, hard=10, rounds=2, marks=20)
    out = toxicity.scored(docs, labels, by=small).collect()
    assert len(out) == 600 and sum(r.predicted for r in out) == 200
    assert toxicity.scored(docs, labels, sample=90).count() == 600


def test_whole_scores_by_hand(spark, frame):
    """Every score again: kernel values against the landmarks' weights word by
    word, ramps of the highest margins, the logistic function."""
    rows = texts("zqxwv", 150) + [(900, "", 0), (901, "I d i o t s z q x w v here", 0), (902, "x" * 80, 0), (903, "ZqXwV!! z-qxwv", 1)]
    docs = frame([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    scorer = toxicity.train(docs.select("doc_id", "text"), labels, "toxic")
    letters = {i: c for c, i in scorer.code.items()}
    weights, size = {}, scorer.size
    for at in np.flatnonzero(scorer.table):
        a, b, c = int(at) // size**2, int(at) // size % size, int(at) % size
        weights[letters[a] + letters[b] + letters[c]] = scorer.table[at]

    def margin(word):
        return max(sum(v * weights.get(u, 0.0) for u, v in toxicity.subsequences(p).items()) + scorer.bias for p in toxicity._parts(word))

    got = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    for i, text, _ in rows:
        m = sorted((margin(w) for w in toxicity.words_of(text)), reverse=True)
        best = (m + [-2.0] * toxicity.TOP)[: toxicity.TOP]
        x = [min(1.0, max(0.0, (b - r) * 4)) for r in toxicity.RAMPS for b in best]
        x += [math.log1p(sum(v > c for v in m)) for c in (0, 0.25, 0.5)] + [math.log1p(len(m)), 1.0]
        z = float(np.dot(x, scorer.logistic))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))), rel=1e-6, abs=1e-9)


def test_tables_with_the_names_used_inside(frame, words):
    rows = [(1, words(90, 1)), (2, words(90, 1)), (3, words(90, 2)), (None, words(90, 3))]
    docs = frame(rows)
    for c in ("_id", "_th", "_spans", "_ID_"):
        docs = docs.withColumn(c, F.lit(c))
    kept = neardup.dedup(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    bench = docs.sparkSession.createDataFrame([("a", words(90, 2)), ("b", words(40, 9))], "item_id string, text string")
    for chars in (decontam.SHARD_CHARS, 10):
        gone = decontam.remove(docs, bench, shard_chars=chars)
        assert gone.columns == docs.columns and sorted(str(r.doc_id) for r in gone.collect()) == ["1", "2", "None"]
        cut = decontam.cut(docs, bench, shard_chars=chars)
        assert cut.columns == docs.columns and {r.doc_id: len(r.text) > 100 for r in cut.collect()}[3] is False


def test_fingerprints_of_text_ids(spark, words):
    rows = [(f"doc-{i:03d}", words(30 + i, i)) for i in range(40)] + [("doc-001", words(31, 1)), (None, "no id")]
    shape = "doc_id string, text string"
    by_text = {r.doc_id: r for r in lzprint.fingerprints(spark.createDataFrame(rows, shape).repartition(3)).collect()}
    numbered = spark.createDataFrame([(None if i is None else int(i[4:]), t) for i, t in rows], "doc_id long, text string").repartition(3)
    by_number = {r.doc_id: r for r in lzprint.fingerprints(numbered).collect()}
    assert len(by_text) == len(by_number) == 41
    for i in range(40):  # the same order of ids, so the same neighbours
        a, b = by_text[f"doc-{i:03d}"], by_number[i]
        assert (a.fingerprint, a.edited_sha256, a.near_next) == (b.fingerprint, b.edited_sha256, b.near_next)


LINKS = [
    ('<meta content="0; url=http://example.com/en/x" http-equiv="refresh">', "example.com/en/x"),
    ("<META HTTP-EQUIV=Refresh CONTENT='5;URL=\"../en/x\"'>", "a.example.com/en/x"),
    ('<link href=" /p/../q/./r " rel="nofollow Canonical">', "a.example.com/q/r"),
    ('<link rel=canonical href=//b.com/..>', "b.com/"),
    ('<link rel="canonical" href="../../../up/../z/..">', "a.example.com/"),
    ('<link rel="stylesheet" href="/canonical.css"><meta name="refresh" content="url=/no">', None),
    ('<link rel="canonical" href="?q=1">', "a.example.com/d/?q=1"),
]


@pytest.mark.parametrize("html,want", LINKS)
def test_edges_in_any_form(spark, html, want):
    pages = spark.createDataFrame([(1, "http://a.example.com/d/page?x=1#f", html)], "page_id long, url string, html string")
    assert [(r.a, r.b) for r in urls.alias_edges(pages).collect()] == ([("a.example.com/d/page?x=1", want)] if want else [])


def test_all_links_of_a_page_and_blocks_carried(spark):
    html = '<link rel="canonical" href="http://c.com/1"><link href=http://c.com/2 rel=canonical><meta content="1;url=../../en/x" http-equiv=refresh>'
    rows = [(1, "http://example.com/d/page", html), (2, "http://c.com/1", None), (3, "http://example.com/en/x", None), (4, "http://other.org/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert urls.alias_edges(pages).count() == 3
    rules = [("example.com", "/en/", "block")]
    assert {r.page_id: r.verdict for r in urls.judge(pages, rules).collect()} == {1: "block", 2: "block", 3: "block", 4: "allow"}
