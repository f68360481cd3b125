import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from equisel.llm import lzprint, pseudolm, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_fingerprints_against_plain_parsing(frame, clashing, odd_rows):
    def phrases(text):
        data, seen, start = (text or "").encode(), set(), 0
        for end in range(1, len(data) + 1):
            if data[start:end] not in seen:
                seen.add(data[start:end])
                start = end
        return seen

    rows = [r for r in odd_rows if r[0] is not None and r[0] != 7]
    got = {r["doc_id"]: r for r in lzprint.fingerprints(clashing(rows)).collect()}
    order = sorted((i for i, _ in rows), reverse=True)
    texts = {i: t or "" for i, t in rows}
    for k, i in enumerate(order):
        text, following = texts[i], texts[order[(k + 1) % len(order)]]
        n = len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        r = got[i]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["edited_fingerprint"] == lzprint.text_of(lzprint.Parsed(edited).signature)
        if len(text) < 5000 and len(edited) < 5000:
            a, b = phrases(text), phrases(edited)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(exact - r["near_edited"]) < 0.2
            if len(a | b) <= lzprint.K:
                assert r["near_edited"] == pytest.approx(exact)
        assert 0 <= r["near_next"] <= 1
    same = {r["doc_id"]: r["fingerprint"] for r in got.values()}
    assert same[1] == same[2] == "" and same[6] != same[10]


def test_fingerprints_of_ties_and_few_rows(frame, odd_rows):
    assert lzprint.fingerprints(frame([])).count() == 0
    one = lzprint.fingerprints(frame([(5, "abcabc")])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    got = lzprint.fingerprints(frame(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    twins = [r for r in got if r["doc_id"] == 7]
    assert twins[0]["fingerprint"] == twins[1]["fingerprint"]
    assert len(lzprint.fingerprints(frame([(None, "a"), (None, "b")])).collect()) == 2


def test_long_text_is_parsed_in_segments(monkeypatch):
    monkeypatch.setattr(lzprint, "SEGMENT", 1000)
    text = "".join(chr(97 + (i * i) % 23) for i in range(5000))
    p = lzprint.Parsed(text)
    assert len(p.signature) == lzprint.K
    assert lzprint.likeness(p.signature, lzprint.Parsed(text + "x").signature) > 0.8


def test_risk_gradient_and_prior():
    tails = np.linspace(1, 0, 50)
    assert quality.estimate_prior(tails, 0.7 * tails + 0.3 * (np.arange(50) < 5), 1e6, 1e6) == pytest.approx(0.7, abs=0.02)


def test_quality_learns_without_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.scored(docs, labels).join(labels, "doc_id", "left").toPandas()
    held = out[out.held_out & out.quality.notna()]
    assert len(out) == 1000 and out.score.between(0, 1).all()
    assert (held.predicted == held.quality).mean() > 0.93


def test_toxicity_learns_without_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.scored(docs, labels).join(labels, "doc_id", "left").toPandas()
    held = out[out.held_out & out.toxic.notna()]
    assert len(out) == 1000 and (held.predicted == held.toxic).mean() > 0.93
    assert held[held.predicted == 1].toxic.mean() > 0.8


def _labelled(spark):
    return spark.createDataFrame([(6, 1, 1), (7, 0, 0), (None, 1, 1), (12, 1, 0), (99, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def test_scores_of_odd_rows(spark, clashing, frame, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (_labelled(spark), none):
        for out in (quality.scored(clashing(odd_rows), labels, steps=2), toxicity.scored(clashing(odd_rows), labels)):
            rows = out.collect()
            assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
        docs = clashing(odd_rows)
        assert toxicity.clean(docs, labels).schema == docs.schema
    assert quality.scored(frame([]), none).count() == 0 and toxicity.scored(frame([]), none).count() == 0


def test_kernel_norm_and_margins():
    words = ["idiot", "aaaa", "lostra", "xidiyotz"]
    for w in words:
        exact = {}
        n = len(w)
        for i in range(n):
            for j in range(i + 1, n):
                for k in range(j + 1, n):
                    u = w[i] + w[j] + w[k]
                    exact[u] = exact.get(u, 0) + toxicity.DECAY ** (k - i + 1)
        codes = np.frombuffer(w.encode("utf-32-le"), dtype=np.uint32)[None, :]
        assert toxicity.squared_norms(codes)[0] == pytest.approx(sum(v * v for v in exact.values()))
    # a machine with one landmark gives the normalised kernel value
    mark = toxicity.subsequences(toxicity.marked("idiot"))
    s = toxicity.Scorer(mark, 0.0, np.zeros(1))
    s.learn({"idiot", "idxiot", "table", "i"})
    want = toxicity.kernel([toxicity.subsequences(toxicity.marked(w)) for w in ("idiot", "idxiot", "table", "i")], [mark])[:, 0]
    assert [s.known[w] for w in ("idiot", "idxiot", "table", "i")] == pytest.approx(want.tolist())
    assert s.known["idiot"] == pytest.approx(1) and s.known["idxiot"] > 0.3 > s.known["table"]


def test_full_word_table_is_emptied_and_learnt_again(monkeypatch):
    mark = toxicity.subsequences(toxicity.marked("idiot"))
    logistic = np.ones(toxicity.TOP * len(toxicity.RAMPS) + 5)
    texts = [[f"word{i} idiot table{i % 3}" for i in range(k, k + 5)] for k in (0, 3, 40, 1)]
    plain = toxicity.Scorer(mark, 0.0, logistic)
    want = [plain.score(t).tolist() for t in texts]
    monkeypatch.setattr(toxicity.Scorer, "LIMIT", 3)
    small = toxicity.Scorer(mark, 0.0, logistic)
    assert [small.score(t).tolist() for t in texts] == want


def test_spaced_words_are_joined():
    assert "idiot" in toxicity.words_of("you i d i o t there") and "idiot" in toxicity.words_of("(IDIOT!!)")


def test_network_gradient():
    r = np.random.default_rng(0)
    net = pseudolm.Network.start(np.arange(1024.0))
    ctx, target = r.integers(0, 1025, (2 * pseudolm.SPAN, 50)), r.integers(0, 1024, 50)
    grads = pseudolm.Network(1024)
    net.scores(ctx, target, grads)
    fine = net.flat.astype(np.float64)
    for i in [i for i in r.integers(0, len(fine), 4000) if abs(grads.flat[i]) > 1e-3][:30]:
        ends = []
        for d in (1e-5, -1e-5):
            moved = fine.copy()
            moved[i] += d
            ends.append(pseudolm.Network(1024, moved).scores(ctx, target).sum())
        assert -(ends[0] - ends[1]) / 2e-5 == pytest.approx(grads.flat[i], rel=1e-2, abs=1e-3)


def test_pseudo_likelihood(spark, frame, clashing, odd_rows, words):
    rows = clashing(odd_rows)
    out = {(r["doc_id"], r["n_tokens"]): r for r in pseudolm.scored(rows).collect()}
    assert out[(1, 0)]["log_likelihood"] == 0 and out[(1, 0)]["mean_log_prob"] is None
    assert out[(4, 1)]["mean_log_prob"] < 0
    assert pseudolm.scored(frame([])).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total = lambda f: (lambda r: r["l"] / r["n"])(f.selectExpr("sum(log_likelihood) l", "sum(n_tokens) n").first())
    plain, trained = total(pseudolm.scored(docs, rounds=0)), total(pseudolm.scored(docs, rounds=3))
    assert trained > plain > -np.log(1024)


def test_window_neighbours_stay_inside_the_document():
    ids, doc = np.arange(6), np.array([0, 0, 0, 1, 1, 1])
    got = pseudolm.around(ids, doc, np.array([0, 2, 3]), 99)
    assert got[:, 1].tolist() == [99, 0, 1, 99, 99, 99] and got[:, 2].tolist() == [99, 99, 99, 4, 5, 99]


def test_likelihood_of_every_word_is_its_own(frame, clashing):
    texts = [(1, "Rare rare once other " * 3 + "unique"), (1, "other twin twin"), (None, "twin rare"), (2, None), (3, "")]
    many = [(9, " ".join(f"w{i}" for i in range(3000) for _ in range(2)))]  # more words than the model has ids
    docs = clashing(texts + many)
    count = Counter(w for _, t in texts + many for w in (t or "").lower().split())
    vocabulary, net, _, _ = pseudolm.train(docs, rounds=0)
    hashed = {w: h for w in count for _, _, h in pseudolm._tokens(pa.array([w]))}
    ids = {w: int(vocabulary.of(h)[0]) for w, h in hashed.items()}
    bucket = Counter()
    for w, n in count.items():
        bucket[ids[w]] += n
    by_id = {(r["doc_id"], r["n_tokens"]): r for r in pseudolm.scored(docs, rounds=0).collect()}
    for held in (1, 1000, 1 << 18):  # all words joined, some, none
        out = pseudolm.likelihoods(docs, rounds=0, held=held).collect()
        assert len(out) == len(texts) + 1
        got = {(r["doc_id"], r["n_tokens"]): r for r in out}
        for i, t in texts + many:
            w = (t or "").lower().split()
            share = sum(math.log(count[x] / bucket[ids[x]]) for x in w if ids[x] >= net.v - pseudolm.BUCKETS)
            r = got[(i, len(w))]
            assert r["log_likelihood"] == pytest.approx(by_id[(i, len(w))]["log_likelihood"] + share)
            assert r["mean_log_prob"] == (pytest.approx(r["log_likelihood"] / len(w)) if w else None)
    assert pseudolm.likelihoods(frame([])).count() == 0


def test_word_probabilities_of_a_context_sum_to_one(frame):
    docs = frame([(i, " ".join(f"w{(i * 7 + k) % 2000}" for k in range(20))) for i in range(150)])
    vocabulary, net, counted, counts = pseudolm.train(docs)
    table = counted.toPandas()
    h = table.h.to_numpy().view(np.uint64)
    ids = vocabulary.of(h)
    shares = pseudolm.Shares(h, table.n.to_numpy(), counts[net.v - pseudolm.BUCKETS :])
    ctx = np.random.default_rng(1).integers(0, net.v, (2 * pseudolm.SPAN, 1))
    logs = net.scores(np.repeat(ctx, len(h), axis=1), ids).astype(float) + np.where(ids >= net.v - pseudolm.BUCKETS, shares.of(h)[0], 0)
    used = np.unique(ids)  # ids that no word has keep a little of the softmax
    assert np.exp(logs).sum() == pytest.approx(np.exp(net.scores(np.repeat(ctx, len(used), axis=1), used).astype(float)).sum(), rel=1e-4)


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_every_position_is_a_target_once(clashing, odd_rows, monkeypatch, rounds):
    seen, mean = [], pseudolm._mean

    def noted(vectors, tasks):
        seen.append(sum(r["weight"] for r in vectors.collect()))
        return mean(vectors, tasks)

    monkeypatch.setattr(pseudolm, "_mean", noted)
    docs = clashing(odd_rows)
    pseudolm.train(docs, rounds=rounds)
    tokens = pseudolm.word_counts(docs).groupBy().sum("n").first()[0]
    assert len(seen) == rounds and sum(seen) == tokens and min(seen) > 0.2 * tokens
    # a text's rounds do not depend on the rows around it
    of = lambda *texts: [pseudolm.turns(w, h, 2).tolist() for _, w, h in pseudolm._tokens(pa.array(texts))][0]
    assert of("a b c a", "d e") == of("a b c a") + of("d e")
