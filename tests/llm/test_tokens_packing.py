import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from equisel.llm import dac, packing, tokens as T


@pytest.fixture(scope="module")
def direct():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(T.vocabulary())
    return lambda text: np.array(tk.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")


def test_word_table_equals_plain_encoding(direct):
    r, e = random.Random(5), T.Encoder(T.vocabulary())
    pool = list("abzAZéÉßĿŉΣσςİıá.,'’s!?-<|>1٣\x00\x1c\x85\xa0 \t\n中") + ["<|endoftext|>", "'ll", " ", "THE", "İstanbul", "ΑΣ"]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(14))) for _ in range(4000)]
    for t, ids in zip(texts, e.encode(texts)):
        assert ids == direct(t).tobytes(), t


def test_full_word_table_is_emptied(direct, monkeypatch):
    monkeypatch.setattr(T.Encoder, "LIMIT", 5)
    e = T.Encoder(T.vocabulary())
    texts = [f"some words {i}, Some. words{i % 7}" for i in range(600)]
    assert e.encode(texts) == [direct(t).tobytes() for t in texts]
    e.forget()
    assert not e.whole and e.encode(texts[:3]) == [direct(t).tobytes() for t in texts[:3]]


def test_other_vocabulary_is_encoded_text_by_text():
    e = T.Encoder(T.vocabulary("byte_bpe_50k.json"))
    assert not e.by_word
    assert np.frombuffer(e.encode(["a  b\n"], None)[0], "<u4").tolist() == e._direct("a  b\n")


def _check_pieces(rows, docs, direct, window):
    ids = {}
    for i, t in docs:
        ids.setdefault(i, []).append(direct(t))
    per, fills = {}, {}
    for r in rows:
        fills.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        per.setdefault(r["doc_id"], []).append(r)
    for i, want in ids.items():
        if len(want) == 1:
            at = 0
            for r in sorted(per[i], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(want[0])
                assert r["ids_crc32"] == zlib.crc32(want[0][at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(want[0])
        else:
            assert sum(r["length"] for r in per[i]) == sum(map(len, want))
    padded = 0
    for pieces in fills.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        padded += 0 if at & (at - 1) == 0 else window - at
    return padded


def test_packing_covers_every_id_once_without_padding(spark, clashing, odd_rows, direct):
    rows = packing.pack(clashing(odd_rows), with_ids=False).collect()
    assert _check_pieces(rows, odd_rows, direct, 4096) == 0
    small = packing.pack(clashing(odd_rows), window=64, max_open=3).collect()
    assert _check_pieces(small, odd_rows, direct, 64) == 0
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in small)


def test_pipeline_delivers_the_packed_ids(spark, clashing, odd_rows, direct, monkeypatch):
    monkeypatch.setattr(packing, "HELD_BYTES", 10_000)
    rows = corpus_pipeline.pack(spark, clashing(odd_rows), "").collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    assert sorted(tuple(r)[:7] for r in rows if r["doc_id"] is not None) == sorted(
        tuple(r) for r in packing.pack(clashing(odd_rows), with_ids=False).collect() if r["doc_id"] is not None)
    got = b"".join(r["ids"] for r in sorted((r for r in rows if r["doc_id"] == 8), key=lambda r: r["start"]))
    assert np.frombuffer(got, dtype="<u4").tolist() == list(direct(dict(odd_rows)[8]))


def test_packer_chooses_the_least_sum_of_squares():
    p = packing.Packer(10, 100)
    ids = lambda n: bytes(4 * n)
    for n, levels in ((4, {4}), (4, {8}), (6, {6, 8}), (2, {6}), (3, {9})):
        # a second window of one level costs 3, a move to a free level nothing, a full window gains 1
        list(p.add("d", ids(n)))
        assert set(np.flatnonzero(p.level)) == levels
    assert p.sequence == 1 and p.n_open == 1


def test_packing_of_an_empty_table(frame):
    assert packing.pack(frame([])).count() == 0


@pytest.mark.parametrize("bits", [3, 8])
def test_codes_round_trip_and_random_access(bits):
    r = np.random.default_rng(3)
    for ids in ([], [0], [1, 300, 70_000, 5, 2**32 - 1] * 700, r.integers(0, 49_408, 5000)):
        a = np.array(ids, dtype="<u4")
        s = dac.Shard(dac.encode(a, bits))
        assert len(s) == len(a) and (s.all() == a).all()
        assert [s[i] for i in range(0, len(a), 37)] == a[::37].tolist()
        with pytest.raises(IndexError):
            s[len(a)]
    with pytest.raises(ValueError):
        dac.Shard(b"nothing")


def test_token_files(spark, clashing, odd_rows, direct):
    target = dac.write(clashing(odd_rows), shard_tokens=2000)
    rows = sorted(dac.documents(spark, target).collect(), key=lambda r: r["start"])
    order = sorted((i for i, _ in odd_rows), key=lambda i: (i is not None, i))
    assert [r["doc_id"] for r in rows] == order
    at, every = 0, []
    want = {}
    for i, t in odd_rows:
        want.setdefault(i, []).append(direct(t).tobytes())
    for r in rows:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        want[r["doc_id"]].remove(bytes(r["ids"]))
        every += np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        at += r["n_tokens"]
    assert not any(want.values())
    asked = spark.range(0, at, 1999).withColumnRenamed("id", "pos")
    found = dac.lookup(asked, target, shard_tokens=2000).collect()
    assert {(r["pos"], r["id"]) for r in found} == {(p, every[p]) for p in range(0, at, 1999)}


def test_token_files_of_an_empty_table(spark, frame):
    assert dac.documents(spark, dac.write(frame([]))).count() == 0


def test_kept_costs_follow_the_counts():
    rng = np.random.default_rng(3)
    packer = packing.Packer(window=16, max_open=5)
    for i in range(400):
        list(packer.add(i, bytes(4 * int(rng.integers(1, 40)))))
        n = packer.level
        assert n.sum() == packer.n_open
        come, go = 2 * n + 1, np.where(n > 0, 2 * n - 1, -16 * 5)
        come[-1] = go[0] = 0
        assert (packer.come == come).all() and (packer.go == go).all()
