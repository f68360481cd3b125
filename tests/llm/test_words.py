import random
import re

import numpy as np
import pyarrow as pa

from equisel.llm import words as W


def test_words_match_the_pattern_and_equal_words_have_equal_hashes():
    texts = ["a b  c", "", None, "Ab\tcd é\xa0x ", " lead trail ", "x" * 5000 + " y", "a", "b c"]
    for limit in (8, 1 << 20):
        seen = {}
        for i, j, raw, offs in W.blocks(W.text_array(pa.array(texts)), limit):
            w = W.Words(raw, offs, W.WHITE)
            h = w.hashes().tolist()
            for k in range(j - i):
                at = range(w.first[k], w.first[k + 1])
                found = [bytes(raw[w.start[x] : w.end[x]]).decode() for x in at]
                assert found == re.findall(r"[^\x20\x09-\x0D]+", texts[i + k] or "")
                for x, word in zip(at, found):
                    assert seen.setdefault(word, h[x]) == h[x]
        assert len(set(seen.values())) == len(seen)


def test_run_hashes_follow_the_polynomial():
    r = random.Random(1)
    h = np.array([r.getrandbits(64) for _ in range(200)], dtype=W.U)
    q = 0x9FB21C651E98DF25
    for n in (1, 2, 3, 4, 8, 13, 35):
        got = W.runs(h, n)
        assert len(got) == len(h) - n + 1
        want = sum(int(h[7 + j]) * pow(q, j, 1 << 64) for j in range(n)) % (1 << 64)
        assert got[7] == W.mix(np.array([want], dtype=W.U))[0]
    assert len(W.runs(h[:3], 4)) == 0


def test_sliding_min():
    x = np.random.default_rng(2).random(50)
    for n in (1, 2, 3, 28):
        assert W.sliding_min(x, n).tolist() == [x[i : i + n].min() for i in range(len(x) - n + 1)]
