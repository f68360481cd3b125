"""Token ids of texts with a public tokenizer file, as little-endian uint32."""

from __future__ import annotations

import numpy as np

from .store import give_back

END_ID = 2
WORD_BPE = "word_bpe_49k.json"
_SEPARATOR = "\x00"
_LOADED: dict[str, "Encoder"] = {}


def vocabulary(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "Encoder":
    """The worker's encoder for that file (kept between tasks)."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def drop(path: str) -> None:
    """Give up the worker's encoder for that file and its word table."""
    known = _LOADED.pop(path, None)
    if known is not None:
        known.forget()
    del known
    give_back()


class Encoder:
    """Exact ids of whole texts.

    A vocabulary that drops white space encodes every space-separated word on
    its own, so words are looked up in a bounded table and only new ones are
    encoded, many in one call. Other vocabularies encode text by text."""

    LIMIT = 800_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self._direct(_SEPARATOR)
        probes = ("Ab c\n d", "x,\t y's", "é ß. 12")
        self.by_word = len(mark) == 1 and all(
            self._direct(p) == [i for w in p.split() for i in self._direct(w)] for p in probes)
        self.mark = mark[0] if self.by_word else None
        self.whole: dict[str, bytes] = {}
        self.core: dict[str, bytes] = {}
        self._prepare_letters(path)

    def _prepare_letters(self, path: str) -> None:
        """For words of Latin letters only: the same model behind a plain split
        at spaces, where a word's last id is known by its end-of-word suffix."""
        from tokenizers import Tokenizer, pre_tokenizers as pre

        self.letters, suffix = None, getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not self.by_word or not suffix:
            return
        plain = Tokenizer.from_file(path)
        plain.normalizer = None
        plain.pre_tokenizer = pre.Sequence([pre.WhitespaceSplit(), pre.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.letters = plain
        self.ends = np.zeros(max(plain.get_vocab().values()) + 1, dtype=bool)
        self.ends[[i for w, i in plain.get_vocab().items() if w.endswith(suffix)]] = True
        probes = ["word", "zyx", "été", "straße", "ñandú", "œuvre", "q" * 30]
        if self._letter_ids(probes) != [self._bytes(self._direct(p)) for p in probes]:
            self.letters = None

    def _letter_ids(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.letters.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        cut = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cut) != len(words):
            raise ValueError("a word has several ends")
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *cut.tolist()], cut.tolist())]

    def _direct(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.asarray(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str], end_id: int | None = END_ID) -> list[bytes]:
        """uint32 bytes of every text's ids, with ``end_id`` appended."""
        end = b"" if end_id is None else self._bytes([end_id])
        if not self.by_word:
            return [self._bytes(e.ids) + end for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        out: list[bytes] = []
        for i in range(0, len(texts), 256):
            some = texts[i : i + 256]
            # str.split also cuts at four control characters that the vocabulary keeps,
            # and a capital I with a dot becomes two characters in lower case
            odd = [any(c in t for c in "\x1c\x1d\x1e\x1f\u0130") for t in some]
            words = [None if o else t.split() for t, o in zip(some, odd)]
            self._learn(set().union(*(w for w in words if w)).difference(self.whole))
            known = self.whole
            out += [(self._bytes(self._direct(t)) if w is None else b"".join([known[x] for x in w])) + end for t, w in zip(some, words)]
            if len(self.whole) > self.LIMIT:
                self.whole.clear()
            if len(self.core) > self.LIMIT:
                self.core.clear()
        return out

    def forget(self) -> None:
        """Empty the word table, which otherwise serves the worker's next tasks."""
        self.whole.clear()
        self.core.clear()

    def _learn(self, words: set[str]) -> None:
        """Enter new words: a word's core (trailing stops and commas cut,
        plain letters in lower case) is encoded once for all its forms."""
        whole, core = self.whole, self.core
        forms, new = [], set()
        for w in words:
            if w.isalpha():
                c, tail = w, ""
            else:
                c = w.rstrip(".,")
                if not c or not c[-1].isalpha():
                    c = w
                tail = w[len(c) :]
            if c.isalpha() and max(c) < "\u0250":
                c = c.lower()
            if tail and tail not in core:
                new.add(tail)
            if c in core:
                whole[w] = core[c] + core[tail] if tail and tail in core else core[c]
                if not tail or tail in core:
                    continue
            else:
                new.add(c)
            forms.append((w, c, tail))
        if self.letters is not None:
            simple = [w for w in new if w.isalpha() and max(w) < "\u0250"]
            if simple:
                self.core.update(zip(simple, self._letter_ids(simple)))
                new = new.difference(simple)
        plain = [w for w in new if _SEPARATOR not in w]
        for w in new:
            if _SEPARATOR in w:
                self.core[w] = self._bytes(self._direct(w))
        if plain:
            joined = f" {_SEPARATOR} ".join(plain)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) != len(plain) - 1:
                raise ValueError("the separator's id occurs inside a word")
            data = ids.tobytes()
            for w, a, b in zip(plain, [0, *((cut + 1) * 4).tolist()], [*(cut * 4).tolist(), len(data)]):
                self.core[w] = data[a:b]
        for w, c, tail in forms:
            whole[w] = core[c] + core[tail] if tail else core[c]
