"""Toxicity by a subsequence string kernel and Nyström landmarks.

The kernel compares strings by all subsequences of three characters; a gap
costs ``DECAY`` per character spanned (Lodhi et al., 2002), so an insult with
inserted or changed characters or a new ending stays close to the insult. A
sentence enters the kernel through its words (runs of single characters are
joined first: "i d i o t"), and is as toxic as its most toxic word, the usual
multiple-instance form. A linear support vector machine is trained on the
Nyström features ``K_mm^(-1/2) k(word, landmarks)``; a document's score is a
logistic function of its highest word margins, their number and its length.

Because the machine is linear in kernel values and each value is linear in
subsequence weights, the trained decision is one weight per subsequence: words
are scored by table look-up and divided by their own kernel norm.

Learning: labelled sentences are bags of words, those of a bounded,
hash-ordered sample of the learning fold (:class:`Settings`); see :func:`train`.
Words are counted by the different words before them, so copies of a text count
once. Words have any length; none is left out.

Scale: the sample is a broadcast of at most ``sample`` ids; scoring is one
map-side pass with a bounded table of known words in each task.

Defined cases: null and empty texts have no words and get the score of a text
without toxic words; rows are scored each by its text; a document with several
labels is toxic if one is; without toxic labels every score is 0; an empty table gives no
rows; other columns are ignored by :func:`scored` and kept by :func:`clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .quality import held_out, learning_fold
from .store import give_back, written

DECAY = 0.4
THRESHOLD = 0.7
#: Strings up to this length are compared whole, longer ones by overlapping parts.
LONGEST = 24
TOP = 3
#: Words times subsequences that are looked up at once.
CELLS = 200_000
RAMPS = (-0.5, -0.25, 0.0, 0.25, 0.5, 0.75)


@dataclass(frozen=True)
class Settings:
    """What training may use; all of it bounds a sample, none of it limits what
    is scored. ``sample``: labelled documents; ``landmarks``: strings of the
    Nyström features; ``positives`` and ``negatives``: words that a machine is
    trained on, ``hard`` more negatives per round; ``rounds``: machines, each with
    the witnesses of the one before; ``marks``: character pieces that point to
    the first witnesses, of the lengths ``pieces`` (a shorter word counts whole);
    ``rate``: how much more frequent in toxic documents; ``ridge``: of the machine."""

    sample: int = 20_000
    landmarks: int = 240
    positives: int = 600
    negatives: int = 4000
    hard: int = 1000
    rounds: int = 3
    marks: int = 400
    pieces: tuple = (4, 5)
    rate: float = 12.0
    ridge: float = 1e-3


DEFAULT = Settings()
SAMPLE = DEFAULT.sample
_SPACED = re.compile(r"(?:(?<=\s)|^)(?:\S\s){3,}\S(?=\s|$)")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’¿¡…"


def words_of(text: str) -> set[str]:
    """Distinct lower-case words without outer punctuation; runs of single
    characters (three different ones in the text at least) count joined, too."""
    text = text.lower()
    split = set(text.split())
    found = set([w.strip(_EDGE) for w in split])
    if len([w for w in split if len(w) == 1]) >= 3:
        found.update("".join(run.split()) for run in _SPACED.findall(text))
    found.discard("")
    return found


def in_context(text: str) -> tuple[list[str], list[str]]:
    """The words of a text and the word before each."""
    words = [w.strip(_EDGE) for w in text.lower().split()]
    words += ["".join(run.split()) for run in _SPACED.findall(text.lower())]
    pairs = {(w, b) for w, b in zip(words, ["", *words]) if w}
    return [w for w, _ in pairs], [b for _, b in pairs]


def marked(word: str) -> str:
    """The word with its begin and end as characters of their own."""
    return f"\x02{word}\x03"


def _parts(word: str) -> list[str]:
    """The marked word; a long string as overlapping parts."""
    word = marked(word)
    if len(word) <= LONGEST + 2:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def subsequences(word: str) -> dict[str, float]:
    """Weight of every three-character subsequence, scaled to norm 1."""
    out: dict[str, float] = {}
    n = len(word)
    for i in range(n - 2):
        for j in range(i + 1, n - 1):
            for k in range(j + 1, n):
                u = word[i] + word[j] + word[k]
                out[u] = out.get(u, 0.0) + DECAY ** (k - i + 1)
    norm = np.sqrt(sum(v * v for v in out.values()))
    return {u: v / norm for u, v in out.items()} if norm else out


class Strings:
    """Subsequence maps of many strings as flat arrays (string, subsequence
    number, weight)."""

    def __init__(self, maps: list[dict]):
        number: dict[str, int] = {}
        self.cols = np.array([number.setdefault(u, len(number)) for m in maps for u in m], dtype=np.int64)
        self.vals = np.array([v for m in maps for v in m.values()])
        self.rows = np.repeat(np.arange(len(maps)), [len(m) for m in maps])
        self.count, self.width, self.number = len(maps), len(number), number

    def like(self, m: dict) -> np.ndarray:
        """Normalised kernel value of every string with one map."""
        x = np.zeros(self.width)
        for u, v in m.items():
            if u in self.number:
                x[self.number[u]] = v
        return np.bincount(self.rows, weights=self.vals * x[self.cols], minlength=self.count)


def kernel(a: list[dict], b: list[dict]) -> np.ndarray:
    """Normalised kernel values of subsequence maps."""
    flat = Strings(a)
    return np.stack([flat.like(m) for m in b], axis=1) if b else np.zeros((len(a), 0))


def squared_norms(codes: np.ndarray) -> np.ndarray:
    """Kernel of each word with itself, before scaling; ``codes`` is words by
    characters. The recursion of Lodhi et al. with both sums over gaps as
    products with a matrix of decay powers."""
    n = codes.shape[1]
    gap = np.arange(n)[None, :] - np.arange(n)[:, None]
    decay = np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0.0)  # from an earlier to a later place
    before = np.roll(decay, 1, axis=1)  # shared prefixes end before the place that is matched
    before[:, 0] = 0
    same = (codes[:, :, None] == codes[:, None, :]) * (DECAY * DECAY)
    inner = same
    for _ in range(2):
        inner = same * np.matmul(before.T, np.matmul(inner, before))
    return inner.sum(axis=(1, 2))


class Scorer:
    """Word margins and document scores of a trained machine."""

    LIMIT = 250_000

    def __init__(self, weights: dict[str, float], bias: float, logistic: np.ndarray):
        self.bias, self.logistic = bias, logistic
        letters = sorted({c for u in weights for c in u})
        self.code = {c: i + 1 for i, c in enumerate(letters)}
        size = len(letters) + 1
        self.table = np.zeros(size**3)
        for u, v in weights.items():
            a, b, c = (self.code[x] for x in u)
            self.table[(a * size + b) * size + c] = v
        self.size = size
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def _margins(self, words: list[str]) -> np.ndarray:
        """Margins of words of one length."""
        n = len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), n)
        kinds, at = np.unique(points, return_inverse=True)
        codes = np.array([self.code.get(chr(p), 0) for p in kinds])[at.reshape(points.shape)]
        i, j, k = _triples(n)
        found = self.table[(codes[:, i] * self.size + codes[:, j]) * self.size + codes[:, k]]
        return found @ (DECAY ** (k - i + 1)) / np.sqrt(squared_norms(points)) + self.bias

    def margins(self, words: set[str]) -> dict[str, float]:
        """The margin of each word (of a long one: of its best part)."""
        best: dict[str, float] = {}
        by_length: dict[int, list] = {}
        for w in words:
            for p in _parts(w):
                by_length.setdefault(len(p), []).append((w, p))
        for pairs in by_length.values():
            step = max(16, CELLS // max(1, len(_triples(len(pairs[0][1]))[0])))
            for s in range(0, len(pairs), step):
                some = pairs[s : s + step]
                for (w, _), m in zip(some, self._margins([p for _, p in some]).tolist()):
                    best[w] = max(m, best.get(w, -np.inf))
        return best

    def learn(self, words: set[str]) -> None:
        self.known.update(self.margins(words))

    def top(self, texts: list[str]) -> np.ndarray:
        """Per text: how far its ``TOP`` highest word margins have passed each
        step of ``RAMPS`` (0 to 1), the logarithms of the number of words above
        three margins and of all words, and a constant."""
        best = np.full((len(texts), TOP), -2.0)
        rest = np.ones((len(texts), 5))
        sets = [words_of(t) for t in texts]
        if len(self.known) > self.LIMIT:  # before the look-up: what these texts need is learnt again
            self.known.clear()
        self.learn(set().union(*sets).difference(self.known))
        for i, s in enumerate(sets):
            m = np.fromiter(map(self.known.__getitem__, s), dtype=np.float64, count=len(s))
            most = np.sort(np.partition(m, -TOP)[-TOP:] if len(m) > TOP else m)[::-1]
            best[i, : len(most)] = most
            rest[i, :4] = (m > 0).sum(), (m > 0.25).sum(), (m > 0.5).sum(), len(m)
        rest[:, :4] = np.log1p(rest[:, :4])
        return np.concatenate([*(np.clip((best - r) * 4, 0, 1) for r in RAMPS), rest], axis=1)

    def forget(self) -> None:
        """Empty the table of known words (a task's end)."""
        self.known.clear()
        give_back()

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.top(texts) @ self.logistic, -40, 40)))


_TRIPLES: dict[int, tuple] = {}


def _triples(n: int) -> tuple:
    if n not in _TRIPLES:
        i, j, k = np.meshgrid(*[np.arange(n)] * 3, indexing="ij")
        keep = (i < j) & (j < k)
        _TRIPLES[n] = i[keep], j[keep], k[keep]
    return _TRIPLES[n]


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear support vector machine, squared hinge, by Newton steps on the
    rows inside the margin. ``y`` is -1 or 1."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        inside = y * (x @ w) < 1
        a = x[inside] * weight[inside, None]
        h = a.T @ x[inside] + ridge * np.eye(len(w))
        new = np.linalg.solve(h, a.T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def _gapped(word: str, k: int) -> str:
    """The word with one character inserted, by turns."""
    at = 1 + k % max(1, len(word) - 1)
    return word[:at] + "*-x."[k % 4] + word[at:]


def _spread(maps: list[dict], count: int) -> list[int]:
    """Indices of landmarks: in the order given, each string that is not close
    to one chosen before."""
    flat, chosen = Strings(maps), []
    like = np.zeros(len(maps))
    for i in range(len(maps)):
        if len(chosen) == count:
            break
        if like[i] < 0.8 and maps[i]:
            chosen.append(i)
            like = np.maximum(like, flat.like(maps[i]))
    return chosen


def _pieces(pieces: tuple):
    """The pieces of a marked word, each once; a word too short for the least
    length is its own piece."""
    whole = F.concat(F.lit("\x02"), F.col("word"), F.lit("\x03"))
    n = F.length(whole)

    def of(k: int):
        return F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(whole, i, F.lit(k)))

    return F.array_distinct(F.flatten(F.array(*map(of, pieces))))


def pieces_of(word: str, pieces: tuple) -> set[str]:
    """:func:`_pieces` of one word."""
    w = marked(word)
    return {w[i : i + k] for k in pieces for i in range(max(1, len(w) - k + 1))}


def _trained(good: list[str], seen: np.ndarray, bad: list[str], n_plain: int, by: Settings = DEFAULT) -> Scorer:
    """Machine on the Nyström features of the words; no logistic part yet."""
    maps = [subsequences(marked(w)) for w in good + bad]
    y = np.array([1.0] * len(good) + [-1.0] * len(bad))
    weight = np.concatenate([seen, np.ones(len(bad))])
    for sign in (1, -1):
        weight[y == sign] /= max(1e-12, weight[y == sign].sum())
    by_class = [maps[:n_plain], maps[len(good) :][::-1]]
    land = [m[i] for m, n in zip(by_class, (by.landmarks // 2, by.landmarks // 2)) for i in _spread(m, n)]
    values, vectors = np.linalg.eigh(kernel(land, land))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])  # K_mm^(-1/2), without its null space
    w, bias = _machine(kernel(maps, land) @ root, y, weight, by.ridge)
    weights: dict[str, float] = {}
    for g, m in zip((root @ w).tolist(), land):
        for u, v in m.items():
            weights[u] = weights.get(u, 0.0) + g * v
    return Scorer(weights, bias, np.zeros(TOP * len(RAMPS) + 5))


def train(docs: DataFrame, labels: DataFrame, label_col: str, sample: int | None = None, by: Settings = DEFAULT) -> Scorer | None:
    """Scorer from the learning fold's labels; ``docs`` has doc_id and text.

    The labelled documents are bags of words (multiple instances, Andrews et al.
    2002): a toxic one has a word that makes it so, its witness; a clean one has
    none. The first witnesses are words with character pieces that toxic
    documents favour. Each round trains a machine on the witnesses against words
    of clean documents, and takes from every bag the word that this machine finds
    most toxic: those of toxic bags are the next witnesses, where toxic documents
    favour the word itself; those of clean bags, and the worst clean words, the
    next negatives."""
    by = by if sample is None else replace(by, sample=sample)
    fold = labels.where(learning_fold("doc_id")).where(F.col(label_col).isNotNull()).groupBy("doc_id").agg(
        F.max(F.col(label_col)).cast("int").alias("toxic"))
    fold = fold.orderBy(F.xxhash64("doc_id"), "doc_id").limit(by.sample)
    taught = written(docs.join(F.broadcast(fold), "doc_id").select("text", "toxic"), "taught")  # rows of ``sample`` documents

    totals = taught.groupBy().agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not totals["t"] or totals["t"] == totals["n"]:
        return None

    def contexts(batches):
        for batch in batches:
            for text, toxic in zip(W.text_array(batch.column(0)).to_pylist(), batch.column(1).to_pylist()):
                words, before = in_context(text)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(before, pa.string()),
                                                  pa.array([toxic] * len(words), pa.int32())], ["word", "before", "toxic"])

    # different words before a word, so that copies of one text count once
    met = taught.mapInArrow(contexts, "word string, before string, toxic int").distinct()
    words = written(met.groupBy("word").agg(F.sum("toxic").cast("double").alias("t"), F.sum(1 - F.col("toxic")).cast("double").alias("c")), "words")
    mass = words.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    rate = lambda: (F.col("t") + 0.1) / mass["t"] / ((F.col("c") + 0.5) / mass["c"])
    marks = (words.select(F.explode(_pieces(by.pieces)).alias("piece"), "t", "c").groupBy("piece").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
             .where("t >= 3").withColumn("rate", rate()).where(f"rate > {by.rate}")
             .orderBy(F.desc(F.col("t") * F.log("rate")), "piece").limit(by.marks))
    marks = {r["piece"]: r["t"] * np.log(r["rate"]) for r in marks.collect()}

    def strength(batches):
        for batch in batches:
            best = [max((marks.get(p, 0.0) for p in pieces_of(w, by.pieces)), default=0.0) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.float64())], ["word", "t", "c", "strength"])

    words = written(words.mapInArrow(strength, "word string, t double, c double, strength double"), "strength")
    toxic_rate = rate()
    first = words.where("strength > 0 AND t > 0").where(toxic_rate > by.rate).orderBy(F.desc("t"), F.desc("strength"), "word").limit(by.positives).collect()
    common = words.where("c > 0").where(toxic_rate <= by.rate).orderBy(F.desc("c"), "word").limit(by.negatives // 2).collect()
    # clean words with a toxic piece, then any
    close = words.where("c > 0 AND strength > 0").where(toxic_rate <= by.rate).orderBy(F.desc("c"), "word").limit(by.negatives // 4).collect()
    other = words.where("c > 0 AND t = 0").orderBy(F.xxhash64("word"), "word").limit(by.negatives // 4).collect()
    if not first:
        return None
    seen = {r["word"]: r["t"] for r in first}  # a witness counts by the contexts it was met in
    bad = list(dict.fromkeys(r["word"] for rows in (common, close, other) for r in rows))
    for turn in range(by.rounds):
        good = list(seen)
        plain = np.minimum([seen[w] for w in good], 20.0)
        gapped = [_gapped(w, k) for k, w in enumerate(good)]
        scorer = _trained(good + gapped, np.concatenate([plain, plain / 2]), [w for w in bad if w not in seen], len(good), by)
        if turn + 1 < by.rounds:
            held = docs.sparkSession.sparkContext.broadcast(scorer)
            top = _witnesses(taught, held).groupBy("word", "toxic").agg(F.count(F.lit(1)).alias("bags"))
            top = written(top.join(words, "word"), "witnesses")
            found = top.where("toxic = 1 AND t > 0").where(toxic_rate > by.rate).orderBy(F.desc("bags"), "word").limit(by.positives).collect()
            wrong = top.where("toxic = 0").where(toxic_rate <= by.rate).orderBy(F.desc("bags"), "word").limit(by.hard).collect()
            hard = _worst(words.where("c > 0").where(toxic_rate <= by.rate).select("word"), held).orderBy(F.desc("margin"), "word").limit(by.hard).collect()
            for r in found:
                seen.setdefault(r["word"], r["t"])
            bad = list(dict.fromkeys([*bad, *(r["word"] for r in wrong), *(r["word"] for r in hard)]))
            held.destroy()

    def tops(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                x = scorer.top(W.text_array(part.column(0)).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column(1)], ["x", "toxic"])

    rows = taught.mapInArrow(tops, "x array<double>, toxic int").orderBy(F.xxhash64("x"), "x").limit(by.sample).collect()  # short rows
    x = np.array([r["x"] for r in rows])
    scorer.logistic = _logistic(x, np.array([r["toxic"] for r in rows], dtype=float))
    return scorer


def _witnesses(taught: DataFrame, held) -> DataFrame:
    """The word of every bag that the machine finds most toxic."""

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                sets = [words_of(t) for t in W.text_array(part.column(0)).to_pylist()]
                known = held.value.margins(set().union(*sets))
                best = [max(sorted(s), key=known.__getitem__, default=None) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(best, pa.string()), part.column(1)], ["word", "toxic"])

    return taught.mapInArrow(run, "word string, toxic int").where("word IS NOT NULL")


def _worst(words: DataFrame, held) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = batch.column(0).to_pylist()
            known = held.value.margins(set(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([known[w] for w in found], pa.float64())], ["word", "margin"])

    return words.mapInArrow(run, "word string, margin double")


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = np.diag([max(1e-4, 0.2 / len(y))] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge
        w = w - np.linalg.solve(h, x.T @ (p - y) / len(y) + ridge @ w)
    return w


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
           sample: int | None = None, by: Settings = DEFAULT) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.7)."""
    base = _base(docs, id_col, text_col)
    named = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col))
    scorer = train(base, named, label_col, sample, by)
    if scorer is None:
        out = base.select("doc_id", F.lit(0.0).alias("score"))
    else:
        held = docs.sparkSession.sparkContext.broadcast(scorer)
        kind = base.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in range(0, batch.num_rows, 256):
                    part = batch.slice(s, 256)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value.score(W.text_array(part.column(1)).to_pylist()))], ["doc_id", "score"])
            held.value.forget()

        out = base.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int | None = None, by: Settings = DEFAULT) -> DataFrame:
    """The rows of ``docs`` that are not toxic (score below 0.7)."""
    scorer = train(docs.select("doc_id", "text"), labels.select("doc_id", label_col), label_col, sample, by)
    if scorer is None:
        return docs
    held, at = docs.sparkSession.sparkContext.broadcast(scorer), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                yield part.filter(pa.array(held.value.score(W.text_array(part.column(at)).to_pylist()) < THRESHOLD))
        held.value.forget()

    return docs.mapInArrow(run, docs.schema)
