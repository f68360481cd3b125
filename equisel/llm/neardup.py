"""Near-duplicate components from bottom-k sketches of one hash function.

A document's set is its distinct shingles of five words (a parameter); its
sketch the ``SKETCH`` least shingle hashes. Inverted lists of the retained values give candidates,
the sketches' overlap filters them, and the exact Jaccard index of the full
sets decides (``100 * intersection >= percent * union``).

A pair at the limit of 0.8 shares 19 of the 24 least values of its union on
average and fewer than ``SHARED`` = 8 with probability 1e-7, so pairs that
share less are not looked at. Equal sets are one node from the start; whatever
needs no comparison to know its component is not compared again:

* values in at most ``COLD`` sets: all pairs of the (bounded) list;
* frequent values: only sets with at least 8 frequent values can be linked
  through them alone, and each such set is listed under the ``h - 7`` rarest of
  its ``h`` (two sets that share 8 must meet there). In such a list every set
  is compared with the list's purest member (fewest shingles that no other
  listed set has), not with every other;
* what that leaves in different components is compared further only where
  sizes and the shingles that the purest member lacks allow a link (see
  :func:`_rest`). This is exact and no pair is given up.

Scale: sketches and lists are equi-joins and map-side sums on hashes; tables
that a skewed join reads are written first, so Spark can split them. Full sets
are formed only for sets with enough shared values.

Defined cases: null and empty texts, and texts without words, have an empty
set, are linked with nothing and are their own component; a text of fewer
words than a shingle is one shingle; rows that share a doc_id are judged each by its
text; a null doc_id is never a component's least and its row is kept; other
columns are ignored by :func:`near_duplicates` and kept by :func:`dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .components import components
from .store import free_name, files_for, written, tidy

SHINGLE = 5
SKETCH = 24
SHARED = 8
COLD = 48


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    for i, j, raw, offs in W.blocks(texts):
        w = W.Words(W.LOWER[raw], offs, W.WHITE)
        h = w.hashes()
        grams = W.runs(h, size)
        for first, count in zip(w.first[:-1].tolist(), w.count.tolist()):
            if count >= size:
                yield np.unique(grams[first : first + count - size + 1])
            elif count:
                yield W.runs(h[first : first + count], count) ^ W.U(count)
            else:
                yield np.zeros(0, dtype=W.U)


def fingerprint(values: np.ndarray) -> bytes:
    """128 bits that name a set of hashes."""
    x = W.mix(values ^ W.U(0x5851F42D4C957F2D))
    y = W.mix(values * W.U(0x9E3779B97F4A7C15))
    return np.array([np.bitwise_xor.reduce(x), np.add.reduce(y)], dtype="<u8").tobytes()


def sketches(docs: DataFrame, size: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """doc_id, n (set size), fp (fingerprint, null for an empty set), sketch,
    and th where ``docs`` has it."""
    kind, more = docs.schema["doc_id"].dataType.simpleString(), _text_hash(docs)

    def run(batches):
        for batch in batches:
            n, fp, sketch = [], [], []
            for s in shingle_sets(W.text_array(batch.column(1)), size):
                n.append(len(s))
                fp.append(fingerprint(s) if len(s) else None)
                sketch.append(s[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sketch, pa.list_(pa.int64())),
                 *batch.columns[2:]], ["doc_id", "n", "fp", "sketch", *more])

    return docs.select("doc_id", "text", *more).mapInArrow(tidy(run), f"doc_id {kind}, n long, fp binary, sketch array<long>" + ", th long" * len(more))


def _text_hash(table: DataFrame) -> list[str]:
    """The column th (hash of a row's text), where ``table`` has it."""
    return [c for c in ("th",) if c in table.columns]


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """fp, n, shingles (uint64 bytes, sorted) of the wanted fingerprints."""

    def run(batches):
        for batch in batches:
            asked = batch.column("fp").to_pylist()
            out = [(f, len(s), s.tobytes()) for f, s in zip(asked, shingle_sets(W.text_array(batch.column("text")), size))
                   if f == (fingerprint(s) if len(s) else None)]
            for s in range(0, len(out), 500):
                f, n, x = zip(*out[s : s + 500])
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.binary()), pa.array(n, pa.int64()), pa.array(x, pa.binary())],
                                                 ["fp", "n", "shingles"])

    return docs.select("doc_id", "text").join(wanted, "doc_id").select("text", "fp").mapInArrow(
        run, "fp binary, n long, shingles binary")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, extras: bool = False) -> DataFrame:
    """Pairs (a, b) with linked (their full sets meet the limit), both (common
    shingles) and, if asked for, extras (shingles of a that b lacks)."""
    left = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y"))
    names = ["a", "b", "linked", "both"] + ["extras"] * extras

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                linked, both, more = [], [], []
                for x, y in zip(part.column("x"), part.column("y")):
                    u, v = (np.frombuffer(z.as_buffer(), dtype=W.U) for z in (x, y))
                    n = len(np.intersect1d(u, v, assume_unique=True))
                    linked.append(100 * n >= percent * (len(u) + len(v) - n))
                    both.append(n)
                    if extras:
                        more.append(np.setdiff1d(u, v, assume_unique=True).view(np.int64))
                arrays = [part.column("a"), part.column("b"), pa.array(linked, pa.bool_()), pa.array(both, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(more, pa.list_(pa.int64()))] if extras else []), names)

    shape = "a binary, b binary, linked boolean, both long" + ", extras array<long>" * extras
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(run), shape)


def _sizes_fit(a: str, b: str, percent: int):
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def links(docs: DataFrame, percent: int = 80, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(sketch table, components of fingerprints (node, component))."""
    share = percent / 100
    # I >= need * (n + m) for a linked pair
    need = share / (1 + share)
    files = files_for(docs)
    table = written(sketches(docs, size), "sketches", files)
    one = table.where("fp IS NOT NULL").select("fp", "n", "sketch").dropDuplicates(["fp"])
    listed = one.select("fp", "n", F.explode("sketch").alias("v"))
    often = written(listed.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "values", files)
    enough = F.least(F.lit(SHARED), F.ceil(F.lit(share) * F.col("n")).cast("int"))
    hits = listed.join(often, "v").groupBy("fp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("hits"))
    hits = hits.withColumn("enough", enough).where("size(hits) >= enough")
    cold = F.transform(F.filter("hits", lambda x: x["df"] <= COLD), lambda x: x["v"])
    hot = F.transform(F.filter("hits", lambda x: x["df"] > COLD), lambda x: x["v"])
    hits = written(hits.select("fp", "n", "enough", cold.alias("cold"), hot.alias("hot")), "hits", files)

    own = table.where("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(hits.select("fp"), "fp").select("doc_id", "fp")
    sets = written(_full_sets(docs, own, size), "sets", files)

    # rare values: every pair of a bounded list, with its count of shared values
    rare = hits.select("fp", "n", "enough", F.size("hot").alias("n_hot"), F.explode("cold").alias("v"))
    a = rare.select("v", *(F.col(c).alias(f"{c}_a") for c in ("fp", "n", "enough", "n_hot")))
    b = rare.select("v", *(F.col(c).alias(f"{c}_b") for c in ("fp", "n", "enough", "n_hot")))
    pairs = a.join(b, "v").where("fp_a > fp_b").where(_sizes_fit("n_a", "n_b", percent))
    pairs = pairs.groupBy(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), F.first(F.least("n_hot_a", "n_hot_b")).alias("more"), F.first(F.least("enough_a", "enough_b")).alias("least"))
    pairs = written(pairs.where("shared + more >= least").select("a", "b", "shared"), "pairs", files)
    edges = written(_compared(pairs, sets, percent).where("linked").select("a", "b"), "edges", files)

    # frequent values: each set against the purest member of its lists
    listed = hits.where("size(hot) >= enough").select(
        "fp", "n", F.explode(F.slice("hot", 1, F.size("hot") - F.col("enough") + 1)).alias("v"))
    if listed.isEmpty():
        return table, components(edges, files=files)
    alone = written(_alone(sets.join(listed.select("fp").distinct(), "fp")), "alone", files)
    listed = written(listed.join(alone, "fp", "left").withColumn("alone", F.coalesce("alone", F.lit(0))), "listed", files)
    lead = written(listed.groupBy("v").agg(F.min(F.struct("alone", -F.col("n"), "fp")).alias("lead")).select("v", F.col("lead.fp").alias("b")), "lead", files)
    # a linked set lacks at most this many shingles in the other
    spare = F.floor(F.lit(1 - share) * F.col("n") + 1e-9)
    star = listed.where(F.col("alone") <= spare).join(lead, "v").select(F.col("fp").alias("a"), "b", "n", "alone").distinct()
    stars = written(star, "star", files)
    near = written(_compared(stars.where("a <> b"), sets, percent, extras=True), "near", files)
    edges = edges.unionByName(near.where("linked").select("a", "b"))
    parts = components(edges, files=files)
    rest = _rest(stars, near, parts, share, need, percent, files)
    more = written(_compared(rest, sets, percent).where("linked").select("a", "b"), "edges", files)
    return table, parts if more.isEmpty() else components(edges.unionByName(more), files=files)


def _rest(stars: DataFrame, near: DataFrame, parts: DataFrame, share: float, need: float, percent: int, files: int) -> DataFrame:
    """Pairs (a, b) in one list, in different components so far, that may be
    linked. ``near`` holds for each set a and list lead b the common shingles
    (both) and those of a that b lacks (extras).

    Two sets without a common extra share at most the lesser of their ``both``,
    which limits their sizes. Two linked sets lack at most 0.2 n of each other,
    so if they have a common extra, the first one (in one order for all sets,
    frequent extras last) is among the first 0.2 n + 1 extras of each; what can
    follow it, with the lesser ``both``, must suffice for a link."""
    known = stars.join(near.select("a", "b", "both", "extras"), ["a", "b"], "left").withColumn(
        "both", F.coalesce("both", "n")).withColumn("extras", F.coalesce("extras", F.array().cast("array<bigint>")))
    for end in ("a", "b"):
        known = known.join(parts.select(F.col("node").alias(end), F.col("component").alias("of_" + end)), end, "left").withColumn(
            "of_" + end, F.coalesce("of_" + end, end))
    known = written(known.withColumn("top", F.floor(F.col("both") / need - F.col("n") + 1e-9)), "known", files)
    step = lambda n: F.floor(F.log(F.greatest(n, F.lit(1.0))) * 25)
    open_ = known.where("of_a <> of_b")
    mine = open_.where(F.col("top") >= F.floor(F.lit(share) * F.col("n"))).select(
        F.col("b").alias("lead"), F.col("a").alias("x"), F.col("n").alias("n_x"), F.col("of_a").alias("of_x"), F.col("top").alias("top_x"),
        F.explode(F.sequence(step(F.floor(F.lit(share) * F.col("n"))), step(F.least("top", F.floor(F.col("n") / share) + 1)))).alias("sizes"))
    theirs = known.select(F.col("b").alias("lead"), F.col("a").alias("y"), F.col("n").alias("n_y"), F.col("of_a").alias("of_y"),
                          F.col("top").alias("top_y"), step(F.col("n")).alias("sizes"))
    by_size = mine.join(theirs, ["lead", "sizes"]).where("of_x <> of_y AND n_y <= top_x AND n_x <= top_y")
    # common extras: those that no partner can have fill a set's first places
    each = known.where(F.col("alone") <= F.floor(F.lit(1 - share) * F.col("n") + 1e-9)).select(
        F.col("b").alias("lead"), F.col("a").alias("x"), "n", "both", F.col("of_a").alias("of_x"), (F.col("of_a") != F.col("of_b")).alias("open"),
        F.size("extras").alias("n_extras"), F.explode("extras").alias("s"))
    common = written(each.groupBy("lead", "s").agg(F.count(F.lit(1)).alias("df"), F.max("open").alias("asked")).where("df > 1 AND asked"), "common", files)
    first = each.join(common.select("lead", "s", "df"), ["lead", "s"]).groupBy("lead", "x", "n", "both", "of_x", "open", "n_extras").agg(
        F.sort_array(F.collect_list(F.struct("df", "s"))).alias("all"))
    places = F.floor(F.lit(1 - share) * F.col("n") + 1e-9) + 1 - (F.col("n_extras") - F.size("all"))
    first = first.withColumn("places", F.least(places, F.size("all"))).where("places > 0").select(
        "lead", "x", "n", "both", "of_x", "open", F.size("all").alias("left"), F.posexplode(F.slice("all", 1, F.col("places").cast("int"))).alias("rank", "one"))
    # extras that the two may still have in common, this one included
    first = written(first.select("lead", "x", "n", "both", "of_x", "open", (F.col("left") - F.col("rank")).alias("left"), "one.s"), "extras", files)
    ask, other = (first.select("lead", "s", F.col("x").alias(e), *(F.col(c).alias(f"{c}_{e}") for c in ("n", "both", "left")), F.col("of_x").alias(f"of_{e}"), "open")
                  for e in ("x", "y"))
    at_most = F.least("both_x", "both_y") + F.least("left_x", "left_y")
    met = ask.where("open").drop("open").join(other.drop("open"), ["lead", "s"]).where("of_x <> of_y").where(
        at_most >= need * (F.col("n_x") + F.col("n_y")) - 1e-9)
    both = by_size.select("x", "y", "n_x", "n_y").unionByName(met.select("x", "y", "n_x", "n_y")).where(_sizes_fit("n_x", "n_y", percent))
    return both.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _alone(sets: DataFrame) -> DataFrame:
    """(fp, alone): how many of a set's shingles no other set here has. Tasks
    add up first: a shingle that several of a task's sets have is one row."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for f, x in zip(batch.column("fp"), batch.column("shingles")):
                held.append((f.as_py(), np.frombuffer(x.as_buffer(), dtype=np.int64).copy()))
                size += len(held[-1][1])
                if size > 500_000:
                    yield from added(held)
                    held, size = [], 0
        if held:
            yield from added(held)

    def added(held):
        values, first, n = np.unique(np.concatenate([s for _, s in held]), return_index=True, return_counts=True)
        owner = np.repeat(np.arange(len(held)), [len(s) for _, s in held])[first]
        names = pa.array([f for f, _ in held], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n), names.take(pa.array(owner))], ["s", "n", "fp"])

    each = sets.select("fp", "shingles").mapInArrow(tidy(run), "s long, n long, fp binary")
    return each.groupBy("s").agg(F.sum("n").alias("df"), F.min("fp").alias("fp")).where("df = 1").groupBy("fp").agg(
        F.count(F.lit(1)).alias("alone"))


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id
    it reaches), kept (doc_id = component_id)."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table, parts = links(base, percent, size)
    return _labelled(table, parts)


def _labelled(table: DataFrame, parts: DataFrame) -> DataFrame:
    files = files_for(table)
    more = _text_hash(table)
    named = table.select("doc_id", "n", "fp", *more)
    # a fingerprint's least document, then a component's
    least = named.where("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    label = least.join(parts.select(F.col("node").alias("fp"), F.col("component").alias("of")), "fp", "left").withColumn("of", F.coalesce("of", "fp"))
    label = written(label, "labels", files)
    whole = label.groupBy("of").agg(F.min("first").alias("component_id"), F.sum("copies").alias("members")).where("members > 1")
    whole = written(whole, "groups", files)
    shared = written(label.select("fp", "of").join(whole, "of").select("fp", "component_id"), "shared", files)
    out = named.join(shared, "fp", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), *more)


def dedup(docs: DataFrame, percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id. Of
    rows that share a doc_id, each goes or stays by its own text; exact repeats
    of a kept row stay."""
    text = F.xxhash64("text")
    own, th = free_name(docs.columns, "_id"), free_name(docs.columns, "_th")
    gone = _labelled(*links(docs.select("doc_id", "text", text.alias("th")), percent, size)).where("NOT kept").select(
        F.col("doc_id").alias(own), F.col("th").alias(th)).distinct()
    files = files_for(docs)
    kept = docs.join(written(gone, "gone", files), F.col("doc_id").eqNullSafe(F.col(own)) & (text == F.col(th)), "left_anti")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns)).coalesce(files)


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

SQL = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least_ AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, component_id, doc.doc_id = component_id AS kept
FROM doc LEFT JOIN size USING (doc_id) JOIN least_ USING (doc_id)
"""
