"""Prefix trie of conversations from vertical bitmaps.

Conversations go to shards of consecutive ids. A shard indexes (position, turn)
to a bitset of its conversations; starting with all of them, the intersection of
a parent's bitset with a posting is a child, its population count the members,
and the members that have no further turn are the node's end list. Shards run
independently and merge by the 128-bit hash of a node's path.

Sums over subtrees stay additive: every node is owned by the shard of its
smallest member, and a shard adds up only what it owns along its own part of the
trie, in one backward pass over depth-first order. So no round per level is
needed, whatever the longest conversation.

Texts never travel: a turn becomes a 16-byte hash of (role, text) and a number
of code points where it is read. A task holds one shard at a time: at most
``SHARD`` conversations, and as many rows as ``ROWS`` or its longest
conversation have. A node's ends reach one task in order as a stream of shard
lists (a SHA-256 has one beginning), never as one value.

Turns are ordered by turn (null first), equal numbers by the turn's hash, so
repeated rows follow each other. Null role or text counts as empty. Rows without
a conv_id belong to no conversation and are left out. An empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from equisel.functions.prefix import top_k_per_group

from .store import tasks, written

SHARD = 4096
ROWS = 1 << 18
#: A conversation takes up to BORROWED - 1 turns of the first of its hundred.
HUNDRED, BORROWED = 100, 6
ROOT = hashlib.blake2b(b"", digest_size=16).digest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, key (16 bytes of the SHA-256 of role and text, told apart
    by the role's length), n_chars of the text; as a written table."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    return written(conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.length(text).cast("long").alias("n_chars")), "turns")


def rebuilt(own: DataFrame) -> DataFrame:
    """Turns in the order in which conversations are rebuilt: conv_id, h, part
    (0: borrowed, 1: own, of which the first h are to be skipped; -1: a mark
    that the conversation exists), turn, key, n_chars."""
    ids = written(own.select("conv_id").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED).cast("int").alias("h")), "ids")
    order = [F.asc_nulls_first("turn"), F.asc("key")]
    first = top_k_per_group(own.where(F.col("conv_id") % HUNDRED == 0).withColumn("salt", F.concat(F.coalesce(F.col("turn"), F.lit(-1)).cast("string"), F.hex("key"))),
                            ["conv_id"], order, BORROWED - 1, "salt").select(F.col("conv_id").alias("base"), F.col("rank").cast("long").alias("place"), "key", "n_chars")
    lent = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED).join(first, "base").where("place <= h")
    zero = [F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("n_chars")]
    return lent.select("conv_id", "h", F.lit(0).alias("part"), F.col("place").alias("turn"), "key", "n_chars").unionByName(
        own.select("conv_id", F.lit(None).cast("int").alias("h"), F.lit(1).alias("part"), "turn", "key", "n_chars")).unionByName(
        ids.select("conv_id", "h", F.lit(-1).alias("part"), *zero))


class Shard:
    """Conversations of one shard: ``ids`` ascending, ``first`` turn of each
    (one more at the end), keys and lengths of all turns in order."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, keys: list[bytes], sizes: np.ndarray):
        self.ids, self.first, self.keys, self.sizes = ids, first.tolist(), keys, sizes.tolist()

    def postings(self) -> tuple[dict, list[int]]:
        """(position, key) to the bitset of conversations with it there; by
        length, the bitset of the conversations that have it."""
        index: dict[tuple[int, bytes], int] = {}
        lengths: dict[int, int] = {}
        for c in range(len(self.ids)):
            bit, at, end = 1 << c, self.first[c], self.first[c + 1]
            lengths[end - at] = lengths.get(end - at, 0) | bit
            for p in range(end - at):
                k = (p, self.keys[at + p])
                index[k] = index.get(k, 0) | bit
        return index, lengths

    def nodes(self) -> list[tuple]:
        """Depth-first: (place, place of the parent, path hash, parent's hash,
        depth, smallest member, members, code points of the last text, ends)."""
        index, lengths = self.postings()
        everyone, out = (1 << len(self.ids)) - 1, []
        stack = [(everyone, 0, -1, ROOT, None, 0)]
        while stack:
            members, depth, above, path, parent, size = stack.pop()
            place = len(out)
            ends = members & lengths.get(depth, 0)
            out.append((place, above, path, parent, depth, int(self.ids[_lowest(members)]), members.bit_count(), size, self._ids(ends)))
            left = members ^ ends
            children = []
            while left:
                c = _lowest(left)
                at = self.first[c] + depth
                child = left & index[depth, self.keys[at]]
                left ^= child
                children.append((child, depth + 1, place, hashlib.blake2b(path + self.keys[at], digest_size=16).digest(), path, self.sizes[at]))
            stack += reversed(children)
        return out

    def _ids(self, bits: int) -> list[int]:
        found = []
        while bits:
            c = _lowest(bits)
            found.append(int(self.ids[c]))
            bits &= bits - 1
        return found


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


NODE = ("shard long, place long, above long, path binary, parent binary, depth long, conv_id long, n_convs long, n_chars long, ends array<long>")
_NODE = pa.schema([("shard", pa.int64()), ("place", pa.int64()), ("above", pa.int64()), ("path", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()),
                   ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_chars", pa.int64()), ("ends", pa.list_(pa.int64()))])
STEP = 50_000


def _node_batches(shard: Shard) -> Iterator[pa.RecordBatch]:
    found, name = shard.nodes(), int(shard.ids[0])
    for a in range(0, len(found), STEP):
        columns = list(zip(*found[a : a + STEP], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(columns[0]), pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(_NODE)[1:], strict=True))], schema=_NODE)


def _shards(tables: Iterator[pa.Table], convs: int, rows: int) -> Iterator[Shard]:
    """Cuts sorted rows into shards of whole conversations."""
    for t in tables:
        conv, part = (t.column(c).to_numpy() for c in ("conv_id", "part"))
        marks = np.flatnonzero(part == -1)  # the first row of every conversation
        h = np.zeros(len(marks), dtype=np.int64) + t.column("h").take(pa.array(marks)).to_numpy()
        of = np.cumsum(part == -1) - 1
        own = part == 1
        seen = np.cumsum(own)
        nth = seen - seen[marks][of]  # 1 for a conversation's first own turn
        kept = (part == 0) | own & (nth > h[of])
        keys, sizes = t.column("key").filter(pa.array(kept)).to_pylist(), t.column("n_chars").to_numpy()[kept]
        first = np.concatenate([[0], np.cumsum(np.bincount(of[kept], minlength=len(marks)))])
        ids, a = conv[marks], 0
        while a < len(ids):
            b = max(a + 1, min(a + convs, int(np.searchsorted(first, first[a] + rows, side="right")) - 1))
            yield Shard(ids[a:b], first[a : b + 1] - first[a], keys[first[a] : first[b]], sizes[first[a] : first[b]])
            a = b


def _gathered(batches: Iterator[pa.RecordBatch], starts, most: int) -> Iterator[pa.Table]:
    """Tables of about ``most`` rows, each cut just before the last row for which
    ``starts(table)`` is true, so that nothing that belongs together is cut."""
    held, n, limit = [], 0, most
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= limit:
            t = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(starts(t))[-1])
            if cut:
                yield t.slice(0, cut)
            held, n = t.slice(cut).to_batches(), t.num_rows - cut
            limit = max(most, 2 * n)  # beyond that where one piece alone is longer
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def shard_nodes(own: DataFrame, shard: int = SHARD, rows: int = ROWS) -> DataFrame:
    """The nodes of every shard's own trie, as a written table."""
    spark = own.sparkSession

    def run(batches):
        for s in _shards(_gathered(batches, lambda t: t.column("part").to_numpy() == -1, rows), shard, rows):
            yield from _node_batches(s)

    dealt = written(rebuilt(own), "rebuilt").repartitionByRange(tasks(spark), "conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "key")
    return written(dealt.mapInArrow(run, NODE), "nodes")


def _merged(local: DataFrame) -> DataFrame:
    """One row per path: its owner is the shard of its smallest member."""
    each = local.groupBy("path").agg(F.min(F.struct("conv_id", "shard")).alias("least"), F.first("parent").alias("parent"), F.first("depth").alias("depth"),
                                     F.sum("n_convs").alias("n_convs"), F.first("n_chars").alias("n_chars"))
    each = each.select("path", "parent", "depth", F.col("least.conv_id").alias("conv_id"), F.col("least.shard").alias("owner"), "n_convs", "n_chars")
    return written(each, "paths")


def _subtree_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row the sums of ``leaf`` and ``saved`` over its part of the subtree:
    a backward pass over depth-first places, shard by shard."""
    for t in _gathered(batches, lambda t: t.column("place").to_numpy() == 0, ROWS):
        above, place = t.column("above").to_numpy(), t.column("place").to_numpy()
        rows = np.arange(len(place))
        up = np.where(above < 0, -1, rows - place + above).tolist()
        leaf, saved = t.column("leaf").to_pylist(), t.column("saved").to_pylist()
        for i in range(len(up) - 1, -1, -1):
            if up[i] >= 0:
                leaf[up[i]] += leaf[i]
                saved[up[i]] += saved[i]
        yield pa.RecordBatch.from_arrays([t.column("path").combine_chunks(), pa.array(leaf, pa.int64()), pa.array(saved, pa.int64())], ["path", "n_leaves", "saved_tokens"])


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every path's ids, from rows sorted by (path, shard). The
    state of one path is carried from batch to batch."""
    path, state, n = None, None, 0
    for b in batches:
        paths, shas, counts = [], [], []
        for p, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if p != path:
                if path is not None:
                    paths.append(path), shas.append(state.hexdigest()), counts.append(n)
                path, state, n = p, hashlib.sha256(), 0
            state.update((("," if n else "") + ",".join(map(str, ids))).encode())
            n += len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(shas, pa.string()), pa.array(counts, pa.int64())], ["path", "ends_sha256", "n_ends"])
    if path is not None:
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([state.hexdigest()], pa.string()), pa.array([n], pa.int64())], ["path", "ends_sha256", "n_ends"])


def trie(conversations: DataFrame, shard: int = SHARD, rows: int = ROWS) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256, n_ends."""
    spark = conversations.sparkSession
    local = shard_nodes(turns(conversations), shard, rows)
    paths = _merged(local)
    children = paths.where("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("n_children"))
    paths = written(paths.join(children, "path", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "children")

    owned = F.col("shard") == F.col("owner")
    marked = local.select("shard", "place", "above", "path").join(paths.select("path", "owner", "n_children", ((F.col("n_convs") - 1) * F.col("n_chars")).alias("worth")), "path").select(
        "shard", "place", "above", "path", F.when(owned & (F.col("n_children") == 0), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("leaf"),
        F.when(owned, F.col("worth")).otherwise(F.lit(0)).cast("long").alias("saved"))
    sums = marked.repartition(tasks(spark), "shard").sortWithinPartitions("shard", "place").mapInArrow(_subtree_sums, "path binary, n_leaves long, saved_tokens long")
    sums = sums.groupBy("path").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    ends = local.where(F.size("ends") > 0).select("path", "shard", "ends").repartition(tasks(spark), "path").sortWithinPartitions("path", "shard")
    ends = ends.mapInArrow(_end_hashes, "path binary, ends_sha256 string, n_ends long")

    above = paths.select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = paths.join(sums, "path").join(ends, "path", "left").join(above, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), F.coalesce("n_ends", F.lit(0).cast("long")).alias("n_ends"))


def digest(nodes: DataFrame) -> DataFrame:
    return nodes.drop("n_ends")


SQL = """
WITH keyed AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS n_chars,
         substr(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS key
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, key, n_chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS place FROM keyed),
ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295::BIGINT, list_reduce(
           list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END)) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
laid AS (
  SELECT i.conv_id, o.place, o.key, o.n_chars FROM ids i JOIN own o ON o.conv_id = i.base AND o.place <= i.h
  UNION ALL
  SELECT i.conv_id, o.place + 10, o.key, o.n_chars FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.place > i.h),
steps AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(key, '') OVER w AS path, n_chars FROM laid WINDOW w AS (PARTITION BY conv_id ORDER BY place)
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM ids),
lengths AS (SELECT conv_id, max(depth) AS n FROM steps GROUP BY conv_id),
ends AS (
  SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM steps JOIN lengths USING (conv_id) WHERE depth = n GROUP BY path),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(n_chars) AS n_chars FROM steps GROUP BY path, depth),
children AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path)),
sums AS (
  SELECT s.path, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.n_chars)::BIGINT AS saved_tokens
  FROM full_nodes f JOIN steps s ON s.conv_id = f.conv_id AND s.depth <= f.depth GROUP BY s.path)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves, u.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM full_nodes f JOIN sums u USING (path) LEFT JOIN ends e USING (path) LEFT JOIN nodes p ON f.depth > 0 AND p.path = left(f.path, length(f.path) - 32)
"""
