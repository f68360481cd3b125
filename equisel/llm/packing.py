"""Sum-of-squares online packing of documents into training windows.

Each task reads its documents once. Whole windows are cut from a long document
first; the rest is placed into the open window whose fill level minimises the
sum of squared counts of partially filled windows (Csirik, Johnson, Kenyon et
al.). The counts live in a level array with one entry per fill. When the task
ends, or too many windows are open, the least filled windows are cut up to fill
the others, and the last one is cut at powers of two, which need no padding.

Scale: no shuffle; memory is bounded by ``max_open`` windows a task. A task's
windows hold its own documents only, so a lost task is repeated alone. The
input must deliver the same rows to a repeated task (a table does).

Defined cases: a null or empty text is its end token alone; repeated rows are
packed as often as they occur; an empty table gives no rows; other columns are
ignored. ``sequence_id`` holds the task in its upper bits.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import tokens as T
from . import words as W

WINDOW = 4096
MAX_OPEN = 2048
HELD_BYTES = 8 << 20


class Packer:
    """Online packer. Pieces are ``(document, start, ids, document length)``;
    closed windows come out as ``(sequence, offset, piece)``."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.level = np.zeros(window + 1, dtype=np.int64)
        #: Change of the sum of squares when a window of a level comes or goes; kept with the counts.
        self.come, self.go = np.zeros_like(self.level), np.zeros_like(self.level)
        self._empty()
        self.open: dict[int, list[list]] = defaultdict(list)
        self.n_open = self.sequence = 0

    def _empty(self) -> None:
        self.level[:], self.come[:], self.go[:] = 0, 1, -self.window * self.max_open
        self.come[-1] = 0  # a full window is no longer partial
        self.go[0] = 0  # a new window

    def _count(self, h: int, by: int) -> None:
        n = self.level[h] + by
        self.level[h] = n
        self.come[h] = 2 * n + 1
        self.go[h] = 2 * n - 1 if n else -self.window * self.max_open

    def _emit(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for p in pieces:
            yield self.sequence, offset, p
            offset += len(p[2]) // 4
        self.sequence += 1

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        size, whole = len(ids) // 4, self.window
        cut = size - size % whole
        for s in range(0, cut, whole):
            yield from self._emit([(doc, s, ids[s * 4 : (s + whole) * 4], size)])
        if cut < size:
            yield from self._place((doc, cut, ids[cut * 4 :], size))
        if self.n_open > self.max_open:
            yield from self.close()

    def _place(self, piece: tuple) -> Iterator[tuple]:
        s = len(piece[2]) // 4
        # change of the sum of squares for every level h that leaves room
        h = int(np.argmin(self.come[s:] - self.go[: self.window - s + 1]))
        pieces = self.open[h].pop() if h else []
        if h:
            self._count(h, -1)
            self.n_open -= 1
        pieces.append(piece)
        if h + s == self.window:
            yield from self._emit(pieces)
        else:
            self.open[h + s].append(pieces)
            self._count(h + s, 1)
            self.n_open += 1

    def close(self) -> Iterator[tuple]:
        """Empty all open windows."""
        rest = [(h, p) for h in sorted(self.open, reverse=True) for p in self.open[h]]
        self.open.clear()
        self._empty()
        self.n_open = 0
        lo, hi = 0, len(rest) - 1
        spare: list = []  # pieces of the window that is being cut up
        while lo <= hi or spare:
            if lo <= hi:
                fill, pieces = rest[lo]
                lo += 1
            else:
                fill, pieces = 0, []
            while fill < self.window:
                if not spare:
                    if lo > hi:
                        break
                    spare = rest[hi][1]
                    hi -= 1
                doc, start, ids, size = spare.pop()
                room = (self.window - fill) * 4
                pieces.append((doc, start, ids[:room], size))
                fill += len(ids[:room]) // 4
                if len(ids) > room:
                    spare.append((doc, start + room // 4, ids[room:], size))
            if fill == self.window:
                yield from self._emit(pieces)
            else:
                yield from self._powers(pieces, fill)

    def _powers(self, pieces: list, fill: int) -> Iterator[tuple]:
        """Cut the last window at the powers of two that add up to its fill."""
        pieces = pieces[::-1]
        while fill:
            want = 1 << (fill.bit_length() - 1)
            fill -= want
            group = []
            while want:
                doc, start, ids, size = pieces.pop()
                n = min(want, len(ids) // 4)
                group.append((doc, start, ids[: n * 4], size))
                if len(ids) > n * 4:
                    pieces.append((doc, start + n, ids[n * 4 :], size))
                want -= n
            yield from self._emit(group)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, max_open: int = MAX_OPEN, end_id: int = T.END_ID,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, keep_words: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, ``with_ids``, the ids as uint32 bytes.
    ``keep_words=False`` gives a worker's encoder and its table of known words
    back after each task: slower, but it leaves the memory to later stages."""
    path = path or T.vocabulary()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    shape = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:]) + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        packer, encoder, rows, kept = Packer(window, max_open), T.encoder(path), [], None
        held = 0

        def out():
            cols = list(zip(*rows))
            arrays = [pa.array(cols[0], kept), *(pa.array(c, pa.int64()) for c in cols[1:7])]
            if with_ids:
                arrays.append(pa.array(cols[7], pa.binary()))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

        def take(closed):
            nonlocal held
            for sequence, offset, (doc, start, ids, size) in closed:
                row = (doc, start, len(ids) // 4, zlib.crc32(ids), size, first + sequence, offset)
                rows.append(row + (ids,) if with_ids else row)
                held += len(ids) * with_ids
                if held > HELD_BYTES:
                    yield out()
                    held = 0

        for batch in batches:
            kept = batch.schema.field(0).type
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(W.text_array(part.column(1)).to_pylist(), end_id)):
                    yield from take(packer.add(doc, ids))
                if len(rows) > 5000:
                    yield out()
        yield from take(packer.close())
        if rows:
            yield out()
        if not keep_words:
            del encoder, packer
            T.drop(path)

    return base.mapInArrow(run, shape)
