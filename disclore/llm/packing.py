"""Sum-of-squares online packing of token documents into fixed windows.

Each task packs the documents of its partition as they come. A document's ids are cut into whole windows
while they last; the rest, shorter than a window, goes to the fill level that makes the sum of squares of
the counts of partially filled windows least. A level array holds those counts, so a choice is one pass
over an array. At the end of the partition the windows still open are drained: the emptiest are cut up to
fill the fullest, and what remains at last is cut into powers of two, which need no padding.

Memory: the ids of open windows, two bytes each where the vocabulary allows it. There is no bound on open windows:
where no two rests fill a window there is one for each document, and they then hold up to two bytes for each token
of the task's own split, never more. No shuffle. Sequence ids are unique over all partitions: the partition's number
times 2**33 plus a count. A retried task reads its split again in the same order and so packs alike; write the
result before anything else shuffles it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe
from .common import small_batches

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Piece:
    """Part of a document: its place there, its ids (unsigned, of two bytes where all fit)."""

    __slots__ = ("doc", "ids", "start", "tokens")

    def __init__(self, doc, start: int, ids: np.ndarray, tokens: int):
        self.doc, self.start, self.ids, self.tokens = doc, start, ids, tokens

    def __len__(self) -> int:
        return len(self.ids)

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return Piece(self.doc, self.start, self.ids[:n], self.tokens), Piece(self.doc, self.start + n, self.ids[n:], self.tokens)


class SumOfSquares:
    """The packer of one partition; ``emit`` gets each finished sequence, a list of pieces."""

    def __init__(self, window: int, emit: Callable[[list[Piece]], None]):
        self.window, self.emit = window, emit
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def choose(self, size: int) -> int:
        """The level to place ``size`` tokens on: 0 for a new window. Ties go to the fullest level."""
        n, w = self.levels, self.window
        # moving a window from h to h+size changes the sum of squares by 2*(N[h+size]-N[h]+1), a new one by 2*N[size]+1,
        # one that fills up by 1-2*N[h]
        best, least = 0, 2 * int(n[size]) + 1
        at = np.flatnonzero(n[1 : w - size]) + 1
        if len(at):
            cost = n[at + size] - n[at]
            k = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if 2 * (int(cost[k]) + 1) <= least:
                best, least = int(at[k]), 2 * (int(cost[k]) + 1)
        if n[w - size] and 1 - 2 * int(n[w - size]) <= least:
            return w - size
        return best

    def add(self, doc, ids: np.ndarray) -> None:
        tokens, w = len(ids), self.window
        full = tokens // w
        for k in range(full):
            self.emit([Piece(doc, k * w, ids[k * w : (k + 1) * w], tokens)])
        size = tokens - full * w
        if not size:
            return
        level = self.choose(size)
        pieces = self.open[level].pop() if level else []
        if level:
            self.levels[level] -= 1
        rest = ids[full * w :]
        pieces.append(Piece(doc, full * w, rest.astype(np.uint16) if not len(rest) or rest.max() < 1 << 16 else rest.copy(), tokens))
        self.put(level + size, pieces)

    def put(self, level: int, pieces: list[Piece]) -> None:
        if level == self.window:
            self.emit(pieces)
            return
        self.levels[level] += 1
        self.open.setdefault(level, []).append(pieces)

    def drain(self) -> None:
        """Fill the fullest open windows with pieces of the emptiest, cut where needed."""
        rest = [(h, p) for h in sorted(self.open) for p in self.open[h]]
        self.open = {}
        self.levels[:] = 0
        lo, hi = 0, len(rest) - 1
        spare = list(rest[0][1]) if rest else []
        while lo < hi:
            need, pieces = self.window - rest[hi][0], rest[hi][1]
            while need:
                if not spare:
                    lo += 1
                    if lo == hi:
                        break
                    spare = list(rest[lo][1])
                piece = spare.pop()
                if len(piece) > need:
                    keep, piece = piece.cut(len(piece) - need)
                    spare.append(keep)
                pieces.append(piece)
                need -= len(piece)
            if need:
                spare = pieces
                break
            self.emit(pieces)
            hi -= 1
        left = sum(map(len, spare))
        while left:  # the largest power of two each time
            need = 1 << (left.bit_length() - 1)
            left -= need
            pieces = []
            while need:
                piece = spare.pop()
                if len(piece) > need:
                    piece, keep = piece.cut(need)
                    spare.append(keep)
                pieces.append(piece)
                need -= len(piece)
            self.emit(pieces)


def pack(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, cache_share: float = 1.0) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its encoding followed by ``end_id``; null and empty texts are that id alone. Every id lies
    in exactly one piece; pieces of a sequence have offsets without gaps from 0. Null ids and repeated rows
    are packed as rows of their own. An empty table gives no rows; other columns are not read. ``cache_share``: how much of
    the bounds on its caches the encoder uses; less takes less memory and more time, for the same result.
    """
    src = small_batches(docs).select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    end = int(end_id).to_bytes(4, "little")
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocabulary, cache_share)
        base = TaskContext.get().partitionId() << 33
        out: list[list] = [[] for _ in names]
        count = 0

        def emit(pieces: list[Piece]) -> None:
            nonlocal count
            at = 0
            for p in pieces:
                raw = p.ids.astype("<u4").tobytes()
                row = (p.doc, p.start, len(p), zlib.crc32(raw), p.tokens, base + count, at, raw)
                for column, value in zip(out, row):
                    column.append(value)
                at += len(p)
            count += 1

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 7 else pa.int64()) for k, c in enumerate(out)], names=names)
            for c in out:
                c.clear()
            return batch

        packer = SumOfSquares(window, emit)
        for batch in batches:
            for part in bpe._slices(batch):
                for doc, text in zip(part.column(0).to_pylist(), bpe._texts(part.column(1))):
                    packer.add(doc, np.frombuffer(coder.encode(text) + end, "<u4"))
                    if len(out[0]) >= 4096:
                        yield flush()
        packer.drain()
        if out[0]:
            yield flush()

    return src.mapInArrow(run, PIECES + ", ids binary" * keep_ids)
