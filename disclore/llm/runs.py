"""Periodic runs of words, found by Karp-Miller-Rosenberg naming.

A run is a stretch of words with least period q (words q apart are identical), at least max(least, repeats * q) words
long, that no neighbouring word extends keeping q. Level 0 names each word; level k + 1 names the block of 2 ** (k + 1)
words at a place by the pair of level-k names of its halves, so equal names mean equal blocks, with no hash that could
be wrong. The longest common extension of two places, to the right or left, is read off the levels from the highest
down.

Where words p apart agree over (repeats - 1) * p places, one place in every 2 * p starts a block of p words that agrees
too, so a grid of that step for each p meets every run; there are n / 2 * (1 + 1/2 + 1/3 + ...) grid points. A grid point
whose blocks of 2 ** k <= p words have equal names is extended both ways. Of the periods of one stretch the least counts.

The texts of a batch are named together: each is followed by a separator of its own, and they lie longest first, so that
the higher levels name only the texts that are long enough for them. Words never leave the task that read them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, small_batches

#: Words that are named together, and grid points looked at together: bounds on memory, not on texts.
NAMED_WORDS, GRID_POINTS = 100_000, 250_000

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def name_levels(words: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Names of the blocks of 1, 2, 4, ... words at each place. ``words``: the texts one after the other, longest first,
    each ended by a number that stands nowhere else; ``lengths``: their words. A level covers the texts that hold two of its blocks."""
    levels, ends = [words], np.cumsum(lengths + 1)
    half = 1
    while (k := int(np.searchsorted(-lengths, -4 * half, side="right"))) > 0:
        below, n = levels[-1], int(ends[k - 1])
        pairs = below[: n - half].astype(np.int64) * (int(below.max()) + 1) + below[half:n]
        names = np.full(n, -1, np.int64)
        names[: n - half] = np.unique(pairs, return_inverse=True)[1]
        last = n - 2 * half + 1
        names[max(0, last) :] = -1 - np.arange(n - max(0, last))  # blocks that reach over the end equal nothing
        names -= names.min()
        levels.append(names)
        half *= 2
    return levels


def common_extension(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many places from ``a`` and ``b`` on agree, to the right (``step`` 1) or, from a - 1 and b - 1, to the left (-1)."""
    size = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names, block = levels[k], 1 << k
        live = np.arange(len(a))
        while len(live):  # more than twice only at the highest level
            x, y = (a[live] + size[live], b[live] + size[live]) if step > 0 else (a[live] - size[live] - block, b[live] - size[live] - block)
            inside = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < len(names))
            live, x, y = live[inside], x[inside], y[inside]
            live = live[names[x] == names[y]]
            size[live] += block
    return size


def _grid(total: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) of all grid points for the periods up to ``most``, in portions."""
    p = 1
    while p <= most:
        q, points = p, 0
        while q <= most and (points == 0 or points + total // (2 * q) + 1 <= GRID_POINTS):
            points += total // (2 * q) + 1
            q += 1
        periods = np.arange(p, q)
        counts = (total - 1) // (2 * periods) + 1
        of = np.repeat(periods, counts)
        yield (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * 2 * of, of
        p = q


def find_runs(texts: list[np.ndarray], least: int = 6, repeats: int = 4) -> list[np.ndarray]:
    """The runs of each text (an array of word numbers >= 0): rows (start, length, period) by start, then period.

    ``repeats`` has to be 3 or more, so that the grid meets every run and runs of one stretch have one least period. A
    text without words has none.
    """
    if repeats < 3:
        raise ValueError("runs of fewer than three repeats need a finer grid")
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(texts)
    order = sorted((i for i in range(len(texts)) if len(texts[i]) >= least), key=lambda i: -len(texts[i]))
    if not order:
        return out
    lengths = np.array([len(texts[i]) for i in order])
    starts = np.cumsum(lengths + 1) - lengths - 1
    total = int(starts[-1] + lengths[-1] + 1)
    words = np.empty(total, np.int64)
    words[np.cumsum(lengths + 1) - 1] = max(int(texts[i].max()) for i in order) + 1 + np.arange(len(order))
    for s, i in zip(starts, order):
        words[s : s + len(texts[i])] = texts[i]
    words = np.unique(words, return_inverse=True)[1]
    levels = name_levels(words, lengths)
    found = []
    for places, periods in _grid(total, int(lengths[0]) // repeats):
        high = np.minimum(np.frexp(periods)[1] - 1, len(levels) - 1)  # the largest block that is no longer than the period
        for k in np.unique(high):
            names = levels[k]
            at = (high == k) & (places + periods < len(names))
            a, p = places[at], periods[at]
            same = names[a] == names[a + p]
            a, p = a[same], p[same]
            if not len(a):
                continue
            right, left = common_extension(levels, a, a + p, 1), common_extension(levels, a, a + p, -1)
            good = right + left + p >= np.maximum(least, repeats * p)
            found.append(np.stack([a - left, left + right + p, p], 1)[good])
    if not found:
        return out
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    runs = runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(1)][: len(runs)]]  # of a stretch's periods the least
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    of = np.searchsorted(starts, runs[:, 0], side="right") - 1
    runs[:, 0] -= starts[of]
    cuts = np.searchsorted(of, np.arange(len(order) + 1))
    for j, i in enumerate(order):
        if cuts[j] < cuts[j + 1]:
            out[i] = runs[cuts[j] : cuts[j + 1]]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: all but those that some run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def _portions(texts: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    portion, size = [], 0
    for words in texts:
        if portion and size + len(words) > NAMED_WORDS:
            yield portion
            portion, size = [], 0
        portion.append(words)
        size += len(words) + 1
    if portion:
        yield portion


def periodic_runs(docs: DataFrame, text: Column | str = "text", keep: list[str] | None = None, least: int = 6, repeats: int = 4, rewrite: Callable[[tuple, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id alone unless told), then n_words, runs (array of start, length, period, by start, then
    period; starts are word numbers from 0) and collapsed: the text's words, joined by one blank, without the repeats of
    its runs.

    Words are what stands between blanks and the characters 9 to 13. ``rewrite`` is told a row's kept values and its words
    and gives the words to look at instead. A null text counts as empty: no words, no runs,
    collapsed ''. Repeated rows and null ids keep rows of their own; an empty table gives no rows; the columns that are
    added get a _ before them where ``keep`` has their names. Texts are never cut: one of millions of words is named by
    itself.
    """
    keep = ["doc_id"] if keep is None else keep
    name = free_names(["n_words", "runs", "collapsed", "_text"], keep)
    slim = small_batches(docs.select(*[F.col(c) for c in keep], F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit("")).alias(name[3])))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    schema = f"{fields}, `{name[0]}` bigint, `{name[1]}` array<{RUN}>, `{name[2]}` string"
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sizes, rows, left = [], [], [], []
            column = batch.column(batch.num_columns - 1).cast(pa.binary())
            kept = zip(*[c.to_pylist() for c in batch.columns[:-1]]) if keep else repeat(())
            split = (v.as_py().split() for v in column)  # bytes split at blank, \t, \n, \v, \f and \r alone
            for portion in _portions(split if rewrite is None else map(rewrite, kept, split)):
                number: dict[bytes, int] = {}
                coded = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) for words in portion]
                for words, runs in zip(portion, find_runs(coded, least, repeats)):
                    counts.append(len(words))
                    sizes.append(len(runs))
                    rows.append(runs)
                    left.append(b" ".join([w for w, k in zip(words, kept_words(len(words), runs).tolist()) if k] if len(runs) else words))
            flat = np.concatenate([np.zeros((0, 3), np.int64), *rows])
            values = pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(3)], fields=list(kind))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            added = [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, values), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], *name[:3]])

    return slim.mapInArrow(work, schema)


def planted(row: tuple, words: list[bytes]) -> list[bytes]:
    """``words`` with a period planted into about a tenth of the documents, by a rule of the row's doc_id.

    With h the crc32 of the decimal doc_id and g = floor(h / 10): where h % 10 = 0 and there are n > 0 words, each word
    i >= a becomes word a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A null doc_id has no h,
    so its words stay.
    """
    if row[0] is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(row[0]).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def digests(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_runs, start, length, period and exponent_milli of the run with the greatest length /
    period (ties: least start, then period; null without runs), runs_sha256, collapsed_sha256, over the ``planted`` texts.

    Nulls, empty texts, repeated rows and empty tables are as in ``periodic_runs``; the digests are never null.
    """
    found = periodic_runs(docs, rewrite=planted)
    better = F.expr("aggregate(runs, cast(null as " + RUN + "), (best, r) -> if(best is null or r.length * best.period > best.length * r.period, r, best))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), better.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
