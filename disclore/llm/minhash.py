"""Near-duplicate documents: one-permutation MinHash, optimal densification, bands, star-shaped candidates.

1. One pass over the texts makes, per document, the number of its word shingles, a fingerprint of the set
   and one key for each band. One hash per shingle serves all slots (the hash's range is cut into slots, the
   least hash of each is kept); empty slots borrow from a full one that a hash of (slot, attempt) picks.
2. Documents with equal sets form a class at once; only one of each class goes on. So copies cost one row.
3. Documents that share a band key form a bucket. A bucket gives a star: edges from its least member to the
   others, so the number of pairs is bounded by the number of rows, not by squares of bucket sizes.
4. Candidates are confirmed on the full sets of shingles, made again from the texts of the candidates alone.
5. A star can miss a pair whose members both differ from the centre. Where a bucket's members are still not
   in one component after the stars, they meet the members of all such buckets they share, in blocks of
   bounded size: a task compares the full sets of two blocks and returns a forest of links, never pairs.
6. Links give components; the least document id of each names it.

Nothing of the corpus is collected. Recall is that of the bands: with 50 bands of 7 slots a pair at
similarity 0.8 is missed with probability 8e-6, less above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _slices, _texts
from .common import discard, is_empty, small_batches, sole_cache, written
from .graph import components

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S32 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(32)
MAX_WORDS = 200_000
BROADCAST_IDS = 1_000_000
#: Sets that meet as one side of a task where buckets are ambiguous, and their shingles; a larger set is alone.
BLOCK, BLOCK_SHINGLES = 256, 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _S30)) * _C2
    x = (x ^ (x >> _S27)) * _C3
    return x ^ (x >> _S31)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes, ascending, of the runs of ``width`` words of a text (A-Z lowered, words parted by
    ASCII white space); of all words as one run when there are fewer; none without words."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if len(_words) > MAX_WORDS:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    k = min(width, n)
    acc = h[: n - k + 1].copy()
    for j in range(1, k):
        acc = mix(acc * _C1 + np.uint64(j)) + h[j : n - k + 1 + j]
    return np.unique(mix(acc ^ np.uint64(k)))


def signature(s: np.ndarray, slots: int) -> np.ndarray:
    """One-permutation MinHash of a non-empty ascending set, densified."""
    slot = ((s >> _S32) * np.uint64(slots) >> _S32).astype(np.int64)
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    out = np.zeros(slots, np.uint64)
    full = np.zeros(slots, bool)
    full[slot[first]] = True
    out[slot[first]] = s[first]
    if len(first) == 1:
        out[:] = s[0]
        return out
    todo, attempt = np.flatnonzero(~full), 0
    base = out.copy()
    while len(todo):
        pick = (mix(todo.astype(np.uint64) * _C1 + np.uint64(attempt + 1)) >> _S32) * np.uint64(slots) >> _S32
        pick = pick.astype(np.int64)
        hit = full[pick]
        out[todo[hit]] = base[pick[hit]]
        todo = todo[~hit]
        attempt += 1
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.reshape(bands, -1)
    acc = np.arange(1, bands + 1, dtype=np.uint64) * _C1
    for j in range(rows.shape[1]):
        acc = mix(acc * _C3 + rows[:, j])
    return acc.view(np.int64)


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, fp (null without shingles or id), bands. A map over the rows, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("minhash", _words)
        for batch in batches:
            for part in _slices(batch):
                ids, n, fp, keys = part.column(0).to_pylist(), [], [], []
                for i, t in zip(ids, _texts(part.column(1))):
                    s = shingles(t, width)
                    n.append(len(s))
                    alone = i is None or not len(s)
                    fp.append(None if alone else hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    keys.append(None if alone else band_keys(signature(s, bands * rows), bands))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "fp", "bands"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, fp binary, bands array<bigint>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """fp and the whole set, for confirming candidates."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch, 128):
                sets = [shingles(t, width).tobytes() for t in _texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["fp", "s"])

    return docs.mapInArrow(run, "fp binary, s binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) for candidate pairs, by the full sets."""
    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("rid").alias("b"), F.col("s").alias("sb")), "b")

    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if percent * max(len(p), len(q)) > 100 * min(len(p), len(q)):
                    linked.append(False)
                    continue
                common = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint, linked boolean")


def _links_between(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the sets of two blocks (or within one), as a forest over what is not yet in one component."""
    frame = frame.sort_values(["side", "rid"], ignore_index=True)
    sets = [np.frombuffer(x, np.uint64) for x in frame["s"]]
    size = np.array([len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    row, keep = np.repeat(np.arange(len(sets)), size), shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    side = frame["side"].to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    right = right if len(right) else left
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        has = np.zeros((len(sets), 4096), np.float32)
        has[row[a:b], column[a:b] - at] = 1
        common += has[left] @ has[right].T
    root, rid = frame["root"].to_numpy(), frame["rid"].to_numpy()
    linked = (100 * common >= percent * (size[left][:, None] + size[right][None] - common)) & (root[left][:, None] != root[right][None])
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    edges = []
    for i, j in zip(*np.nonzero(linked)):
        i, j = left[i], right[j]
        x, y = find(root[i]), find(root[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            edges.append((rid[i], rid[j]))
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 50, rows: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Two documents link when 100 * |A & B| >= percent * |A | B| for their shingle sets; components are over
    links. Null, empty and blank texts have no shingles and link with nothing, not even each other; a null id
    keeps its row (component_id null, kept true). Repeated rows stay, as members of one class. Other columns
    are not read, so clashing names do no harm. An empty table gives an empty result.
    """
    src = small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sketch = written(sketches(src, width, bands, rows), "sketches")
    classes = sketch.where("fp is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("m"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("rid"), "fp", F.col("m.doc_id").alias("first_id"), F.col("m.n_shingles").alias("size"), F.col("m.bands").alias("bands")), "classes")
    roots = class_components(src, classes, width, percent)
    if roots is None:
        named = classes.select("fp", F.col("first_id").alias("cid"))
    else:
        member = classes.select("rid", "fp", "first_id").join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left")
        member = written(member.select("fp", "first_id", F.coalesce("root", "rid").alias("root"), F.col("root").isNotNull().alias("linked")), "members")
        least = written(member.where("linked").groupBy("root").agg(F.min("first_id").alias("least")), "least")
        named = member.join(least, "root", "left").select("fp", F.coalesce("least", "first_id").alias("cid"))
    named = written(named, "named")
    discard(classes)
    slim = sketch.select("doc_id", "n_shingles", "fp")
    out = slim.join(named, "fp", "left").select("doc_id", "n_shingles", F.coalesce("cid", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def class_components(src: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame | None:
    """(node, root) over the classes that have links with others; None without any."""
    keyed = classes.select(F.explode("bands").alias("key"), "rid")
    stars = keyed.groupBy("key").agg(F.min("rid").alias("centre"), F.max("rid").alias("other")).where("centre <> other").select("key", "centre")
    members = written(keyed.join(stars, "key").select("key", "rid", "centre"), "buckets")
    pairs = written(members.where("rid <> centre").select(F.col("centre").alias("a"), F.col("rid").alias("b")).distinct(), "stars")
    if is_empty(pairs):
        return None
    wanted = members.select("rid").distinct()
    n = wanted.count()
    found = classes.select("rid", "fp", "first_id", "size").join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, "rid", "left_semi")
    found = written(found, "wanted")
    ids = found.select(F.col("first_id").alias("doc_id")).distinct()
    texts = src.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    # a doc_id may have several rows: the fingerprint tells which is meant
    sets = full_sets(texts, width).join(found.select("fp", "rid"), "fp").groupBy("rid").agg(F.first("s").alias("s"))
    sets = written(sets, "sets")
    judged = written(_confirm(pairs, sets, percent), "judged")
    links = judged.where("linked").select("a", "b")
    roots = components(links)

    # buckets whose members are not in one component yet
    placed = members.select("key", "rid").join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").select("key", "rid", F.coalesce("root", "rid").alias("root"))
    placed = written(placed, "placed")
    sizes = placed.groupBy("key", "root").count()
    open_keys = written(sizes.groupBy("key").agg(F.max(F.struct("count", "root")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("top.root").alias("top")), "open")
    here = written(placed.join(open_keys, "key").select("key", "rid", "root"), "ambiguous")
    for t in (placed, open_keys, members, pairs):
        discard(t)
    if is_empty(here):
        for t in (here, sets, found, judged):
            discard(t)
        return roots
    # what shares an ambiguous bucket, directly or by way of others, is compared block by block
    low = here.groupBy("key").agg(F.min("rid").alias("low"))
    fields = components(here.join(low, "key").where("rid <> low").select(F.col("low").alias("a"), F.col("rid").alias("b")).distinct())
    fields = written(fields.select(F.col("node").alias("rid"), F.col("root").alias("field")).join(found.select("rid", "size"), "rid"), "fields")
    parts = written(fields.groupBy("field").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("parts")), "parts")
    dealt = fields.join(parts, "field").select("field", "rid", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("part"))
    dealt = written(dealt.join(here.select("rid", "root").distinct(), "rid"), "dealt")
    tasks = parts.select("field", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), "parts").select("field", "i", F.explode(F.sequence(F.col("i"), F.col("parts") - 1)).alias("j"))
    tasks = written(tasks.withColumn("task", F.monotonically_increasing_id()), "tasks")
    sides = [dealt.join(t, ["field", "part"]).select("task", F.lit(k).alias("side"), "rid", "root") for k, t in enumerate((tasks.select("field", F.col("i").alias("part"), "task"), tasks.where("i <> j").select("field", F.col("j").alias("part"), "task")))]
    met = written(sides[0].union(sides[1]), "met").join(sets, "rid")
    again = met.groupBy("task").applyInPandas(lambda f: _links_between(f, percent), "a long, b long")
    again = written(again, "judged")
    out = roots if is_empty(again) else components(links.union(again))
    for t in (here, fields, parts, dealt, tasks, sets, found, judged, again, *([roots] if out is not roots else [])):
        discard(t)
    return out
