"""Exact threshold pairs of embeddings by cover trees and dual traversal.

A cover tree nests levels whose radii halve: the children of a node are a net of its members at half its
radius. Two trees are walked together from their roots; a pair of nodes whose centres lie further apart
than the threshold distance plus both covering radii is dropped with all below it, a pair that lies wholly
within the threshold is counted as a whole, and only what remains is compared vector by vector.

On the cluster, the top level of the tree is a set of pivots shared by all tasks (a net of a bounded
sample, ``SAMPLE`` vectors; it only steers pruning, never the result). A vector belongs to its nearest
pivot; the vectors of a label and pivot are dealt into blocks of about ``block`` vectors. Blocks of a label
are paired unless their covering radii keep them apart, and a task walks the trees of one pair of blocks.
It returns, per vector, a count of links and one edge to an anchor of its component there, never pairs, so
a large group of near copies costs one row per vector and task. Equal vectors of a label are one vector
with a weight. In data without structure all blocks of a label meet: the work is then quadratic in the
label's distinct vectors, as for any exact method; the rows are not.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, is_empty, written
from .graph import components

LEAF = 24
SAMPLE = 512
#: Rows of a matrix of dot products at once, and edges noted before they are joined: they bound memory, nothing else.
CHUNK, EDGES = 256, 1 << 20
#: More than the rounding of a distance: the root of 2 - 2xy is off by up to about 3e-8 where x and y nearly agree.
SLACK = 1e-7


def unit(rows: list) -> np.ndarray:
    """The vectors scaled to length 1 in double precision (none is zero or has non-finite parts)."""
    x = np.array([np.asarray(r, np.float64) for r in rows])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def _net(x: np.ndarray, reach: float) -> np.ndarray:
    """For every vector the number of its part: each part has a centre, its first vector, and none lies further from it
    than ``reach``. Greedy, by chunks: to the nearest centre if one covers it, else centres are taken from the rest.
    Parts are numbered as their centres lie, so that the first vector stays first."""
    part, centres, enough = np.empty(len(x), np.int64), np.empty(0, np.int64), 1 - reach * reach / 2
    for lo in range(0, len(x), CHUNK):
        rest = np.arange(lo, min(lo + CHUNK, len(x)))
        if len(centres):
            dots = x[rest] @ x[centres].T
            at = dots.argmax(1)
            covered = dots[np.arange(len(rest)), at] >= enough
            part[rest[covered]] = at[covered]
            rest = rest[~covered]
        close = x[rest] @ x[rest].T >= enough
        np.fill_diagonal(close, True)
        alone = close.sum(1) == 1
        new, free = list(rest[alone]), ~alone
        part[rest[alone]] = len(centres) + np.arange(len(new))
        for k in np.flatnonzero(free):
            if free[k]:
                take = close[k] & free
                part[rest[take]] = len(centres) + len(new)
                new.append(rest[k])
                free &= ~take
        centres = np.append(centres, np.array(new, np.int64))
    return np.argsort(np.argsort(centres))[part]


class Tree:
    """A cover tree in arrays. The vectors lie in tree order: ``x`` is ``vectors[order]`` and node k holds those from
    ``start[k]``, its centre, to ``end[k]``; ``radius`` is the true covering radius; its children are the ``kids[k]``
    nodes from ``kid[k]``. A leaf's children are its vectors, which have none."""

    def __init__(self, vectors: np.ndarray):
        self.order, self.x = np.arange(len(vectors)), vectors.copy()
        start, end, radius = [np.array([0])], [np.array([len(vectors)])], [np.array([float(_distance(self.x, self.x[:1]).max())])]
        made, todo, opened = 1, deque([(0, 0, len(vectors), float(radius[0][0]), 4.0)]), []
        while todo:
            k, lo, hi, r, reach = todo.popleft()
            if hi - lo == 1:
                continue
            firsts = np.arange(hi - lo)
            if hi - lo > LEAF and r > SLACK:
                while True:  # halve until the net has more than one point
                    reach /= 2
                    if r > reach or reach < SLACK:
                        break
                part = _net(self.x[lo:hi], max(reach, SLACK))
                by = np.argsort(part, kind="stable")
                parted = np.flatnonzero(np.diff(part[by], prepend=-1))
                if len(parted) > 1:
                    firsts = parted
                    self.order[lo:hi], self.x[lo:hi] = self.order[lo:hi][by], self.x[lo:hi][by]
            lasts = np.append(firsts[1:], hi - lo)
            here = self.x[lo:hi]
            apart = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", here, here[np.repeat(firsts, lasts - firsts)]), 0))
            radii = np.where(lasts - firsts > 1, np.maximum.reduceat(apart, firsts), 0.0)
            start.append(lo + firsts)
            end.append(lo + lasts)
            radius.append(radii)
            opened.append((k, made, len(firsts)))
            todo.extend((made + c, lo + int(firsts[c]), lo + int(lasts[c]), float(radii[c]), reach) for c in np.flatnonzero(lasts - firsts > 1))
            made += len(firsts)
        self.start, self.end, self.radius = np.concatenate(start), np.concatenate(end), np.concatenate(radius)
        self.kid, self.kids = np.zeros(made, np.int64), np.zeros(made, np.int64)
        for k, first, n in opened:
            self.kid[k], self.kids[k] = first, n
        self.single = self.kids == 0

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """The children of the nodes; a single vector stands for itself."""
        n = np.maximum(self.kids[nodes], 1)
        first = np.where(self.single[nodes], nodes, self.kid[nodes])
        return np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())


class Links:
    """Weighted counts of links, and a forest over vectors in tree order. Nodes are counted as wholes: what is added
    for one is noted where its vectors start and, negated, where they end, and is summed up once by ``counts``."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.upto = weights, np.append(0, np.cumsum(weights))
        self.added, self.within, self.glued = (np.zeros(len(weights) + 1, np.int64) for _ in range(3))
        self.root, self.edges, self.waiting = np.arange(len(weights)), [], 0

    def whole(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> None:
        """All vectors of each range a link with all of the range b beside it."""
        for s, e, o, p in ((a, a_end, b, b_end), (b, b_end, a, a_end)):
            n = self.upto[p] - self.upto[o]
            np.add.at(self.added, s, n)
            np.add.at(self.added, e, -n)
            self._glue(s, e)
        self.edges.append((a, b))
        self.waiting += len(a)
        if self.waiting > EDGES:
            self._join()

    def inside(self, a: np.ndarray, a_end: np.ndarray) -> None:
        """All vectors of each range link with one another."""
        n = self.upto[a_end] - self.upto[a]
        np.add.at(self.added, a, n)
        np.add.at(self.added, a_end, -n)
        np.add.at(self.within, a, 1)
        np.add.at(self.within, a_end, -1)
        self._glue(a, a_end)

    def _glue(self, a: np.ndarray, a_end: np.ndarray) -> None:
        np.add.at(self.glued, a, 1)
        np.add.at(self.glued, a_end - 1, -1)

    def _join(self) -> None:
        a, b = (np.concatenate(e) for e in zip(*self.edges))
        self.edges, self.waiting = [], 0
        while True:
            a, b = self.root[a], self.root[b]
            differ = a != b
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root != (up := self.root[self.root])).any():
                self.root = up

    def counts(self) -> np.ndarray:
        return np.cumsum(self.added)[:-1] - np.cumsum(self.within)[:-1] * self.weights

    def roots(self) -> np.ndarray:
        next_too = np.flatnonzero(np.cumsum(self.glued)[:-1])
        self.edges.append((next_too, next_too + 1))
        self._join()
        return self.root


def _grouped(keys: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each key (an array of one) with its values."""
    by = np.argsort(keys, kind="stable")
    firsts = np.flatnonzero(np.diff(keys[by], prepend=-1))
    return [(keys[g[:1]], values[g]) for g in np.split(by, firsts[1:])] if len(by) else []


def dual(p: Tree, q: Tree, threshold: float, links: Links) -> None:
    """All links between the vectors of p and of q (whose places follow p's); those within p when q is p.

    A step takes some nodes of p against some of q as one matrix. What is too far apart is dropped, what is wholly
    within the threshold is counted, two vectors are compared, and the rest is opened: each node that has children
    with all it has to be compared with, so that the steps follow the nodes and not the pairs of them.
    """
    t = float(np.sqrt(2 - 2 * threshold))
    shift = 0 if p is q else len(p.x)
    root = np.zeros(1, np.int64)
    todo = [(root, root, p is q)]
    while todo:
        a_all, b, same = todo.pop()  # same: a against itself, each pair once
        for lo in range(0, len(a_all), CHUNK):
            a = a_all[lo : lo + CHUNK]
            dots = p.x[p.start[a]] @ q.x[q.start[b]].T
            near = np.sqrt(np.maximum(2 - 2 * dots, 0)) <= (p.radius[a] + (t + SLACK))[:, None] + q.radius[b][None, :]
            i, j = np.nonzero(near)
            if same:
                i, j = i[i + lo <= j], j[i + lo <= j]
                own = a[i[i + lo == j]]
                i, j = i[i + lo < j], j[i + lo < j]
                tight = 2 * p.radius[own] < t - SLACK
                links.inside(p.start[own[tight]], p.end[own[tight]])
                todo += [(k, k, True) for k in (p.below(own[[c]]) for c in np.flatnonzero(~tight & ~p.single[own]))]
            if not len(i):
                continue
            dot, i, j = dots[i, j], a[i], b[j]
            pair = p.single[i] & q.single[j]
            linked = np.where(pair, dot >= threshold, np.sqrt(np.maximum(2 - 2 * dot, 0)) + p.radius[i] + q.radius[j] < t - SLACK)
            links.whole(p.start[i[linked]], p.end[i[linked]], shift + q.start[j[linked]], shift + q.end[j[linked]])
            i, j = i[~linked & ~pair], j[~linked & ~pair]
            inner = ~p.single[i]
            todo += [(p.below(k), q.below(js), False) for k, js in _grouped(i[inner], j[inner])]
            todo += [(ks, q.below(k), False) for k, ks in _grouped(j[~inner], i[~inner])]


def links_of_blocks(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """rid, n, anchor for the vectors of one pair of blocks (side 0 and 1; side 0 alone: within the block)."""
    frame = frame.sort_values(["side", "rid"], ignore_index=True)
    x, left = unit(frame["v"].tolist()), int((frame["side"] == 0).sum())
    a = Tree(x[:left])
    b = Tree(x[left:]) if left < len(x) else a
    order = a.order if b is a else np.append(a.order, left + b.order)
    links = Links(frame["weight"].to_numpy()[order])
    dual(a, b, threshold, links)
    rid = frame["rid"].to_numpy()[order]
    out = pd.DataFrame({"rid": rid, "n": links.counts(), "anchor": rid[links.roots()]})
    return out[out["n"] > 0]


def _pivots(distinct: DataFrame, n: int, threshold: float) -> np.ndarray:
    """A net of at most ``n`` vectors of one length from a bounded sample, the least hashes, farthest first."""
    rows = [r["v"] for r in distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()]
    length = max(map(len, rows))
    x = unit([r for r in rows if len(r) == length])
    chosen = [0]
    d = _distance(x, x[:1])[:, 0]
    while len(chosen) < min(n, len(x)):
        far = int(d.argmax())
        if d[far] <= SLACK:
            break
        chosen.append(far)
        d = np.minimum(d, _distance(x, x[[far]])[:, 0])
    return x[chosen]


def near_links(vectors: DataFrame, threshold: float = 0.93, block: int = 2048, max_pivots: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null labels and equal length link when their cosine in double precision reaches
    ``threshold``. Vectors that are null, empty, zero or hold null or non-finite parts link with nothing, as
    do those with a null label or id. Repeated rows count as vectors of their own (an id given twice links
    with itself as another row). Other columns are not read; an empty table gives an empty result.
    """
    src = vectors.select(vectors[id_col].cast("long").alias("vec_id"), F.transform(vectors[vector_col], lambda e: e.cast("double")).alias("v"), vectors[label_col].alias("label"))
    sound = F.expr("vec_id is not null and label is not null and v is not null and size(v) > 0 and forall(v, e -> e is not null and not isnan(e) and abs(e) < double('infinity')) and exists(v, e -> e <> 0)")
    src = src.withColumn("sound", F.coalesce(sound, F.lit(False)))
    label = F.coalesce(F.col("label").cast("string"), F.lit(""))
    keyed = src.withColumn("k1", F.when(F.col("sound"), F.xxhash64(label, "v"))).withColumn("k2", F.when(F.col("sound"), F.xxhash64(F.lit(7), "v", label)))
    slim = written(keyed.select("vec_id", "k1", "k2", "sound"), "vectors")
    distinct = keyed.where("sound").groupBy("k1", "k2").agg(F.first("v").alias("v"), F.first(F.concat_ws(":", F.size("v"), label)).alias("label"), F.count("*").alias("weight"), F.min("vec_id").alias("first_id"))
    distinct = written(distinct.withColumn("rid", F.monotonically_increasing_id()), "distinct")
    alone = slim.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if is_empty(distinct):
        return alone
    largest = distinct.groupBy("label").count().agg(F.max("count")).first()[0]
    pivots = _pivots(distinct, min(max_pivots, -(-largest // block)), threshold)

    @F.pandas_udf("struct<pivot:int,d:double>")
    def nearest(v: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"pivot": np.zeros(len(v), np.int32), "d": np.full(len(v), 2.0)})
        sizes = v.map(len).to_numpy()
        same = np.flatnonzero(sizes == pivots.shape[1])  # vectors of another length share pivot 0, with no bound
        if len(same):
            d = _distance(unit([v.iloc[i] for i in same]), pivots)
            out.loc[same, "pivot"] = d.argmin(1).astype(np.int32)
            out.loc[same, "d"] = d.min(1)
        return out

    placed = distinct.withColumn("near", nearest("v")).select("rid", "label", "v", "weight", F.col("near.pivot").alias("pivot"), F.col("near.d").alias("d"))
    placed = written(placed, "placed")
    cells = placed.groupBy("label", "pivot").agg(F.count("*").alias("n"), F.max("d").alias("r")).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    cells = written(cells, "cells")
    dealt = placed.join(cells.select("label", "pivot", "parts"), ["label", "pivot"]).select("rid", "label", "pivot", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("part"), "v", "weight")
    dealt = written(dealt, "dealt")
    discard(placed)
    gaps = _distance(pivots, pivots)
    spark = vectors.sparkSession
    gap = spark.createDataFrame([(i, j, float(gaps[i, j])) for i in range(len(pivots)) for j in range(len(pivots))], "p int, q int, gap double")  # at most max_pivots squared rows
    blocks = cells.select("label", "pivot", "r", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    one = blocks.select("label", F.col("pivot").alias("p"), F.col("part").alias("i"), F.col("r").alias("rp"))
    two = blocks.select("label", F.col("pivot").alias("q"), F.col("part").alias("j"), F.col("r").alias("rq"))
    t = float(np.sqrt(2 - 2 * threshold))
    pairs = one.join(two, "label").where("p < q or p = q and i <= j").join(F.broadcast(gap), ["p", "q"]).where(F.col("gap") <= F.lit(t + 2 * SLACK) + F.col("rp") + F.col("rq"))
    pairs = written(pairs.select("label", "p", "i", "q", "j", F.monotonically_increasing_id().alias("pair")), "pairs")
    first = dealt.join(pairs.select("label", F.col("p").alias("pivot"), F.col("i").alias("part"), "pair"), ["label", "pivot", "part"]).select("pair", F.lit(0).alias("side"), "rid", "weight", "v")
    second = dealt.join(pairs.where("p <> q or i <> j").select("label", F.col("q").alias("pivot"), F.col("j").alias("part"), "pair"), ["label", "pivot", "part"]).select("pair", F.lit(1).alias("side"), "rid", "weight", "v")
    found = first.union(second).groupBy("pair").applyInPandas(lambda f: links_of_blocks(f, threshold), "rid long, n long, anchor long")
    found = written(found, "links")
    for t in (cells, dealt, pairs):
        discard(t)
    counts = found.groupBy("rid").agg(F.sum("n").alias("n"))
    roots = components(found, "rid", "anchor")
    member = distinct.select("rid", "k1", "k2", "first_id", "weight").join(counts, "rid", "left").join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left")
    member = written(member.select("k1", "k2", "first_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rid").alias("root")), "members")
    least = written(member.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    named = written(member.join(least, "root").select("k1", "k2", "n_links", "component_id"), "named")
    for t in (distinct, found, roots, member, least):
        discard(t)
    out = slim.join(named, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
