"""Bounded samples of labelled documents, and small fits shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Characters of all training texts of a class together, and of the pieces that stand for a text beyond its share.
BUDGET, PIECE = 24_000_000, 2_048


def remainder(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``: the fold that is kept from learning."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: tuple[int, int], budget: int = BUDGET) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class`` documents of label 0 and of label 1, of any length, none of the held-out fold.

    The bound is ``per_class`` rows of ``labels`` a class, by the least hashes of the id. No text is left out for its
    length: where the texts of a class have more than ``budget`` characters together, the longest ones are told by pieces
    of PIECE characters, spread evenly from their start to their end, so that all lengths stay and the driver's memory is
    bounded (``share`` tells how many characters a text may have then). Rows with a null label, id or text and empty texts
    are left out; labelled ids without a document only make the sample smaller; of repeated rows one counts, of an id with
    several texts each. The documents are scanned once.
    """
    wanted = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != held)).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    ids = [(r["doc_id"], y) for y in (0, 1) for r in wanted.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[y]).collect()]
    if not ids:
        return []
    picked = docs.sparkSession.createDataFrame(ids, "doc_id long, y int")  # at most sum(per_class) rows
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("length(text) > 0").join(F.broadcast(picked), "doc_id")
    found = written(found.select("doc_id", "y", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), F.length("text").alias("n"), "text"), "labelled")
    out: list[tuple[str, int]] = []
    for y in (0, 1):
        rows = found.where(F.col("y") == y).select("h", "doc_id", "t", "n").distinct().orderBy("h", "doc_id", "t").limit(per_class[y]).collect()
        if rows:
            most = share([r["n"] for r in rows], budget)
            chosen = found.where(F.col("y") == y).join(F.broadcast(docs.sparkSession.createDataFrame([(r["doc_id"], r["t"]) for r in rows], "doc_id long, t long")), ["doc_id", "t"])
            texts = {(r["doc_id"], r["t"]): r["text"] for r in chosen.select("doc_id", "t", pieces(F.col("text"), most).alias("text")).dropDuplicates(["doc_id", "t"]).collect()}  # within the budget
            out += [(texts[k], y) for k in sorted(texts)]
    discard(found)
    return out


def share(lengths: list[int], budget: int) -> int:
    """The most characters that a text may have so that all of them, cut to it, are within ``budget``; at least PIECE."""
    left, texts = budget, sorted(lengths)
    for i, n in enumerate(texts):
        if n * (len(texts) - i) > left:
            return max(PIECE, left // (len(texts) - i))
        left -= n
    return max(texts, default=PIECE)


def pieces(text: Column, most: int) -> Column:
    """``text``, or where it has more than ``most`` characters, that many in pieces from evenly spaced places, by lines."""
    k = max(1, most // PIECE)
    step = (F.length(text) - PIECE) / F.lit(float(max(1, k - 1)))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(PIECE)))
    return F.when(F.length(text) > F.greatest(F.lit(most), F.lit(PIECE)), F.array_join(places, "\n")).otherwise(text)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights (the last is the bias) by Newton's method, classes weighted alike."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + l2 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def platt_shift(score_raw: np.ndarray, y: np.ndarray, cut: float, alarm: float = 1.0) -> float:
    """What to add to the log odds so that ``cut`` falls into the middle of the gap that splits the classes best, where the
    share of label 0 above it weighs ``alarm`` times as much as that of label 1 below."""
    order = np.argsort(score_raw)
    s, t = score_raw[order], y[order]
    good = alarm * np.concatenate([[0], np.cumsum(t == 0)]) / max(1, (t == 0).sum()) + (1 - np.concatenate([[0], np.cumsum(t == 1)]) / max(1, (t == 1).sum()))
    best = np.flatnonzero(good >= good.max() - 1e-12)
    edges = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    at = edges[best].mean()
    return float(np.log(cut / (1 - cut)) - at)
