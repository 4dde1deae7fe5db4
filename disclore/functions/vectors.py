"""Vector mathematics on array columns, within whole-stage code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalised(a: Column) -> Column:
    """Length 1; a zero vector stays zero (MTH1). The length is computed once a row, not in the lambda for each component."""
    return F.get(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))), 0)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; a zero vector is at distance 1 from all (MTH2)."""
    n = norm(a) * norm(b)
    return 1 - dot(a, b) / F.when(n == 0, 1.0).otherwise(n)


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


#: Distances of matrices are told to this many digits, so that equal ones are equal however they were summed.
DIGITS = 9
#: Distances that are taken at once.
ROWS = 1 << 17


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows; small ones, where the product of sums loses digits, are summed anew."""
    a, b = (x * x).sum(1), (y * y).sum(1)
    out = np.empty((len(x), len(y)))
    rows = max(1, ROWS // max(1, len(y)))
    for at in range(0, len(x), rows):  # a few rows at a time, which stay in the cache
        d, p = out[at : at + rows], x[at : at + rows] @ y.T
        np.add(a[at : at + rows, None], b[None], out=d)
        p *= 2
        d -= p
        if d.size and d.min() < 1e-4 * (a[at : at + rows].max() + b.max()):
            i, j = np.nonzero(d < 1e-4 * (a[at : at + rows, None] + b[None]))
            for k in range(0, len(i), 65536):
                q, r = i[k : k + 65536], j[k : k + 65536]
                d[q, r] = ((x[at + q] - y[r]) ** 2).sum(1)
        np.maximum(d, 0, out=d)
        np.sqrt(d, out=d)
        np.round(d, DIGITS, out=d)
    return out
