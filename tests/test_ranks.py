"""Order statistics and medoids against sorted groups and matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from disclore.operators import pooling, ranks, sampling


@pytest.fixture(scope="module")
def placed(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c, n in enumerate((1, 2, 3, 7, 40, 900)):
        d = rng.choice([0.5, 0.5, 0.25, *rng.random(50)], n)
        rows += [(c, f"d{c}-{i:04d}", float(x)) for i, x in enumerate(d)]
    rows += [(6, f"same-{i:04d}", 0.125) for i in range(300)] + [(7, "n", None), (7, "m", float("nan")), (7, "o", 1.0)]
    return spark.createDataFrame(rows, "cluster int, doc_id string, distance double")


def in_order(placed):
    out = {}
    for r in placed.collect():
        d = r["distance"]
        out.setdefault(r["cluster"], []).append(((d is not None, d is not None and d != d, 0.0 if d is None or d != d else round(d, 9)), r["doc_id"]))
    return {c: [i for _, i in sorted(v)] for c, v in out.items()}


@pytest.mark.parametrize("cells", [3, 2048])
def test_regions_equal_sorted_groups(spark, placed, monkeypatch, cells):
    monkeypatch.setattr(ranks, "CELLS", cells)
    want = set()
    for c, ids in in_order(placed).items():
        n = len(ids)
        start = max(0, n // 2 - 2)
        want |= {(c, i, "closest", k) for k, i in enumerate(ids[:5])} | {(c, i, "middle", k) for k, i in enumerate(ids[start : start + 5])} | {(c, i, "farthest", k) for k, i in enumerate(ids[::-1][:3])}
    got = [tuple(r) for r in sampling.regions(placed, 5, 3).select("cluster", "doc_id", "region", "place").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    quarters = {(r["cluster"], r["doc_id"]): r["region"] for r in sampling.quartiles(placed).collect()}
    for c, ids in in_order(placed).items():
        n = len(ids)
        assert [quarters[c, i] for i in ids] == ["center"] * (n // 4) + ["mid"] * (3 * n // 4 - n // 4) + ["edge"] * (n - 3 * n // 4)


def test_no_window_over_whole_clusters(placed):
    plan = sampling.quartiles(placed)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_places_within_groups(placed):
    got = {}
    for r in ranks.positions(placed.where("cluster < 7"), ["cluster"], ["distance", "doc_id"]).collect():
        got.setdefault(r["cluster"], {})[r["position"]] = r["doc_id"]
    assert {c: [v[k] for k in range(len(v))] for c, v in got.items()} == {c: v for c, v in in_order(placed).items() if c < 7}


def test_medoids_equal_matrices_with_far_fewer_distances(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", 50)
    monkeypatch.setattr(ranks, "WAVE", 2)
    rng = np.random.default_rng(2)
    groups = {c: np.vstack([rng.normal(0, 1, (n, 2)), np.repeat([[4.0, 4.0]], n // 10, 0)]) for c, n in zip("abcdef", (1, 3, 30, 900, 6000, 700))}
    rows = [(c, i, v.tolist()) for c, x in groups.items() for i, v in enumerate(x)] + [("a", 9, None), ("b", 9, [1.0, None])]
    found, taken = ranks.medoids(spark.createDataFrame(rows, "doc_id string, chunk_id int, vector array<double>"), "doc_id", "chunk_id", "vector")
    got = {r["doc_id"]: r["vector"] for r in found.collect()}
    for c, x in groups.items():
        d = np.sqrt(sum((x[:, [j]] - x[:, j]) ** 2 for j in (0, 1)))
        assert got[c] == x[np.round(d.sum(1), 9).argmin()].tolist()
    assert taken["large"] < sum(len(x) ** 2 for x in groups.values()) / 6


def test_means_leave_out_vectors_with_gaps(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("a", None), ("a", [None, 1.0]), ("b", [5.0, 5.0])], "k string, vector array<double>")
    assert {r["k"]: r["vector"] for r in pooling.mean_vectors(df, ["k"]).collect()} == {"a": [2.0, 4.0], "b": [5.0, 5.0]}
    assert pooling.medoid_vectors(df.select(F.col("k").alias("doc_id"), F.lit(0).alias("chunk_id"), "vector").limit(0)).count() == 0
