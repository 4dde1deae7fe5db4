"""Work that grew with the square of a group, or went to one task, and no longer does."""

import time

import numpy as np
from pyspark.sql import functions as F

from disclore.functions import text
from disclore.operators import density, fusion, pooling, ranks, records, tables


def totals(spark):
    """(rows shuffled, MB shuffled, spilled to disk and written) of the session so far."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsc.sc().statusStore()
    stages = store.stageList(None, *[getattr(store, f"stageList$default${i}")() for i in (2, 3, 4, 5)])
    stages = [stages.apply(i) for i in range(stages.size())]
    return np.array([sum(x.shuffleWriteRecords() for x in stages), sum(x.shuffleWriteBytes() + x.diskBytesSpilled() + x.outputBytes() for x in stages) / 1e6])


def pairs(rows):
    return sorted(rows, key=str)


def test_coassociation_shuffles_no_pairs(spark):
    df = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, label_0 int, label_1 int")
    before = totals(spark)[0]
    got = fusion.coassociation(df, ["label_0", "label_1"]).agg(F.count("*"), F.sum("weight")).first()
    assert tuple(got) == (400 * 399, 2 * (200 * 199) + 2 * 200 * 200 * 0.5)
    assert totals(spark)[0] - before < 400 * 399 / 10


def test_coassociation_counts_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(tables, "PART", 2)
    rows = [(1, 0, 5), (1, 0, 6), (2, 0, 6), (3, -1, 6), (4, -1, -1), (5, None, 5), (None, 0, 5)]
    got = fusion.coassociation(spark.createDataFrame(rows, "doc_id int, a int, b int"), ["a", "b"]).collect()
    want = {}
    for i, *x in rows:
        for j, *y in rows:
            n = sum(p == q and p not in (-1, None) for p, q in zip(x, y)) / 2
            if n and None not in (i, j) and i != j:
                want[i, j] = want.get((i, j), 0) + n
    assert {(r["i"], r["j"]): r["weight"] for r in got} == want and len(got) == len(want)


def test_pairs_of_one_key_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(tables, "PART", 8, raising=False)
    a = spark.createDataFrame([("x", i % 20, i) for i in range(60)] + [("y", 1, 1), (None, 1, 1)], "handle string, path int, more int")
    b = spark.createDataFrame([("x", None)] + [("x", i) for i in range(50)] + [("z", 1), (None, 2)], "handle string, path int")
    out = records.both_present(a, b)
    assert out.columns == ["handle", "path_a", "more", "path_b"]
    got = out.withColumn("task", F.spark_partition_id()).collect()
    want = [("x", i % 20, i, j) for i in range(60) for j in [None, *range(50)]]
    assert pairs(tuple(r)[:4] for r in got) == pairs(want)
    assert len({r["task"] for r in got}) > 3




def test_blocks_that_all_meet_are_not_shuffled(spark):
    x = np.random.default_rng(4).normal(size=(300, 64))
    points = tables.written(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "p long, v array<double>, w long"), "points")
    before = totals(spark)
    rows = density.neighbours(points, 4, block=10).collect()  # 30 blocks and more
    d = density.distances(x, x)
    want = {i: sorted(np.lexsort((np.arange(300), d[i]))[:4].tolist()) for i in range(300)}
    got = {}
    for r in rows:
        got.setdefault(r["p"], []).append(r["q"])
    assert {p: sorted(q) for p, q in got.items()} == want
    blocks, pivots, radii = density.packed(points, 10)
    core = density.core_distances(blocks, pivots, radii, 3).join(blocks, "block").collect()
    found = {int(p): c for r in core for p, c in zip(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["core"]))}
    assert np.allclose([found[i] for i in range(300)], np.sort(d, 1)[:, 3])
    assert (totals(spark) - before)[1] < 8  # the vectors take 0.15 MB


def test_words_are_shuffled_once(spark):
    rng = np.random.default_rng(2)
    texts = [[f"w{x}" for x in rng.integers(0, 900, 300)] for _ in range(50)]
    rows = [(i % 2, i // 2, " ".join(t)) for i, t in enumerate(texts)] + [(0, 0, "w1 again"), (1, 99, ""), (2, 0, None)]
    before = totals(spark)[0]
    got = {(r[0], r[1]): r[2] for r in pooling.tfidf_weights(spark.createDataFrame(rows, "doc_id int, chunk_id int, text string").repartition(4)).collect()}
    assert totals(spark)[0] - before < 1.2 * 50 * 300
    for d in (0, 1):
        tf = {}
        for k, c, t in rows:
            if k == d:
                tf.setdefault(c, []).extend(t.split())
        n = sum(k == d for k, _, _ in rows)
        words = {w for t in tf.values() for w in t}
        idf = {w: np.log((1 + n) / (1 + sum(w in t for t in tf.values()))) + 1 for w in words}
        s = {}
        for c, t in tf.items():
            x = np.array([t.count(w) * idf[w] for w in set(t)])
            s[c] = (x.sum() / np.sqrt((x * x).sum()) if len(x) else 0) + 1e-9
        total = sum(s[c] for k, c, _ in rows if k == d)
        assert all(abs(got[d, c] - s[c] / total) < 1e-12 for c in s)


def test_signs_that_become_blanks_take_linear_time(spark):
    n = 300_000
    df = spark.createDataFrame([("x" + "\u00e9" * n + "y\u00e9\u00e9\n5 \u00a0|z\u00e9" + "\u0085\t",)], "a string")
    start = time.time()
    got = df.select(text.normalise_hebrew(F.col("a"))).first()[0]
    assert got == "x" + " " * n + "y\n5  |z" or got == "x" + " " * n + "y   5  |z"
    assert time.time() - start < 10


def test_tree_looks_at_a_pair_of_blocks_once(spark, monkeypatch):
    x = np.random.default_rng(9).normal(size=(150, 32))
    points = tables.written(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "p long, v array<double>, w long"), "points")
    met, plain = [], density._paired

    def paired(pairs, state, columns):
        met.append((pairs.count(), state.count()))
        return plain(pairs, state, columns)

    monkeypatch.setattr(density, "_paired", paired)
    tree = density.spanning_tree(points, 3, block=30).collect()
    d = density.distances(x, x)
    core = np.sort(d, 1)[:, 3]
    d = np.maximum(np.maximum(core[:, None], core[None]), d)
    best, left, want = d[0].copy(), np.arange(150) > 0, []
    while left.any():
        now = int(np.where(left, best, np.inf).argmin())
        want.append(best[now])
        left[now], best = False, np.minimum(best, d[now])
    assert sorted(r["weight"] for r in tree) == sorted(want)
    blocks = met[0][1]
    assert blocks >= 5 and sum(n for n, _ in met[1:]) <= blocks * (blocks - 1) // 2  # the first is of the core distances


def test_medoids_in_many_dimensions_write_little(spark, monkeypatch):
    for name, value in (("SMALL", 50), ("CANDIDATES", 4), ("TILE", 64)):
        monkeypatch.setattr(ranks, name, value, raising=False)
    x = np.random.default_rng(5).normal(size=(2, 200, 48))
    df = spark.createDataFrame([(k, i, v.tolist()) for k, g in enumerate(x) for i, v in enumerate(g)], "k int, i int, v array<double>")
    written, plain = [], ranks.written

    def counted(df, label):
        out = plain(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(ranks, "written", counted)
    found, _ = ranks.medoids(df, "k", "i", "v")
    got = {r["k"]: r["v"] for r in found.collect()}
    for k, g in enumerate(x):
        assert np.allclose(got[k], g[np.round(density.distances(g, g).sum(1), 9).argmin()])
    assert sum(written) < 10 * 400  # rows, not one table of them a round


def test_files_of_pairs_are_small(spark, tmp_path):
    a = spark.range(500).select(F.lit(3).alias("handle"), (F.col("id") * 7).alias("path"))
    b = spark.range(4003).select(F.lit(3).alias("handle"), (F.col("id") * 11).alias("path"))
    at = str(tmp_path / "pairs")
    records.both_present(a, b).write.parquet(at)
    got = spark.read.parquet(at).agg(F.count("*"), F.sum("path_a"), F.sum("path_b"), F.countDistinct("path_a", "path_b")).first()
    assert tuple(got) == (500 * 4003, 7 * sum(range(500)) * 4003, 11 * sum(range(4003)) * 500, 500 * 4003)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * 500 * 4003


def test_files_of_coassociation_are_small(spark, tmp_path):
    df = spark.range(1500).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label_0"), (F.col("id") % 3).cast("int").alias("label_1"))
    at = str(tmp_path / "pairs")
    fusion.coassociation(df, ["label_0", "label_1"]).write.parquet(at)
    rows, weight = spark.read.parquet(at).agg(F.count("*"), F.sum("weight")).first()
    assert (rows, weight) == (6 * 250 * 1000 - 1500, 6 * 250 * (250 + 0.5 * 750) - 1500)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * rows


def test_tree_comes_from_the_nearest_points(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(170, 32))
    x = np.concatenate([x, x[:1] + rng.normal(scale=1e-3, size=(30, 32))])  # a group that hides what is around it
    points = tables.written(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "p long, v array<double>, w long"), "points")
    met, plain = [], density._paired

    def paired(pairs, state, columns):
        met.append(pairs.count())
        return plain(pairs, state, columns)

    monkeypatch.setattr(density, "_paired", paired)
    tree = density.spanning_tree(points, 3, block=20).collect()
    d = density.distances(x, x)
    core = np.sort(d, 1)[:, 3]
    d = np.maximum(np.maximum(core[:, None], core[None]), d)
    best, left, want = d[0].copy(), np.arange(200) > 0, []
    while left.any():
        now = int(np.where(left, best, np.inf).argmin())
        want.append(best[now])
        left[now], best = False, np.minimum(best, d[now])
    assert np.allclose(sorted(r["weight"] for r in tree), sorted(want))
    assert sum(met[1:]) < met[0] / 3  # the first pairs are those of the core distances
