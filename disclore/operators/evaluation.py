"""How good a clustering is."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles, dot, euclidean_distance, l2_normalised
from .clustering import gmm, meta_cluster, normalised, reduced
from .density import flat_labels, hierarchy, row_labels, spanning_tree, weighted_points
from .pooling import mean_vectors
from .tables import dropped, written


def cosine_silhouette(df: DataFrame, label: str = "label", vector: str = "vector", noise: int | None = None) -> DataFrame:
    """One row: the mean silhouette by cosine distance, null below two clusters (ML11).

    The mean distance of a unit vector to a cluster is 1 - x . (sum of the cluster) / n, so the exact value
    needs the clusters' sums only, never pairs. A vector alone in its cluster has silhouette 0.
    """
    d = df.select(F.monotonically_increasing_id().alias("_i"), F.col(label).alias("_l"), l2_normalised(F.col(vector)).alias("_v"))
    d = d.where(F.col("_l").isNotNull())
    d = d if noise is None else d.where(F.col("_l") != noise)
    sums = mean_vectors(d, ["_l"], "_v").join(d.groupBy("_l").agg(F.count("*").alias("_n")), "_l")
    sums = sums.select(F.col("_l").alias("_m"), "_n", F.transform("_v", lambda x: x * F.col("_n")).alias("_s"))
    per = d.join(F.broadcast(sums))  # clusters are few; each row meets each cluster once
    own = F.col("_l") == F.col("_m")
    to = F.when(own, F.when(F.col("_n") > 1, (F.col("_n") - dot(F.col("_v"), F.col("_s"))) / (F.col("_n") - 1))).otherwise(1 - dot(F.col("_v"), F.col("_s")) / F.col("_n"))
    g = per.groupBy("_i").agg(F.max(F.when(own, to)).alias("a"), F.min(F.when(~own, to)).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return g.where("b is not null").agg(F.avg(s).alias("silhouette"))


def davies_bouldin(df: DataFrame, label: str = "label", vector: str = "vector", noise: int | None = None) -> DataFrame:
    """One row: the Davies-Bouldin index by Euclidean distance (ML12); pairs of centres only."""
    d = df.select(F.col(label).alias("_l"), doubles(F.col(vector)).alias("_v")).where(F.col("_l").isNotNull())
    d = d if noise is None else d.where(F.col("_l") != noise)
    centres = mean_vectors(d, ["_l"], "_v").withColumnRenamed("_v", "_c")
    spread = d.join(centres, "_l").groupBy("_l").agg(F.avg(euclidean_distance(F.col("_v"), F.col("_c"))).alias("_s"), F.first("_c").alias("_c"))
    a, b = spread, spread.select(F.col("_l").alias("_m"), F.col("_s").alias("_t"), F.col("_c").alias("_d"))
    ratio = (F.col("_s") + F.col("_t")) / euclidean_distance(F.col("_c"), F.col("_d"))
    return a.join(F.broadcast(b), F.col("_l") != F.col("_m")).groupBy("_l").agg(F.max(ratio).alias("_r")).agg(F.avg("_r").alias("davies_bouldin"))


def evaluated(df: DataFrame, label: str = "label", noise: int | None = None) -> dict:
    """Both indices, number of clusters and noise of one clustering."""
    kept = df if noise is None else df.where(F.col(label) != noise)
    n = kept.select(label).distinct().count()
    out = {"n_clusters": n, "n_noise": 0 if noise is None else df.where(F.col(label) == noise).count(), "silhouette": float("nan"), "davies_bouldin": float("nan")}
    if n > 1:
        out["silhouette"] = cosine_silhouette(kept, label).first()[0]
        out["davies_bouldin"] = davies_bouldin(kept, label).first()[0]
    return out


def _results(df: DataFrame, rows: list[dict]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows) if rows else df.sparkSession.createDataFrame([], "n_clusters int")


def gmm_grid(df: DataFrame, components: list[int], covariances: list[str] = ("full", "tied"), dims: list[int] = (50,)) -> DataFrame:
    """A run for each combination; vectors are reduced once for each number of dimensions (ML13)."""
    unit, out = normalised(df).persist(), []
    for k in dims:
        small = reduced(unit, k).persist()
        for n, c in product(components, covariances):
            labels = gmm(small, n, covariance=c)
            row = {"combo": f"pca{k}_gmm{n}_{c}"} | evaluated(unit.join(labels, "doc_id"))
            row["davies_bouldin"] = davies_bouldin(small.join(labels, "doc_id")).first()[0]
            out.append(row)
    return _results(df, out)


def hdbscan_grid(df: DataFrame, sizes=(5, 10, 15, 20), samples=(5, 10), eps=(0.01, 0.02, 0.05), dims=(0, 50, 100)) -> DataFrame:
    """Runs sorted by dimensions, then silhouette (ML13, SRT3); noise is left out of the indices. The spanning tree is made
    once for each number of dimensions and neighbours, its hierarchy once for each least size."""
    unit, out = normalised(df).persist(), []
    for k in dims:
        small = reduced(unit, k).persist()
        points, rows = weighted_points(small)
        for m in samples:
            tree = written(spanning_tree(points, m), "tree")
            for s in sizes:
                members, clusters = hierarchy(points, tree, s)
                for e in eps:
                    labels = row_labels(points, rows, flat_labels(members, clusters, e))
                    out.append({"combo": f"pca{k}_min{s}_samp{m}_eps{e:.2f}", "pca_dim": k} | evaluated(small.join(labels, "doc_id"), noise=-1))
            dropped(tree)
        small.unpersist()
    unit.unpersist()
    return _results(df, out).orderBy("pca_dim", F.desc_nulls_last(F.nanvl("silhouette", F.lit(None).cast("double"))))


def meta_grid(df: DataFrame, k_base=(10, 20, 30), sizes=(5, 12, 20), k_meta=(5, 10, 15, 20)) -> DataFrame:
    unit, out = normalised(df).persist(), []
    for b, s, m in product(k_base, sizes, k_meta):
        labels = meta_cluster(unit, b, s, m).withColumnRenamed("meta_cluster", "label")
        out.append({"combo": f"kbase{b}_hdb{s}_kmeta{m}"} | evaluated(unit.join(labels, "doc_id")))
    return _results(df, out)
