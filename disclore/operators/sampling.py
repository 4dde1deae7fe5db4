"""Representative documents by distance to the cluster's centre, and stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, euclidean_distance
from .pooling import mean_vectors
from .ranks import looked_up, rows_at
from .tables import written


def with_distance(df: DataFrame, cluster: str = "cluster", vector: str = "vector", metric: str = "cosine") -> DataFrame:
    """Adds ``distance`` to the cluster's mean vector."""
    centre = mean_vectors(df.select(cluster, vector), [cluster], vector).withColumnRenamed(vector, "_centre")
    f = cosine_distance if metric == "cosine" else euclidean_distance
    return df.join(centre, cluster).withColumn("distance", f(F.col(vector), F.col("_centre"))).drop("_centre")


def _before(bound: str, id_col: str) -> Column:
    """Whether a row comes before the pair ``bound`` in the order of distance (to 9 digits) and id; a null bound is the end."""
    return F.coalesce(F.struct(F.round("distance", 9).alias("value"), F.col(id_col).alias("id")) < F.col(bound), F.lit(True))


def _with_bounds(df: DataFrame, ranks: dict[str, Column], cluster: str, id_col: str) -> DataFrame:
    """``df`` with ``_n`` and the pairs of distance and id at its cluster's ranks; no cluster is put in order as a whole."""
    keyed = df.select(cluster, F.round("distance", 9).alias("_d"), id_col)
    return df.join(looked_up(rows_at(keyed, cluster, "_d", id_col, ranks)), cluster)


def regions(df: DataFrame, k: int = 10, far: int | None = None, middle: bool = True, cluster: str = "cluster", id_col: str = "doc_id") -> DataFrame:
    """The ``k`` closest, ``k`` middle and ``far`` farthest rows of each cluster, with region and place (WIN1, WIN2).

    The middle starts at max(0, n // 2 - k // 2); the farthest come farthest first; regions may overlap. The places that
    bound the regions are looked up first, so that only the regions' rows are put in order.
    """
    far = k if far is None else far
    n = F.col("_n")
    start = F.greatest(F.lit(0), F.floor(n / 2) - k // 2)
    p = _with_bounds(df, {"_close": F.lit(k), "_from": start, "_to": start + k, "_end": F.greatest(F.lit(0), n - far)}, cluster, id_col)
    before = lambda bound: _before(bound, id_col)
    names = [F.when(before("_close"), "closest"), F.when(~before("_from") & before("_to"), "middle") if middle else F.lit(None).cast("string"), F.when(~before("_end") & (F.lit(far) > 0), "farthest")]
    p = p.withColumn("region", F.explode(F.filter(F.array(*names), lambda x: x.isNotNull())))
    w = Window.partitionBy(cluster, "region")  # at most k or far rows
    near, away = (F.row_number().over(w.orderBy(*o)) - 1 for o in ((F.round("distance", 9), F.col(id_col)), (F.desc_nulls_last(F.round("distance", 9)), F.desc_nulls_last(id_col))))
    return p.withColumn("place", F.when(F.col("region") == "farthest", away).otherwise(near).cast("long")).select(*df.columns, "region", "place")


def head_middle_tail(df: DataFrame, k: int = 4, cluster: str = "cluster", id_col: str = "doc_id") -> DataFrame:
    """Four from the start, middle and end by Euclidean distance; rows may come more than once (WIN3)."""
    out = regions(df, k, cluster=cluster, id_col=id_col)
    names = F.when(F.col("region") == "closest", "center").when(F.col("region") == "middle", "middle").otherwise("edge")
    return out.withColumn("position_category", names)


def quartiles(df: DataFrame, cluster: str = "cluster", id_col: str = "doc_id") -> DataFrame:
    """center (first quarter), mid (half), edge (rest) by place in the order of distance (WIN4)."""
    p = _with_bounds(df, {"_q": F.floor(F.col("_n") / 4), "_h": F.floor(3 * F.col("_n") / 4)}, cluster, id_col)
    region = F.when(_before("_q", id_col), "center").when(_before("_h", id_col), "mid").otherwise("edge")
    return p.withColumn("region", region).select(*[c for c in df.columns if c != "region"], "region")


def seeded_sample(df: DataFrame, strata: list[str], n, seeds: list[int] = (0,), id_col: str = "doc_id", order=None) -> DataFrame:
    """At most ``n`` rows of each stratum and seed, by a hash of seed and id, so that every run agrees (WIN4, WIN5).

    ``n`` is a number or a map from the last stratum's values; ``order(seed, id)`` may replace the hash.
    """
    key = order or (lambda seed, i: F.xxhash64(seed, i))
    if isinstance(n, dict):
        most = F.coalesce(F.create_map(*[F.lit(x) for kv in n.items() for x in kv])[F.col(strata[-1])], F.lit(0))
    else:
        most = F.lit(n)
    s = df.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    w = Window.partitionBy("seed", *strata).orderBy(key(F.col("seed"), F.col(id_col)), id_col)
    return s.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def numbered(df: DataFrame, order: list[str], start: int = 1, name: str = "count") -> DataFrame:
    """Running numbers in an order (WIN7): rows are dealt by range, sorted and written; a row's number is the rows of the
    parts before it, which are counted, and its place in its own. No window over all rows in one task, and nothing that a
    lost executor could deal anew. A column of ``df`` with that name is replaced."""
    spark = df.sparkSession
    at, part, before = ("_" * max(1, 1 + max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0)) + x for x in ("at", "part", "before"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    counts = sorted((r[0], r[1]) for r in rows.groupBy(F.shiftright(at, 33)).agg(F.count("*")).collect())  # one row a part
    total, offsets = start, []
    for p, k in counts:
        offsets.append((p, total))
        total += k
    where = spark.createDataFrame(offsets, f"{part} long, {before} long")
    out = rows.withColumn(part, F.shiftright(at, 33)).join(F.broadcast(where), part)
    return out.withColumn(name, F.col(before) + F.col(at).bitwiseAND((1 << 33) - 1)).select(*[c for c in df.columns if c != name], name)
