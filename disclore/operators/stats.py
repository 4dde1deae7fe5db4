"""Grouped statistics and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import object_keys
from ..functions.text import short_number


def report_stats(df: DataFrame, keys: list[str], count_col: Column, size_col: Column) -> DataFrame:
    """Reports, mean count and mean size in KB as short numbers, most reports first (AGG1).

    Missing numbers count as 0; the mean size is rounded to 3 digits in bytes before it becomes KB.
    """
    n = F.count("*")
    kb = F.round(F.round(F.sum(F.coalesce(size_col, F.lit(0))).cast("double") / n, 3) / 1024, 3)
    mean = F.round(F.sum(F.coalesce(count_col, F.lit(0))).cast("double") / n, 3)
    return df.groupBy(*keys).agg(n.alias("total_reports"), short_number(mean).alias("avg_pdf_count"), short_number(kb).alias("avg_pdf_size_kb")).orderBy(F.desc("total_reports"), *keys)


def event_stats(df: DataFrame, keys: list[str], events_json: str, size_col: Column) -> DataFrame:
    """The same for each key of a JSON object (AGG2); bad JSON, arrays and empty objects are passed over."""
    e = df.select(*keys, F.explode(object_keys(F.col(events_json))).alias("event_name"), F.coalesce(size_col, F.lit(0)).alias("_s"))
    n = F.count("*")
    return e.groupBy(*keys, "event_name").agg(n.alias("total_reports"), F.round(F.sum("_s").cast("double") / n / 1024, 3).alias("avg_size_kb")).orderBy(F.desc("total_reports"), *keys, "event_name")


def scan_counts(df: DataFrame, matched: Column) -> DataFrame:
    """Scanned and matched rows in one pass."""
    return df.agg(F.count("*").alias("scanned"), F.count_if(matched).alias("matched"))


def histogram(labels: DataFrame, label: str = "label", noise: int = -1) -> DataFrame:
    """Sizes and shares of labels, largest first (AGG3)."""
    total = labels.agg(F.count("*").alias("_n"))
    g = labels.groupBy(label).agg(F.count("*").alias("n_docs")).join(F.broadcast(total))
    return g.select(label, "n_docs", (100 * F.col("n_docs") / F.col("_n")).alias("pct"), (F.col(label) == noise).alias("is_noise")).orderBy(F.desc("n_docs"), label)


def size_profile(labels: DataFrame, label: str = "label", tiny: int = 3, huge: float = 0.2, noise_counts: bool = True, noise: int = -1) -> DataFrame:
    """Number of clusters, tiny ones (at most ``tiny``) and huge ones (at least a share of all) (AGG9)."""
    total = labels.where(F.col(label).isNotNull()).agg(F.count("*").alias("_n"))
    g = labels.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    g = g if noise_counts else g.where(F.col(label) != noise)
    g = g.join(F.broadcast(total))
    return g.agg(F.count("*").alias("n_clusters"), F.count_if(F.col("n") <= tiny).alias("n_tiny"), F.count_if(F.col("n") >= huge * F.col("_n")).alias("n_huge"))


def with_min_size(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of groups that have at least so many (AGG10)."""
    return df.join(df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key), key, "left_semi")


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values in the order of their first row (AGG11)."""
    return df.groupBy(value).agg(F.min(order).alias("first_at")).orderBy("first_at", value)


def collected(df: DataFrame, key: str, order: list[str], value: list[str], missing: str = "UNKNOWN") -> DataFrame:
    """Ordered rows a key (AGG12); a group has to fit into a row, as in a report file."""
    k = F.coalesce(F.col(key), F.lit(missing))
    return df.groupBy(k.alias(key)).agg(F.array_sort(F.collect_list(F.struct(*order, *value))).alias("rows"))


def effect(df: DataFrame, keys: list[str], a: str = "score_a", b: str = "score_b") -> DataFrame:
    """Win rate, mean difference and Cohen's d (0 below two rows or without spread) (AGG16)."""
    d = F.col(b) - F.col(a)
    sd = F.stddev_samp(d)
    return df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg((d > 0).cast("double")).alias("win_rate"), F.avg(d).alias("mean_delta"), F.coalesce(F.when(sd > 0, F.avg(d) / sd), F.lit(0.0)).alias("cohen_d"))


def next_id(df: DataFrame, column: str, default: int = -1) -> DataFrame:
    return df.agg((F.coalesce(F.max(column), F.lit(default)) + 1).alias("next_id"))


def ranked_runs(runs: DataFrame, n: int = 5, corpus: int | None = None, low: int = 5, high: int = 20) -> DataFrame:
    """Runs with between ``low`` and ``high`` clusters by silhouette (high first), then Davies-Bouldin (SRT1, FLT8)."""
    out = runs.where(F.col("n_clusters").between(low, high))
    if corpus:
        out = out.withColumn("pct_noise", F.col("n_noise") / corpus * 100)
    return out.orderBy(F.desc_nulls_last(F.nanvl("silhouette", F.lit(None).cast("double"))), F.asc_nulls_last(F.nanvl("davies_bouldin", F.lit(None).cast("double"))), "combo").limit(n)


def grid(spark, **values: list) -> DataFrame:
    """All combinations of the given values (SET6): made on the driver, as many as there are runs to do."""
    from itertools import product

    return spark.createDataFrame(list(product(*values.values())), list(values))


def limited_inserts(rows: DataFrame, already: int, cap: int, order: list[str]) -> DataFrame:
    """The first rows that still fit below the cap (SRT5, CTL3)."""
    return rows.orderBy(*order).limit(max(0, cap - already))
