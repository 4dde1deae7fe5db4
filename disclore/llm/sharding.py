"""Hilbert-curve sharding: quantised metadata dimensions, sorted by curve index, cut into runs.

Rows with near values in all dimensions lie near each other on the curve, so each run covers a small box of
the metadata space, and a reader that filters on any of the dimensions skips most files by their bounds
(``write_shards`` writes the runs and a manifest of those bounds).

Equal texts take the least language and source of their group for the curve and so lie side by side. Ranks
are global without a global sort in one task: rows are dealt by range, sorted within their partition and
numbered there; only the partitions' counts go to the driver. The range key ends with a row number, so that
no cell, group or repeated row can overload a partition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_names, written

BITS = 6


def hilbert_index(coordinates: list[np.ndarray], bits: int) -> np.ndarray:
    """The position on the Hilbert curve of cells given by integer coordinates of ``bits`` bits."""
    x = [np.asarray(c, np.int64).copy() for c in coordinates]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo the rotations of the coarser levels
        low = q - 1
        for i in range(n):
            turn = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] ^= np.where(turn, low, swap)
            if i:
                x[i] ^= np.where(turn, 0, swap)
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | ((x[i] ^ flip) >> bit & 1)
    return index


def curve(*cells: Column, bits: int = BITS) -> Column:
    """Hilbert index of integer columns in [0, 2**bits)."""

    @F.pandas_udf("long")
    def index(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index([frame[c].to_numpy() for c in frame], bits))

    return index(F.struct(*[c.cast("long").alias(f"d{i}") for i, c in enumerate(cells)]))


def category_cell(c: Column, bits: int = BITS) -> Column:
    """A cell for a name: equal names share it; null counts as ''."""
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(1 << bits))


def size_cell(c: Column, bits: int = BITS) -> Column:
    """A cell for a size: half powers of two."""
    return F.least(F.lit((1 << bits) - 1), F.floor(2 * F.log2(F.greatest(c, F.lit(1)).cast("double"))))


def ranked(df: DataFrame, keys: list[str], position: str = "position", total: str = "total") -> DataFrame:
    """``df`` with ``position`` (0, 1, ... in the order of ``keys``, which must end in a unique one) and ``total``, under names
    that ``df`` does not have."""
    spark = df.sparkSession
    at, part, before = free_names(["at", "part", "before"], [*df.columns, position, total])
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(df.repartitionByRange(n, *[F.col(f"`{k}`") for k in keys]).sortWithinPartitions(*[F.col(f"`{k}`") for k in keys]).withColumn(at, F.monotonically_increasing_id()), "ranked")
    counts = sorted((r[0], r[1]) for r in dealt.groupBy(F.shiftright(at, 33)).agg(F.count("*")).collect())  # one row a partition
    rows, offsets = 0, []
    for p, k in counts:
        offsets.append((p, rows))
        rows += k
    where = spark.createDataFrame(offsets, f"{part} long, {before} long")
    out = dealt.withColumn(part, F.shiftright(at, 33)).join(F.broadcast(where), part)
    out = out.withColumn(position, F.col(before) + F.col(at).bitwiseAND((1 << 33) - 1)).withColumn(total, F.lit(rows).cast("long")).drop(at, part, before)
    out._ranked = dealt
    return out


def shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve_index.

    The law is ``rows``: shards are runs of the curve whose counts differ by one at most. Size is the text's
    bytes in UTF-8 plus 16; a null text has none (size 16, checksum 0, as an empty one). Null language and
    source count as ''; null ids and repeated rows keep rows of their own. With fewer rows than shards, some
    shards are empty. Other columns are not read.
    """
    raw = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    slim = docs.select(docs[id_col].alias("doc_id"), (F.length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("h"), docs[lang_col].cast("string").alias("lang"), docs[source_col].cast("string").alias("source"))
    slim = written(slim.withColumn("row", F.monotonically_increasing_id()), "slim")
    group = ["h", "text_crc32", "size"]
    groups = slim.groupBy(*group).agg(F.min(F.coalesce("lang", F.lit(""))).alias("lang"), F.min(F.coalesce("source", F.lit(""))).alias("source"))
    groups = written(groups.select(*group, curve(size_cell(F.col("size")), category_cell(F.col("lang")), category_cell(F.col("source"))).alias("curve_index")), "groups")
    placed = slim.select("doc_id", *group, "row").join(groups, group)
    out = ranked(placed, ["curve_index", *group, "doc_id", "row"])
    s, n = F.lit(n_shards).cast("long"), F.col("total")
    out = out.withColumn("shard", F.expr(f"(position * {n_shards}) div total"))
    first = F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("position") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve_index")


def write_shards(df: DataFrame, path: str, dimensions: list[str], n_files: int, bits: int = BITS) -> DataFrame:
    """Write ``df`` as ``n_files`` runs of the curve over numeric or string ``dimensions``; return the manifest.

    Numbers are cut at quantiles into 2**bits cells, strings by a hash; null numbers come first. The files have all columns
    of ``df``; the folders, and the manifest's first column, are named ``run``, with a _ before where ``df`` has that name.
    The manifest has, for each run, its rows (``n_rows``) and each dimension's least and greatest value (``min_<name>``,
    ``max_<name>``). Repeated rows stay, rows of one cell may be dealt to neighbouring runs; an empty table gives an empty
    folder and an empty manifest.
    """
    curve_at, row, position, total, run = free_names(["curve", "row", "position", "total", "run"], df.columns)
    numeric = {c for c, t in df.dtypes if t in ("int", "bigint", "smallint", "tinyint", "double", "float", "date", "timestamp") or t.startswith("decimal")}
    cells = []
    for d in dimensions:
        of = F.col(f"`{d}`")
        if d in numeric:
            value = (F.unix_date(of) if dict(df.dtypes)[d] == "date" else of).cast("double")
            cuts = df.select(F.percentile_approx(value, [i / (1 << bits) for i in range(1, 1 << bits)]).alias("q")).first()["q"] or []
            cells.append(F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<double>"), lambda q, v=value: q < F.coalesce(v, F.lit(float("-inf"))))))
        else:
            cells.append(category_cell(of, bits))
    keyed = df.withColumn(curve_at, curve(*cells, bits=bits)).withColumn(row, F.monotonically_increasing_id())
    placed = ranked(keyed, [curve_at, row], position, total)
    out = placed.withColumn(run, F.expr(f"(`{position}` * {n_files}) div `{total}`").cast("int")).select(*[F.col(f"`{c}`") for c in df.columns], run)
    out.repartitionByRange(n_files, run).write.partitionBy(run).parquet(path)
    discard(placed._ranked)
    bounds = [f(F.col(f"`{d}`")).alias(f"{name}_{d}") for d in dimensions for name, f in (("min", F.min), ("max", F.max))]
    return df.sparkSession.read.schema(out.schema).parquet(path).groupBy(run).agg(F.count("*").alias("n_rows"), *bounds)
