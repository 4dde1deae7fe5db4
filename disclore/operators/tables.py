"""Tables between the steps of iterative operators: written to the shared folder, so that lineage stays short."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; only a local session may do without that setting."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "/tmp/checkpoints/disclore"
    return at.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, whatever executors are lost later."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/steps/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._step_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_step_path", None)
        if path:
            spark = df.sparkSession
            hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of ``links`` (a, b), the least node it can reach. Null ends are ignored.

    In each round a node takes the least root among its neighbours', and its root's root; rounds grow with the logarithm
    of the longest path.
    """
    pairs = links.select("a", "b").where("a is not null and b is not null")
    edges = written(pairs.union(pairs.select("b", "a")).distinct(), "links")
    roots = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "roots")
    while True:
        seen = edges.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        hooked = written(roots.join(seen, "node").select("node", F.least("root", "m").alias("root"), F.col("root").alias("old")), "hooked")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = written(hooked.join(up, "root").select("node", F.col("top").alias("root"), "old"), "roots")
        changed = jumped.where("root <> old").take(1)
        dropped(roots, hooked)
        roots = jumped
        if not changed:
            dropped(edges)
            return roots.select("node", "root")


#: Rows of a group in one part of ``products``, pairs of parts in a task, about, and rows of the right part that come in turn.
PART, TILES, RUN = 2048, 16, 256


def _parts(df: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(key, ``name``_part, ``name``) with an array of the other columns of ``df`` for each part of some PART rows; and the number
    of parts of each key. A row's part is a hash of where it lies, so equal rows are dealt too."""
    rows = written(df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name), F.monotonically_increasing_id().alias("_at")), "rows")
    sizes = written(rows.groupBy(key).agg(F.ceil(F.count("*") / PART).alias(f"{name}_parts")), "parts")
    dealt = rows.join(sizes, key).select(key, name, F.pmod(F.xxhash64("_at"), f"{name}_parts").alias(f"{name}_part"))
    return dealt.groupBy(key, f"{name}_part").agg(F.collect_list(name).alias(name)), sizes


def products(a: DataFrame, b: DataFrame, links: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """(<columns of ``links``>, _a, _b): for each row (key_a, key_b, ..) of ``links`` all pairs of a row of ``a`` and one of ``b``
    with these keys; _a and _b hold their other columns.

    Groups are dealt to parts and a pair of parts lies in one task, so that a large group is many tasks; what is shuffled is
    an array for each pair of parts, and never a pair of rows. A task makes the pairs of a pair of parts one after the other,
    RUN rows of b in the same order for each row of a: a multiple of eight, so that the packed numbers of a columnar file
    repeat byte by byte and compress well.
    """
    (a, parts_a), (b, parts_b) = _parts(a, key_a, "_a"), _parts(b, key_b, "_b")
    links = written(links.join(parts_a, key_a).join(parts_b, key_b), "met")
    tiles = links.agg(F.sum(F.col("_a_parts") * F.col("_b_parts"))).first()[0] or 0
    n = max(1, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), tiles // TILES)
    by = [key_a, key_b, "_a_part", "_b_part"]
    keep = [c for c in links.columns if c not in ("_a_parts", "_b_parts")]
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    left = a.join(links, key_a).select(*keep, "_a", "_a_part", every("_b_parts").alias("_b_part")).repartition(n, *by)
    right = b.join(links.select(key_a, key_b, "_a_parts"), key_b).select(key_a, key_b, "_b", "_b_part", every("_a_parts").alias("_a_part")).repartition(n, *by)
    runs = F.transform(F.sequence(F.lit(0), F.size("_b") - 1, F.lit(RUN)), lambda i: F.slice("_b", i + 1, RUN))
    met = left.join(right.hint("shuffle_hash"), by).select(*keep, "_a", F.explode(runs).alias("_b"))
    return met.select(*keep, F.explode("_a").alias("_a"), "_b").select(*keep, "_a", F.explode("_b").alias("_b"))


def small_batches(df: DataFrame, rows: int = 256, size: int = 8 << 20) -> DataFrame:
    """``df``, after bounding its session's Arrow batches by rows and bytes, for functions in Python of long texts: a worker
    holds several forms of a batch. Smaller settings stay."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = "".join(c for c in conf.get(f"spark.sql.execution.arrow.{key}") if c.isdigit() or c == "-") or "-1"
        if not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return df
