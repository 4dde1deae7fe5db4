"""What the operators of this subpackage share: the shared folder, written tables, table reading."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only a local session gets one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "/tmp/checkpoints/disclore"
    return at.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._disclore_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    path = getattr(df, "_disclore_path", None)
    if path:
        spark = df.sparkSession
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def free_names(names: list[str], taken: list[str]) -> list[str]:
    """``names``, each with as many _ before it as it takes to clash with none of ``taken``."""
    out = []
    for n in names:
        while n in taken:
            n = "_" + n
        out.append(n)
    return out


def small_batches(df: DataFrame, rows: int = 512, size: int = 32 << 20) -> DataFrame:
    """``df``, after bounding its session's Arrow batches by rows and bytes: texts are long, and every task keeps some
    batches on both sides of its Python worker. Spark reads these settings when a query runs, so they stay for later
    queries of the session; a setting that is smaller already is left as it is."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = "".join(c for c in conf.get(f"spark.sql.execution.arrow.{key}") if c.isdigit() or c == "-") or "-1"
        if not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return df


_caches: dict[str, list] = {}


def sole_cache(owner: str, *caches) -> None:
    """On an executor: ``owner`` is at work in this Python worker, so what other operators have cached in it goes."""
    _caches[owner] = list(caches)
    for other in [o for o in _caches if o != owner]:
        for c in _caches.pop(other):
            c.clear()
