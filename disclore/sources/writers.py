"""Writers: tables by key, reports, chunks, sheets, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sheet_name
from ..operators.sampling import numbered
from ..operators.tables import dropped, written
from .readers import latest


def raw_json(df: DataFrame, path: str, date_col: str = "date") -> None:
    """One folder a date, replaced when the date is written again (SNK1)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_col).json(path)


def upserted(table: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The table after full-row puts: the last of each key wins, new rows over old (SNK3)."""
    old = table.select("*", F.lit(0).alias("_new"), F.lit(None).cast(rows.schema[order].dataType).alias("_at"))
    new = rows.select(*table.columns, F.lit(1).alias("_new"), F.col(order).alias("_at"))
    return latest(old.unionByName(new), key, ["_new", "_at"]).select(*table.columns)


def updated(table: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The table after setting the non-null fields of ``changes``, one row a key (SNK4)."""
    c = changes.select(*key, *[F.col(x).alias(f"_new_{x}") for x in columns])
    out = table.join(c, key, "left").withColumns({x: F.coalesce(f"_new_{x}", x) if x in table.columns else F.col(f"_new_{x}") for x in columns})
    return out.drop(*[f"_new_{x}" for x in columns])


BUCKETS = 64


def bucketed(rows: DataFrame, key: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with the ``bucket`` of their key."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def created(rows: DataFrame, path: str, key: list[str], buckets: int = BUCKETS) -> None:
    """A table of keyed rows, a folder a bucket of keys; ``merged_into`` and ``deleted_from`` change it."""
    bucketed(rows, key, buckets).repartition("bucket").write.partitionBy("bucket").parquet(path)


def merged_into(path: str, rows: DataFrame, key: list[str], order: str, buckets: int = BUCKETS) -> list[int]:
    """Upsert ``rows`` (the last by ``order`` of each key) into a table made by ``created``: only the buckets that hold one of
    their keys are read and written again, by dynamic partition overwrite. Returns those buckets, at most ``buckets``.

    The same rows merged again change nothing, so a batch that failed half-way or is replayed ends in the same table.
    """
    spark = rows.sparkSession
    new = written(bucketed(rows, key, buckets), "new")
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
    if touched:
        old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
        _rewritten(upserted(old, new, key, order), path)
    dropped(new)
    return touched


def _rewritten(rows: DataFrame, path: str) -> None:
    """Replace the buckets of ``rows``; they are written elsewhere first, as they are read from the table."""
    staged = written(rows, "merged")
    staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    dropped(staged)


def deleted_from(spark: SparkSession, path: str, where: Column) -> list[int]:
    """Delete the rows that match: only buckets that hold one are written again. Returns those buckets."""
    table = spark.read.parquet(path)
    touched = sorted(r["bucket"] for r in table.where(where).select("bucket").distinct().collect())
    if touched:
        left = written(purged(table.where(F.col("bucket").isin(touched)), where), "left")
        alive = {r["bucket"] for r in left.select("bucket").distinct().collect()}
        _rewritten(left, path)
        for b in set(touched) - alive:  # an overwrite leaves a folder alone that gets no rows
            gone = table.where("false")
            gone._step_path = f"{path}/bucket={b}"
            dropped(gone)
        dropped(left)
    return touched


def backfilled(table: DataFrame, column: str, value: Column, key: list[str]) -> DataFrame:
    """A constant for every row whose key is complete (SNK5)."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    return table.withColumn(column, F.when(whole, value).otherwise(F.col(column) if column in table.columns else F.lit(None)))


def purged(table: DataFrame, where: Column) -> DataFrame:
    """The table without the rows that match; a null condition keeps the row (SNK6)."""
    return table.where(~F.coalesce(where, F.lit(False)))


def csv(df: DataFrame, path: str) -> None:
    """CSV with header; arrays, maps and structs as JSON (SNK7)."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", "true").csv(path)


def vectors(df: DataFrame, path: str, partition: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def chunks(df: DataFrame, path: str, *partition: str) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).json(path)


def json_reports(df: DataFrame, path: str, key: str) -> None:
    """JSON rows in a folder a key, lower-cased, blanks to _ (SNK10)."""
    df.withColumn("report", F.lower(F.regexp_replace(F.col(key).cast("string"), " ", "_"))).write.mode("overwrite").partitionBy("report").json(path)


def workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """A folder a sheet, names made safe and cut to 31 signs (SNK11, SNK12)."""
    spark = next(iter(sheets.values())).sparkSession
    names = [r[0] for r in spark.createDataFrame([(n,) for n in sheets], "n string").select(sheet_name(F.col("n"))).collect()]
    for name, df in zip(names, sheets.values()):
        csv(df, f"{path}/{name}")


def markdown_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """(n, line): the whole table as lines of Markdown, header first, rows in ``order``; bars are escaped, line ends blanks."""
    cells = [F.translate(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "\n", " ") for c in df.columns]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = numbered(df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(order)], row.alias("line")), [f"_{i}" for i in range(len(order))], 2, "n")
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "| " + " | ".join(["---"] * len(df.columns)) + " |")], "n long, line string")
    return head.union(rows.select("n", "line"))


def markdown(df: DataFrame, path: str, order: list[str]) -> None:
    """A table as a folder of Markdown text, whose files follow each other in the order of their names (SNK13, SNK14)."""
    markdown_lines(df, order).orderBy("n").select("line").write.mode("overwrite").text(path)


def excerpt_text(excerpts: Column, cluster: Column) -> Column:
    """Cluster id and excerpts as an indented block list (SNK16)."""
    block = F.transform(excerpts, lambda e: F.concat(F.lit("  - |\n"), F.array_join(F.transform(F.split(e, "\r\n|\r|\n"), lambda x: F.concat(F.lit("    "), x)), "\n"), F.lit("\n")))
    return F.concat(F.rtrim(F.regexp_replace(F.concat(F.lit("cluster_id: "), cluster.cast("string"), F.lit("\nexcerpts:\n"), F.array_join(block, "\n")), r"\s+$", "")), F.lit("\n"))


def log_rows(df: DataFrame, started: Column, ended: Column, file_id: Column, input_key: Column, output_key: Column, error: Column) -> DataFrame:
    """Rows of the processing log (SNK19)."""
    took = F.floor((ended.cast("timestamp").cast("double") - started.cast("timestamp").cast("double")) * 1000).cast("long")
    return df.select(file_id.alias("file_id"), F.date_format(ended, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("processed_at"), input_key.alias("input_key"), output_key.alias("output_key"), F.when(error.isNull(), "SUCCESS").otherwise("FAILED").alias("status"), took.alias("duration_ms"), error.alias("error_message"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def not_processed(df: DataFrame, processed: DataFrame, *key: str) -> DataFrame:
    """Rows whose key has no result yet (SNK20, JOIN9, CTL6)."""
    return df.join(processed.select(*key).distinct(), list(key), "left_anti")
