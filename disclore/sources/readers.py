"""Readers: reports, chunks, vectors, clusterings, taxonomies, prompts, texts, tables with a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import decoded, key_base


def objects(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (), content: bool = False) -> DataFrame:
    """Object listing under a prefix by suffix, whatever its case (SRC3): path, length, modificationTime (and content)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if suffixes:
        df = df.where(F.lower("path").rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    return df if content else df.drop("content")


def html_documents(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """key, name, html: HTML objects decoded from bytes (SRC16)."""
    df = objects(spark, path, (".html", ".htm"), content=True)
    return df.select(F.col("path").alias("key"), key_base(F.regexp_replace("path", "^.*/", ""), prefix).alias("name"), decoded(F.col("content")).alias("html"))


def daily_reports(spark: SparkSession, path: str) -> DataFrame:
    """Records of daily report files (SRC4): a missing list gives none, an unreadable file is passed over."""
    df = spark.read.schema(schemas.DAILY).option("multiLine", "true").option("recursiveFileLookup", "true").option("mode", "PERMISSIVE").json(path)
    return df.select(F.explode("mayaReports.result").alias("r")).select("r.*")


def json_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array or object as rows; a byte-order mark is skipped (SRC5)."""
    reader = spark.read.option("multiLine", "true")  # a named encoding would keep the mark, and lose the file
    return (reader.schema(schema) if schema else reader).json(path)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, chunk_id, text and file, to be ordered by (file, chunk_id) (SRC6)."""
    return spark.read.schema(schemas.CHUNK).option("recursiveFileLookup", "true").json(path).withColumn("file", F.col("_metadata.file_path"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (string) and vector (doubles) of a Parquet file; in the wide layout all other columns are dimensions (SRC7, SRC8)."""
    return as_vectors(spark.read.parquet(path))


def as_vectors(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    schemas.require_columns(df, id_col)
    dims = [c for c in df.columns if c != id_col]
    vector = F.col("vector").cast("array<double>") if "vector" in dims else F.array(*[F.col(f"`{c}`").cast("double") for c in dims])
    return df.select(F.col(id_col).cast("string").alias("doc_id"), vector.alias("vector"))


def clustering(df: DataFrame) -> DataFrame:
    """doc_id and label of a clustering: doc_id or reportId; meta_cluster or cluster (SRC9)."""
    label = schemas.first_of(df, "meta_cluster", "cluster") if {"meta_cluster", "cluster"} & set(df.columns) else F.col(schemas.first_prefixed(df, "cluster"))
    return df.select(schemas.first_of(df, "doc_id", "reportId").cast("string").alias("doc_id"), label.cast("int").alias("label"))


def clustering_csv(spark: SparkSession, path: str) -> DataFrame:
    return clustering(spark.read.option("header", "true").csv(path))


def sheet(spark: SparkSession, workbook: str, name: str) -> DataFrame | None:
    """A sheet of a workbook kept as a folder of CSV folders; None when it is not there (SRC10)."""
    path = f"{workbook}/{name}"
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath):
        return None
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def scan(df: DataFrame, where: Column | None = None, columns: list[str] | None = None, alias: dict[str, str] | None = None) -> DataFrame:
    """Key-table scan with predicate and projection, which reach the file scan (SRC11)."""
    df = df if where is None else df.where(where)
    df = df if columns is None else df.select(*columns)
    return df.withColumnsRenamed(alias or {})


def lookup_first(df: DataFrame, table: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Index look-up that takes the first match in ``order``; rows without a match keep nulls (SRC12).

    Each key's first row is found by an aggregate that combines map-side, so a frequent key costs little.
    """
    rest = [c for c in table.columns if c != key]
    first = table.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f")).select(key, "_f.*")
    return df.join(first, key, "left")


def by_key(df: DataFrame, table: DataFrame, *key: str) -> DataFrame:
    """Primary-key get: a left join on the key (SRC13)."""
    return df.join(table, list(key), "left")


def texts(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """doc_id and text of files <doc_id>.txt, .html or .htm, in this order of preference (SRC20)."""
    df = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).withColumn("_p", F.col("_metadata.file_path"))
    named = df.select(F.regexp_extract("_p", r"([^/]*)\.(txt|html|htm)$", 1).alias("doc_id"), F.regexp_extract("_p", r"\.(txt|html|htm)$", 1).alias("e"), F.col("value").alias("text")).where("doc_id <> ''")
    rank = F.when(F.col("e") == "txt", 0).when(F.col("e") == "html", 1).otherwise(2)
    return named.groupBy("doc_id").agg(F.min_by(F.substring("text", 1, most) if most else F.col("text"), rank).alias("text"))


def prompts(df: DataFrame) -> DataFrame:
    """handle and prompt_text of a prompt repository; records without either are passed over (SRC23)."""
    p = df.select(F.posexplode("prompts").alias("pos", "p"))
    names = {f.name for f in p.schema["p"].dataType}
    pick = lambda *c: F.coalesce(*[F.col(f"p.{x}") for x in c if x in names], F.lit(None))
    p = p.select("pos", pick("handle", "category_handle", "name").alias("handle"), pick("prompt_text", "text", "prompt").alias("prompt_text"))
    return p.where("coalesce(handle, '') <> '' and coalesce(prompt_text, '') <> ''").groupBy("handle").agg(F.max_by("prompt_text", "pos").alias("prompt_text"))


def split_system_prompt(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(task prompts, the system prompt)."""
    return p.where("handle <> 'system_prompt'"), p.where("handle = 'system_prompt'")


def summary_files(spark: SparkSession, path: str, model: str) -> DataFrame:
    """handle and path of result files <model>/<handle>.json (SRC24)."""
    df = objects(spark, f"{path}/{model}", (".json",))
    return df.select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("handle"), "path")


_MEMBERS = "map<string,struct<document_ids:array<string>,doc_ids:array<string>>>"


def taxonomy(text: DataFrame, column: str = "value", ignore: tuple[str, ...] = ()) -> DataFrame:
    """cluster_id and doc_id from three JSON encodings (SRC25): two sections, a flat list, a map.

    A document in several sections belongs to the later one (SET4).
    """
    j = text.select(F.from_json(column, f"final_categories {_MEMBERS}, provisional_candidate_groups {_MEMBERS}").alias("two"), F.from_json(column, "array<struct<cluster_id:string,document_ids:array<string>>>").alias("flat"), F.from_json(column, _MEMBERS).alias("map"))
    ids = lambda c: F.coalesce(c["document_ids"], c["doc_ids"])
    sectioned = F.col("two.final_categories").isNotNull() | F.col("two.provisional_candidate_groups").isNotNull()
    parts = []
    for rank, section in enumerate(("final_categories", "provisional_candidate_groups")):
        parts.append(j.where(sectioned).select(F.lit(rank).alias("rank"), F.explode(f"two.{section}").alias("cluster_id", "m")).select("rank", "cluster_id", F.explode(ids(F.col("m"))).alias("doc_id")))
    parts.append(j.where(F.size("flat") > 0).select(F.lit(0).alias("rank"), F.explode("flat").alias("m")).where("m.cluster_id is not null").select("rank", F.col("m.cluster_id").alias("cluster_id"), F.explode("m.document_ids").alias("doc_id")))
    parts.append(j.where(~sectioned & F.col("map").isNotNull()).select(F.lit(0).alias("rank"), F.explode("map").alias("cluster_id", "m")).select("rank", "cluster_id", F.explode(ids(F.col("m"))).alias("doc_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.where(~F.col("cluster_id").isin(*ignore)) if ignore else out
    return out.groupBy("doc_id").agg(F.max_by("cluster_id", F.struct("rank", "cluster_id")).alias("cluster_id")).select("cluster_id", "doc_id")


def described(df: DataFrame) -> dict:
    """Schema and row count of a table (SRC14, SRC15)."""
    return {"columns": dict(df.dtypes), "rows": df.count()}


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key, the last in ``order``, by a map-side combining aggregate."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*").select(*df.columns)


