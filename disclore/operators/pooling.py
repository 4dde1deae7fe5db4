"""Chunk vectors to document vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import held

#: Parts of a document's words in ``tfidf_weights``, and documents up to which their sizes are broadcast.
BUCKETS, BROADCAST_ROWS = 32, 100_000


def mean_vectors(df: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Element-wise mean (AGG4): one buffer a group and task, so a large group costs no memory. Rows with a null vector, or
    components that are null, are left out."""
    v = F.col(vector).cast("array<double>")
    rows = df.where(F.col(vector).isNotNull()).where(~F.exists(v, lambda x: x.isNull()))
    return rows.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector(v))).alias(vector))


def medoid_vectors(df: DataFrame, key: str = "doc_id", order: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """The vector with the least sum of Euclidean distances to its document's others, the first of equals (AGG5)."""
    from .ranks import medoids

    return medoids(df, key, order, vector)[0]


def tfidf_weights(chunks: DataFrame, key: str = "doc_id", order: str = "chunk_id", text: str = "text") -> DataFrame:
    """Weight of each chunk of a document: its row sum of unit-length tf-idf, over the document's chunks (AGG6).

    Words of two and more word characters, lower case; idf = ln((1 + n) / (1 + df)) + 1 within the document.
    """
    # A document's words are dealt to BUCKETS parts: all sums over words are within a part, and what is shuffled after that
    # is a row for each chunk and part.
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    words = chunks.select(key, order, F.explode(F.array_sort(found)).alias("w"))
    n_parts = max(1, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = words.withColumn("_b", F.pmod(F.xxhash64("w"), F.lit(BUCKETS))).repartition(n_parts, key, "_b")
    tf = dealt.groupBy(key, "_b", order, "w").agg(F.count("*").alias("tf")).withColumn("df", F.count("*").over(Window.partitionBy(key, "_b", "w")))
    n = chunks.groupBy(key).agg(F.count("*").alias("n"))
    x = tf.join(F.broadcast(n) if n.count() <= BROADCAST_ROWS else n, key).withColumn("x", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    rows = x.groupBy(key, order).agg((F.sum("x") / F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("s"))
    s = chunks.select(key, order).join(rows, [key, order], "left").withColumn("s", F.coalesce("s", F.lit(0.0)) + 1e-9)
    return s.select(key, order, (F.col("s") / F.sum("s").over(Window.partitionBy(key))).alias("weight"))


def tfidf_vectors(vectors: DataFrame, chunks: DataFrame, key: str = "doc_id", order: str = "chunk_id") -> DataFrame:
    w = vectors.join(tfidf_weights(chunks, key, order), [key, order])
    parts = w.select(key, "weight", F.posexplode("vector").alias("_i", "_x")).groupBy(key, "_i").agg(F.sum(F.col("_x").cast("double") * F.col("weight")).alias("_m"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("vector"))


def hashed_embeddings(chunks: DataFrame, dims: int = 64, text: str = "text") -> DataFrame:
    """The default embedder, for want of a model (ML1): hashed word counts of unit length. Any function of
    DataFrame to DataFrame with a ``vector`` column can take its place."""
    words = F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    counts = held(slots, lambda of: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(of, lambda s: s == i)).cast("double")))
    n = F.sqrt(F.aggregate("_c", F.lit(0.0), lambda a, x: a + x * x))
    return chunks.withColumn("_c", counts).withColumn("vector", held(n, lambda n: F.transform("_c", lambda x: x / F.when(n == 0, 1.0).otherwise(n)))).drop("_c")


def embedded(chunks: DataFrame, models: dict, done: DataFrame | None = None) -> DataFrame:
    """Vectors of several embedders; a failing one is left out; rows already done are skipped (ML1, JOIN9)."""
    out = None
    for name, model in models.items():
        todo = chunks if done is None else chunks.join(done.where(F.col("model") == name).select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_anti")
        try:
            part = model(todo).withColumn("model", F.lit(name))
        except (ValueError, RuntimeError, ImportError):
            continue
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no embedder could be used")
    return out
