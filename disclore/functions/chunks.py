"""Chunkers: text to an array of chunks, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import held, strip


def char_chunks(t: Column, size: int = 1500, stride: int = 300) -> Column:
    """Windows of ``size`` characters every ``size - stride``; short tails are chunks too; '' has none (STR14)."""
    starts = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(size - stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(t, i + 1, F.lit(size)))


def paragraph_chunks(t: Column, most: int = 4000) -> Column:
    """Lines packed while chunk and line stay below ``most`` characters; a first long line leaves an empty chunk before it (STR15)."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(acc: Column, line: Column) -> Column:
        fits = F.length(acc["now"]) + F.length(line) < most
        return F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], strip(acc["now"]))).alias("done"), F.concat(F.when(fits, acc["now"]).otherwise(F.lit("")), line, F.lit("\n")).alias("now"))

    return F.aggregate(F.split(t, "\n"), start, add, lambda a: F.when(a["now"] != "", F.array_append(a["done"], strip(a["now"]))).otherwise(a["done"]))


def token_chunks(t: Column, most: int, whole_up_to: int = 0) -> Column:
    """Runs of ``most`` blank-separated tokens; one chunk while there are ``whole_up_to`` at most (STR16)."""
    tokens = F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")


    def chunked(tokens: Column) -> Column:
        n = F.size(tokens)
        runs = F.transform(F.sequence(F.lit(0), n - 1, F.lit(most)), lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(most)), " "))
        return F.when(n == 0, F.array().cast("array<string>")).when(n <= whole_up_to, F.array(F.array_join(tokens, " "))).otherwise(runs)

    return held(tokens, chunked)


def semantic_chunks(df: DataFrame, *keys: str, text: str = "text", percentile: float = 0.95, likeness=None) -> DataFrame:
    """keys, chunk_id, text: sentences joined until neighbours differ more than all but the given share of neighbours do (STR17).

    ``likeness(a, b)`` is the similarity of two sentences, given as columns of text (of any embedder); by default the cosine
    of their word sets. Neighbours are compared within their row, so a document's sentences are held once; repeated keys
    keep rows of their own. Each step is a column of its own, so that no step is computed again for every sentence.
    """
    def cosine(x: Column, y: Column) -> Column:
        return F.size(F.array_intersect(x, y)) / F.sqrt(F.size(x) * F.size(y))

    d = df.select(*keys, F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), strip), lambda x: x != "").alias("_s"))
    d = d.select(*keys, "_s", (F.col("_s") if likeness else F.transform("_s", lambda x: F.array_distinct(F.split(F.lower(x), r"(?U)\W+")))).alias("_w"))
    like = likeness or cosine
    d = d.select(*keys, "_s", F.transform("_w", lambda x, i: F.when(i > 0, 1 - like(F.get("_w", i - 1), x))).alias("_g"))
    d = d.select(*keys, F.arrays_zip("_s", "_g").alias("_p"), F.array_sort(F.filter("_g", lambda g: g.isNotNull())).alias("_gs"))
    d = d.select(*keys, "_p", F.get("_gs", F.floor(percentile * (F.size("_gs") - 1)).cast("int")).alias("_cut"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(acc: Column, x: Column) -> Column:
        broken = F.coalesce(x["_g"] > F.col("_cut"), F.lit(False))
        now = F.when(acc["now"] == "", x["_s"]).otherwise(F.concat(acc["now"], F.lit(" "), x["_s"]))
        return F.struct(F.when(broken, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"), F.when(broken, x["_s"]).otherwise(now).alias("now"))

    folded = F.aggregate("_p", start, add, lambda a: F.when(a["now"] != "", F.array_append(a["done"], a["now"])).otherwise(a["done"]))
    return d.select(*keys, F.posexplode(folded).alias("chunk_id", "text"))


def exploded(df: DataFrame, chunks: Column, *keys: str) -> DataFrame:
    """keys, chunk_id (from 0), text (WIN8)."""
    return df.select(*keys, F.posexplode(chunks).alias("chunk_id", "text"))
