"""From documents to packed token sequences, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's documents. All but the last keep the documents' columns.
The classifiers learn from labelled documents of the whole table, never from their own results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disclore.llm import minhash, packing, quality, secrets, toxicity
from disclore.llm.common import discard, free_names, table, written

#: No stage can be told in SQL: trained models and a tokenizer decide. tests/llm compares run() with a plain version.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the random field takes for good ones; null, empty and blank texts score 0 and go. Repeated
    rows and null ids are judged by their text like all others."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    judged = quality.scores(docs, model, keep=docs.columns)
    return judged.where(F.col(judged.columns[-1]) == 1).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance does not take for toxic; null and empty texts are judged by the score of
    a text without windows. Repeated rows and null ids are judged by their text like all others."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    judged = toxicity.scores(docs, model, keep=docs.columns)
    return judged.where(F.col(judged.columns[-1]) == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, similarity 0.8): that of the least doc_id, then the least
    hash of the text.

    Rows count, not ids: of an id's rows those that are no near copies stay, and of a row that is repeated one
    stays. A null doc_id comes last. Texts without words (null ones too) are in no group and stay. An empty table
    stays empty; other columns are carried along, whatever their names.
    """
    row, key = free_names(["row", "key"], docs.columns)
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = minhash.near_duplicates(rows, id_col=row).select(F.col("doc_id").alias(row), F.col("component_id").alias(key))
    slim = rows.select(row, F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("h"), F.col(row).alias("row")).alias("order"))
    placed = written(groups.join(slim, row), "placed")  # ids and hashes alone
    # a group is named by its least row; only where another one is first the group has to be looked up
    moved = written(placed.groupBy(key).agg(F.min("order")["row"].alias("first")).where(F.col(key) != F.col("first")), "moved")
    moved = F.broadcast(moved) if moved.count() <= minhash.BROADCAST_IDS else moved
    gone = written(placed.join(moved, key, "left").where(F.col(row) != F.coalesce("first", key)).select(row), "gone")
    discard(placed)
    few = gone.count() <= minhash.BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone, row, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; null texts stay null, repeated rows stay."""
    words = secrets.whole_words(public_tokenizers.path("word_bpe_49k.json"))
    return secrets.redacted_documents(docs, secrets.train(dictionary=words))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; null and empty texts are their end token alone, repeated
    rows and null ids are packed as rows of their own. Executors hold what the stages before left behind, so the encoder
    makes do with small caches."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache_share=1 / 8)


STAGES = [("quality", keep_good), ("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("secrets", redact_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
