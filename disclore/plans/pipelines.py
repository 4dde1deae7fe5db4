"""The three entry points as compositions of operators: each stage is a table, nothing leaves the session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import char_chunks, exploded, semantic_chunks
from ..functions.classify import classified, routed
from ..functions.html import combined, form_fields, html_text, narrative
from ..functions.text import strip_points, trim_report
from ..operators.clustering import gmm, normalised, reduced
from ..operators.pooling import embedded, hashed_embeddings, mean_vectors
from ..operators.records import by_issuer, enriched, id_above, no_event_above
from ..operators.sampling import quartiles, seeded_sample, with_distance
from ..operators.stats import event_stats, report_stats
from ..schemas import ENRICHMENT
from ..sources.writers import updated, upserted


def chunked(pages: DataFrame, fixed: bool = True, size: int = 1500, stride: int = 300) -> DataFrame:
    """doc_id, html to doc_id, chunk_id, text: trimmed text, table sentences and main content, then chunks."""
    p = pages.withColumn("_f", form_fields("html"))
    text = combined(trim_report(html_text(F.col("html"))), F.col("_f.table_text"), narrative(F.col("html")))
    p = p.select("doc_id", strip_points(text).alias("text")).where("text <> ''")
    return exploded(p, char_chunks(F.col("text"), size, stride), "doc_id") if fixed else semantic_chunks(p, "doc_id")


def clustered_corpus(pages: DataFrame, clusters: int = 20, dims: int = 50, per_region: int = 4, models: dict | None = None) -> dict[str, DataFrame]:
    """Chunk, embed, pool, cluster, sample (entry point 1)."""
    chunks = chunked(pages)
    vectors = embedded(chunks, models or {"hashed": hashed_embeddings})
    docs = mean_vectors(vectors.where(F.col("model") == next(iter(models or {"hashed": None}))), ["doc_id"])
    unit = normalised(docs)
    labels = gmm(reduced(unit, dims), clusters).withColumnRenamed("label", "cluster")
    placed = quartiles(with_distance(unit.join(labels, "doc_id"), metric="euclidean"))
    return {"chunks": chunks, "vectors": docs, "clusters": labels, "samples": seeded_sample(placed, ["cluster", "region"], per_region, [0, 1])}


def ingested(reports: DataFrame, table: DataFrame, html: DataFrame | None = None, order: str = "reportId") -> DataFrame:
    """Daily records into the key table: filters, one row an issuer, upsert, fields of the form (entry point 2)."""
    kept = reports.where(id_above(F.col("mayaReportId"), 0, null_as=0) & no_event_above(F.col("events")))
    rows = by_issuer(kept).withColumn("events", F.to_json("events"))
    rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns])
    out = upserted(table, rows, ["issuerName", "publicationDate"], order)
    if html is not None:
        fields = html.withColumn("_f", form_fields("html")).select("reportId", *[F.col(f"_f.{c}").alias(c) for c in ENRICHMENT])
        out = updated(out, fields.dropDuplicates(["reportId"]), ["reportId"], list(ENRICHMENT))
    return out


def statistics(table: DataFrame) -> dict[str, DataFrame]:
    return {
        "by_form": report_stats(table, ["form_type", "language"], F.col("pdf_count"), F.col("pdf_total_size")),
        "by_event": event_stats(table, ["form_type"], "events", F.col("pdf_total_size")),
    }


def sorted_into_categories(samples: DataFrame, metadata: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sampled documents with metadata and text, classified and routed (entry point 3, before the models)."""
    s = enriched(samples, metadata, ["doc_id"], ["form_type", "eventIds"]).join(texts, "doc_id", "left")
    return routed(classified(s))
