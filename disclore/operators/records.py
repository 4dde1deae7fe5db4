"""Report records: flattening, issuer rows, event maps, filters, joins on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_lines
from .tables import products


def joined_names(values: Column, field: str) -> Column:
    """Names of an array of structs as one ', ' text; a missing name is '', a missing list '' (PRJ1)."""
    return F.coalesce(F.array_join(F.transform(values, lambda x: F.coalesce(x[field], F.lit(""))), ", "), F.lit(""))


def flattened(reports: DataFrame) -> DataFrame:
    return reports.select("mayaReportId", "publicationDate", "title", "url", F.coalesce("isPriorityReport", F.lit(False)).alias("isPriorityReport"), F.coalesce("isCorrection", F.lit(False)).alias("isCorrection"), joined_names(F.col("issuer"), "issuerName").alias("issuers"), joined_names(F.col("events"), "eventName").alias("events"), joined_names(F.col("attachedfiles"), "url").alias("attachedFiles"))


def disclosures_v1(reports: DataFrame, above: int = 1621489) -> DataFrame:
    """One row a report with lists of names; ids above a number only (PRJ4, FLT2)."""
    return reports.where(id_above(F.col("mayaReportId"), above)).select(F.col("mayaReportId").cast("string").alias("reportId"), "publicationDate", "title", "url", F.coalesce("isPriorityReport", F.lit(False)).alias("isPriority"), F.coalesce("isCorrection", F.lit(False)).alias("isCorrection"), F.col("issuer.issuerName").alias("issuers"), F.col("events.eventName").alias("events"), F.col("attachedfiles.url").alias("attachedFiles"))


def event_map(events: Column) -> Column:
    """name -> event; events without a name are passed over, the last of a name wins (PRJ6)."""
    named = F.filter(F.coalesce(events, F.array().cast("array<struct<eventId:string,eventName:string>>")), lambda e: F.coalesce(e["eventName"], F.lit("")) != "")
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named) - i - 1, F.lit(0))), lambda x: x["eventName"] == e["eventName"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["eventName"].alias("key"), e.alias("value"))))


def by_issuer(reports: DataFrame) -> DataFrame:
    """One row for each report and issuer with a name, events as a map (PRJ5)."""
    r = reports.select("*", F.explode("issuer").alias("i")).where("coalesce(i.issuerName, '') <> ''")
    return r.select(F.col("i.issuerName").alias("issuerName"), "publicationDate", F.col("mayaReportId").cast("string").alias("reportId"), "title", "url", F.coalesce("isPriorityReport", F.lit(False)).alias("isPriority"), F.coalesce("isCorrection", F.lit(False)).alias("isCorrection"), event_map(F.col("events")).alias("events"), F.col("attachedfiles.url").alias("attachedFiles"))


def id_above(value: Column, least: int, null_passes: bool = False, null_as: int | None = None) -> Column:
    """Numeric id above a number; what is no number fails; nulls by rule (FLT2)."""
    n = value.try_cast("bigint")
    out = F.coalesce(n > least, F.lit(False))
    if null_as is not None:
        return F.when(value.isNull(), F.lit(null_as > least)).otherwise(out)
    return out | value.isNull() if null_passes else out


def no_event_above(events: Column, most: int = 5000) -> Column:
    """No event id beyond a number; a missing id is 0, one that is no number is passed over (FLT3)."""
    return ~F.coalesce(F.exists(events, lambda e: F.coalesce(F.coalesce(e["eventId"].cast("string"), F.lit("0")).try_cast("int") > most, F.lit(False))), F.lit(False))


def has_event(names: Column, wanted: str) -> Column:
    return F.coalesce(F.array_contains(names, wanted), F.lit(False))


def first_matching(files: Column, pattern: str) -> Column:
    """First file name that matches, else null (FLT6)."""
    return F.get(F.filter(files, lambda x: x.rlike(pattern)), 0)


def pdf_stats(files: Column) -> Column:
    """struct<pdf_count, pdf_total_size> of an array of struct<name, size> (AGG15)."""
    pdfs = F.filter(files, lambda f: F.lower(f["name"]).endswith(".pdf"))
    return F.struct(F.coalesce(F.size(pdfs), F.lit(0)).cast("long").alias("pdf_count"), F.coalesce(F.aggregate(pdfs, F.lit(0).cast("long"), lambda s, f: s + F.coalesce(f["size"].cast("long"), F.lit(0).cast("long"))), F.lit(0)).cast("long").alias("pdf_total_size"))


def present(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """Key and the named columns of rows that have any of them (PRJ3)."""
    return df.select(*key, *columns).where(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull())


def enriched(df: DataFrame, source: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Left join by key; the source's fields where it has them, else the row's own (JOIN10)."""
    s = source.select(*key, *[F.col(c).alias(f"_s_{c}") for c in columns])
    return df.join(s, key, "left").withColumns({c: F.coalesce(f"_s_{c}", c) if c in df.columns else F.col(f"_s_{c}") for c in columns}).drop(*[f"_s_{c}" for c in columns])


def with_event_names(df: DataFrame, ids: str, names: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``events``: (id, name) of each id in the array, name null when unknown (JOIN5)."""
    pairs = df.select(key, F.posexplode(ids).alias("_pos", "event_id")).join(names.select(F.col("event_id"), F.col("event_name")), "event_id", "left")
    listed = pairs.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "event_id", "event_name"))), lambda x: F.struct(x["event_id"].alias("id"), x["event_name"].alias("name"))).alias("events"))
    return df.join(listed, key, "left")


def pairs_of_models(a: DataFrame, b: DataFrame, originals: DataFrame | None = None, keep_empty: bool = False) -> DataFrame:
    """doc_id, summary_a, summary_b (and text): summary, else the error's own, else ''; the last of an id wins (JOIN6)."""
    def texts(df: DataFrame, name: str) -> DataFrame:
        text = F.coalesce("summary", "error.actual_content_summary", F.lit("")) if "error" in df.columns else F.coalesce("summary", F.lit(""))
        order = F.col("pos") if "pos" in df.columns else F.monotonically_increasing_id()
        return df.select(F.col("doc_id").cast("string").alias("doc_id"), text.alias(name), order.alias("_o")).groupBy("doc_id").agg(F.max_by(name, "_o").alias(name))

    out = texts(a, "summary_a").join(texts(b, "summary_b"), "doc_id", "left").withColumn("summary_b", F.coalesce("summary_b", F.lit("")))
    if originals is not None:
        out = out.join(originals.select(F.col("doc_id").cast("string").alias("doc_id"), "text").groupBy("doc_id").agg(F.first("text").alias("text")), "doc_id", "left")
    return out if keep_empty else out.where("summary_a <> '' or summary_b <> ''")


def with_prompt(docs: DataFrame, prompts: DataFrame, handle: str = "category_handle", default: str | None = None) -> DataFrame:
    """Adds prompt_text by handle; without a default, documents without a prompt are left out (JOIN7)."""
    p = prompts.select(F.col("handle").alias(handle), "prompt_text")
    if default is None:
        return docs.join(p, handle)
    return docs.join(p, handle, "left").withColumn("prompt_text", F.coalesce("prompt_text", F.lit(default)))


def remaining(all_docs: DataFrame, sampled: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that are not in the sample (JOIN8)."""
    return all_docs.join(sampled.select(key).distinct(), key, "left_anti")


def sections(starts: DataFrame, end: int, key: list[str] | None = None, closed: bool = True) -> DataFrame:
    """Ranges from ordered starts: each ends before the next, the last at ``end`` (WIN6)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*(key or [])).orderBy("start", "section") if key else Window.orderBy("start", "section")
    return starts.withColumn("end", F.lead("start", 1, end + 1).over(w) - (1 if closed else 0))


def in_sections(items: DataFrame, ranges: DataFrame, at: str = "page", keep_outside: bool = False, key: list[str] | None = None, width: int = 64) -> DataFrame:
    """The first section (by start, then end and name) of the item's document whose range holds its page (JOIN13).

    ``key`` names the document; without it the ranges are those of one document. Pages are put in bins of ``width`` and
    ranges in all bins that they reach, within the document's pages, so that pages meet the ranges of their bin alone, and
    no row ever holds all ranges. Each page of a document is looked up once, however many items it has. Items without a
    page, or outside of all ranges, have no section; columns of ranges other than these are not read.
    """
    key = key or []
    pages = items.select(*key, F.col(at).cast("long").alias("_at")).where("_at is not null").distinct()
    reach = pages.groupBy(*key).agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    known = ranges.select(*key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "section").where("section is not null")
    known = known.join(reach, key) if key else known.join(F.broadcast(reach))  # without a key it is one row
    known = known.where((F.col("end") >= F.col("start")) & (F.col("end") >= F.col("_lo")) & (F.col("start") <= F.col("_hi")))
    bin_of = lambda c: F.floor(c / width).cast("long")
    known = known.withColumn("_bin", F.explode(F.sequence(bin_of(F.greatest("start", "_lo")), bin_of(F.least("end", "_hi")))))
    met = pages.withColumn("_bin", bin_of(F.col("_at"))).join(known, [*key, "_bin"]).where(F.col("_at").between(F.col("start"), F.col("end")))
    first = met.groupBy(*key, "_at").agg(F.min(F.struct("start", "end", "section"))["section"].alias("section"))
    found = items.withColumn("_at", F.col(at).cast("long")).join(first, [*key, "_at"], "left" if keep_outside else "inner")
    return found.select(*items.columns, "section")


def section_starts(pages: DataFrame, patterns: dict[str, str], skip_first: int = 5, key: str = "path") -> DataFrame:
    """First page of each heading: as the page's first line, else anywhere; contents pages are skipped in long documents (AGG13, FLT12)."""
    from ..functions.text import first_line, matches_either_way

    n = pages.groupBy(key).agg(F.count("*").alias("_n"))
    p = pages.join(n, key).where(~((F.col("page") < skip_first) & (F.col("_n") > 10)))
    aggs = []
    for name, pattern in patterns.items():
        aggs += [F.min(F.when(matches_either_way(first_line(F.col("text")), pattern), F.col("page"))).alias(f"{name}_1"), F.min(F.when(matches_either_way(F.col("text"), pattern), F.col("page"))).alias(f"{name}_2")]
    g = p.groupBy(key).agg(*aggs)
    found = F.array(*[F.struct(F.lit(name).alias("section"), F.coalesce(f"{name}_1", f"{name}_2").alias("start")) for name in patterns])
    return g.select(key, F.explode(found).alias("s")).select(key, "s.section", "s.start").where("start is not null")


def real_tables(tables: DataFrame, rows: str = "n_rows", cols: str = "n_cols") -> DataFrame:
    return tables.where((F.col(rows) >= 2) & (F.col(cols) >= 3))


def not_blank(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with text in any of the columns (FLT9)."""
    some = F.lit(False)
    for c in columns:
        some = some | (F.trim(F.coalesce(c, F.lit(""))) != "")
    return df.where(some)


def both_present(a: DataFrame, b: DataFrame, key: str = "handle") -> DataFrame:
    """Keys that both sides have, one row for each pair (JOIN14). Pairs, whose number is the product of a key's rows on both
    sides, are made evenly in all tasks and not shuffled."""
    a, b = a.withColumnRenamed("path", "path_a"), b.withColumnRenamed("path", "path_b").withColumnRenamed(key, "_key")
    keys = a.select(key).distinct().withColumn("_key", F.col(key))
    return products(a, b, keys, key, "_key").select(key, *[f"_a.{c}" for c in a.columns if c != key], *[f"_b.{c}" for c in b.columns if c != "_key"])


def cleaned(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, clean_lines(F.col(column)))
