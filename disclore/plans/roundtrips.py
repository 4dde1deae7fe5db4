"""More queries of the catalogue: reports, files written and read back, text helpers, model shells."""

from __future__ import annotations

import json
import os
import uuid
from functools import lru_cache

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chunks as ch
from ..functions import html, jsons, text
from ..operators import assist, fusion, pooling, records, stats
from ..sources import readers, rest, writers
from .catalog import _rounded_vector, _Tables, _vec, query
from .pipelines import ingested


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, below spark.checkpoint.dir; a local session may do without that setting."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "/tmp/checkpoints/disclore"
    return f"{at.rstrip('/')}/files/{uuid.uuid4().hex}"


# -- reports --------------------------------------------------------------------------------------------------------


def _reports(t: _Tables) -> DataFrame:
    """Reports made of orders: two issuers (one of them sometimes without a name), one or two events, a file."""
    k = F.col("o_orderkey")
    issuer = F.array(F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("issuerName")), F.struct(F.when(k % 3 != 0, F.concat(F.lit("s"), (k % 7).cast("string"))).alias("issuerName")))
    events = F.array(F.struct((k % 6000).cast("string").alias("eventId"), F.col("o_orderpriority").alias("eventName")), F.struct(F.lit("7").alias("eventId"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("eventName")))
    return t.orders.select(k.cast("string").alias("mayaReportId"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publicationDate"), F.concat(F.lit("order "), k.cast("string")).alias("title"), F.concat(F.lit("https://x/"), k.cast("string")).alias("url"), F.when(k % 5 == 0, F.lit(True)).alias("isPriorityReport"), F.lit(None).cast("boolean").alias("isCorrection"), issuer.alias("issuer"), events.alias("events"), F.array(F.struct(F.lit("a.pdf").alias("url"))).alias("attachedfiles"))


_REPORTS = """r AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d, 'order ' || o_orderkey AS title, 'https://x/' || o_orderkey AS url, 'c' || o_custkey AS i0, CASE WHEN o_orderkey % 3 <> 0 THEN 's' || o_orderkey % 7 END AS i1, o_orderkey % 6000 AS e0, o_orderpriority AS p, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS s FROM orders)"""


@query(f"WITH {_REPORTS} SELECT k::VARCHAR AS id, d, title, url, k % 5 = 0 AS priority, FALSE AS correction, i0 || ', ' || coalesce(i1, '') AS issuers, p || ', ' || coalesce(s, '') AS events, 'a.pdf' AS files FROM r")
def flattened_reports(spark, d):
    return records.flattened(_reports(_Tables(spark, d))).toDF("id", "d", "title", "url", "priority", "correction", "issuers", "events", "files")


@query(f"WITH {_REPORTS} SELECT k::VARCHAR AS id, i0 || '|' || coalesce(i1, '-') AS issuers, p || '|' || coalesce(s, '-') AS events FROM r WHERE k > 500")
def reports_above_an_id(spark, d):
    one = lambda c: F.array_join(c, "|", "-")
    return records.disclosures_v1(_reports(_Tables(spark, d)), 500).select(F.col("reportId").alias("id"), one("issuers").alias("issuers"), one("events").alias("events"))


@query(f"""WITH {_REPORTS}, i AS (SELECT k, d, title, e0, p, s, unnest([i0, i1]) AS name FROM r), n AS (SELECT * FROM i WHERE name IS NOT NULL)
  SELECT name, k::VARCHAR AS id, d, title, p AS event, CASE WHEN s = p THEN '7' ELSE e0::VARCHAR END AS event_id FROM n UNION ALL SELECT name, k::VARCHAR, d, title, s, '7' FROM n WHERE s IS NOT NULL AND s <> p""")
def rows_by_issuer(spark, d):
    rows = records.by_issuer(_reports(_Tables(spark, d)))
    return rows.select(F.col("issuerName").alias("name"), F.col("reportId").alias("id"), F.col("publicationDate").alias("d"), "title", F.explode("events").alias("event", "v")).select("name", "id", "d", "title", "event", F.col("v.eventId").alias("event_id"))


@query(f"""WITH {_REPORTS}, i AS (SELECT k, d, title, unnest([i0, i1]) AS name FROM r WHERE e0 <= 5000 AND k > 0), n AS (SELECT *, row_number() OVER (PARTITION BY name, d ORDER BY k::VARCHAR DESC) AS last FROM i WHERE name IS NOT NULL),
  old AS (SELECT 'c' || o_custkey AS name, min(strftime(o_orderdate, '%Y-%m-%d')) AS d FROM orders GROUP BY 1) SELECT name, d, k::VARCHAR AS id, title FROM n WHERE last = 1 UNION ALL SELECT name, d, 'old', NULL FROM old WHERE (name, d) NOT IN (SELECT name, d FROM n)""")
def ingested_reports(spark, d):
    t = _Tables(spark, d)
    before = t.orders.groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("issuerName")).agg(F.min(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("publicationDate"))
    table = before.select("issuerName", "publicationDate", F.lit("old").alias("reportId"), F.lit(None).cast("string").alias("title"))
    return ingested(_reports(t), table).select(F.col("issuerName").alias("name"), F.col("publicationDate").alias("d"), F.col("reportId").alias("id"), "title")


@query("SELECT o_orderkey::VARCHAR AS id, 'order ' || o_orderkey AS title, 2 AS n_issuers FROM orders")
def daily_report_files(spark, d):
    path = scratch(spark)
    r = _reports(_Tables(spark, d)).withColumn("month", F.substring("publicationDate", 1, 7))
    files = r.groupBy("month").agg(F.collect_list(F.struct(*[c for c in r.columns if c != "month"])).alias("result")).select("month", F.struct("result").alias("mayaReports"))
    files.write.partitionBy("month").json(path)
    return readers.daily_reports(spark, path).select(F.col("mayaReportId").alias("id"), "title", F.size("issuer").alias("n_issuers"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey AS id, o_orderstatus AS status FROM orders")
def rest_scan(spark, d):
    """All orders through the REST source: a request a day and page, served from files that hold a day each."""
    rest.registered(spark)
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderdate")
    days = orders.agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b")).first()
    path = scratch(spark)
    dated = orders.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    dated.repartition("day").sortWithinPartitions("day", "o_orderkey").write.partitionBy("day").parquet(path)
    options = {"url": path, "start": days["a"].isoformat(), "days": (days["b"] - days["a"]).days + 1, "dates_per_task": 64, "paged": "true", "pause": 0, "path": "result", "fetcher": "disclore.plans.roundtrips:orders_of_a_day"}
    df = spark.read.format("disclosure_rest").options(**{k: str(v) for k, v in options.items()}).load()
    return df.select("date", F.get_json_object("record", "$.id").cast("long").alias("id"), F.get_json_object("record", "$.status").alias("status"))


@lru_cache(maxsize=2)
def _orders(path: str, day: str) -> pd.DataFrame:
    """The orders of one day, of a folder with one for each day, or of a table."""
    columns = ["o_orderkey", "o_orderstatus"]
    local = path.removeprefix("file:")
    if not local.endswith(".parquet"):
        local = f"{local}/day={day}"
        if not os.path.isdir(local):
            return pd.DataFrame({c: [] for c in columns})
        return pd.concat([pq.ParquetFile(f"{local}/{f}").read(columns).to_pandas() for f in sorted(os.listdir(local)) if f.endswith(".parquet")]).sort_values("o_orderkey")
    t = pd.read_parquet(local, columns=[*columns, "o_orderdate"])
    return t[pd.to_datetime(t["o_orderdate"]).dt.strftime("%Y-%m-%d") == day].sort_values("o_orderkey")


def orders_of_a_day(url: str, headers: dict[str, str], size: int = 5) -> tuple[int, str]:
    """What a service over the orders would answer: a page of the records of <orders>/<year>/<month>/<day>?page=<n>."""
    address, _, page = url.partition("?page=")
    path, y, m, day = address.rsplit("/", 3)
    rows = _orders(path, f"{int(y):04}-{int(m):02}-{int(day):02}").iloc[int(page) * size : (int(page) + 1) * size]
    return 200, json.dumps({"result": [{"id": int(i), "status": s} for i, s in zip(rows["o_orderkey"], rows["o_orderstatus"])]})


_ALPHABET = "abcdefghijklmnopqrstuvwxyz", "אבגדהוזחטיכלמנסעפצקרשתאבגד"
_IN_HEBREW = f"translate(regexp_replace(lower(text), '[^a-z ]+', ' ', 'g'), '{_ALPHABET[0]}', '{_ALPHABET[1]}')"


@F.pandas_udf(T.BinaryType())
def _encoded(text: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else t.encode(c) for t, c in zip(text, charset)])


@query(f"""WITH t AS (SELECT doc_id, ['utf-8', 'windows-1255', 'iso-8859-8'][doc_id % 3 + 1] AS charset, {_IN_HEBREW} AS t FROM documents),
  u AS (SELECT doc_id, charset, CASE WHEN charset = 'windows-1255' THEN '“' || t || '”' ELSE t END AS t FROM t) SELECT doc_id, CASE WHEN charset = 'iso-8859-8' AND NOT regexp_matches(t, '[א-ת]') THEN 'utf-8' ELSE charset END AS charset, t AS text FROM u""")
def charsets_told(spark, d):
    """All documents, their letters as Hebrew ones, in three charsets: told and decoded."""
    plain = F.translate(F.regexp_replace(F.lower("text"), "[^a-z ]+", " "), *_ALPHABET)
    t = _Tables(spark, d).documents.select("doc_id", F.get(F.array(F.lit("utf-8"), F.lit("windows-1255"), F.lit("iso-8859-8")), (F.col("doc_id") % 3).cast("int")).alias("charset"), plain.alias("t"))
    t = t.withColumn("t", F.when(F.col("charset") == "windows-1255", F.concat(F.lit("“"), "t", F.lit("”"))).otherwise(F.col("t")))
    raw = t.select("doc_id", _encoded("t", "charset").alias("raw"))
    return raw.select("doc_id", text.charset_of(F.col("raw")).alias("charset"), text.decoded(F.col("raw")).alias("text"))


# -- files written and read back --------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, n_chars FROM documents")
def json_arrays(spark, d):
    """All documents as files of JSON arrays, 500 rows each, with a byte-order mark, read back as rows."""
    docs = _Tables(spark, d).documents.select(F.expr("doc_id div 500").alias("part"), F.struct("doc_id", "lang", "n_chars").alias("r"))
    path = scratch(spark)
    arrays = docs.groupBy("part").agg(F.concat(F.lit("\ufeff"), F.to_json(F.collect_list("r"))).alias("value"))
    arrays.repartition("part").write.partitionBy("part").text(path)
    return readers.json_records(spark, path, "doc_id long, lang string, n_chars long, part int").select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, lang, source AS date FROM documents")
def raw_json_by_date(spark, d):
    path = scratch(spark)
    docs = _Tables(spark, d).documents.select("doc_id", "lang", F.col("source").alias("date"))
    writers.raw_json(docs.withColumn("lang", F.lit("old")), path)
    writers.raw_json(docs, path)  # each date's folder is replaced
    return spark.read.schema("doc_id long, lang string, date string").json(path)


@query("SELECT doc_id::VARCHAR AS doc_id, i // 1200 AS chunk_id, substr(text, i + 1, 1500) AS text FROM (SELECT doc_id, text, unnest(range(0, length(text), 1200)) AS i FROM documents)")
def chunk_files(spark, d):
    path = scratch(spark)
    writers.chunks(ch.exploded(_Tables(spark, d).documents, ch.char_chunks(F.col("text")), "doc_id"), path)
    return readers.chunks(spark, path).select("doc_id", "chunk_id", "text")


@query("SELECT vec_id::VARCHAR AS doc_id, i - 1 AS pos, round(embedding[i]::DOUBLE, 6) AS x FROM embeddings, range(1, 65) r(i)")
def vector_files(spark, d):
    path = scratch(spark)
    writers.vectors(_vec(_Tables(spark, d)).select("doc_id", "vector"), path)
    return _rounded_vector(readers.vectors(spark, path), "doc_id")


@query("SELECT vec_id::VARCHAR AS doc_id, CASE WHEN vec_id % 11 = 0 THEN -1 ELSE label END AS label FROM embeddings")
def clustering_files(spark, d):
    path = scratch(spark)
    writers.csv(_vec(_Tables(spark, d)).select("doc_id", F.when(F.col("vec_id") % 11 == 0, -1).otherwise(F.col("cluster")).alias("meta_cluster"), F.lit("x,\"y").alias("note")), path)
    return readers.clustering_csv(spark, path)


@query("SELECT 'nation' AS sheet, n_nationkey::VARCHAR AS id, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey::VARCHAR, r_name FROM region")
def workbook_sheets(spark, d):
    t, path = _Tables(spark, d), scratch(spark)
    writers.workbook({"nation / all": t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "region": t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))}, path)
    out = readers.sheet(spark, path, "nation_all").select(F.lit("nation").alias("sheet"), "id", "name").union(readers.sheet(spark, path, "region").select(F.lit("region"), "id", "name"))
    return out if readers.sheet(spark, path, "none") is None else out.limit(0)


@query("SELECT lower(replace(c_mktsegment, ' ', '_')) AS report, c_custkey, c_name FROM customer")
def report_folders(spark, d):
    path = scratch(spark)
    writers.json_reports(_Tables(spark, d).customer.select("c_custkey", "c_name", "c_mktsegment"), path, "c_mktsegment")
    return spark.read.schema("c_custkey long, c_name string, report string").json(path).select("report", "c_custkey", "c_name")


@query("SELECT lower(replace(c_mktsegment, ' ', '_')) AS handle, count(*) AS n FROM customer GROUP BY 1")
def listed_result_files(spark, d):
    """Result files by model and handle, listed and read one by one."""
    path = scratch(spark)
    rows = _Tables(spark, d).customer.groupBy(F.lower(F.regexp_replace("c_mktsegment", " ", "_")).alias("handle")).agg(F.count("*").alias("n"))
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in rows.collect():  # one file a segment
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/m/{r['handle']}.json"))
        out.write(json.dumps({"n": r["n"]}).encode())
        out.close()
    found = readers.summary_files(spark, path, "m").select("handle")
    content = readers.objects(spark, f"{path}/m", (".json",), content=True)
    return content.select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("handle"), F.get_json_object(F.decode("content", "UTF-8"), "$.n").cast("long").alias("n")).join(found, "handle", "left_semi")


@query("SELECT n_nationkey::VARCHAR AS doc_id, CASE WHEN n_nationkey % 2 = 0 THEN 'text of ' ELSE '<p>' END || n_name AS text FROM nation")
def texts_by_name(spark, d):
    path = scratch(spark)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in _Tables(spark, d).nation.collect():  # 25 rows
        kinds = {"html": "<p>"} if r["n_nationkey"] % 2 else {"txt": "text of ", "htm": "<p>"}
        for kind, before in kinds.items():
            out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{r['n_nationkey']}.{kind}"))
            out.write((before + r["n_name"]).encode())
            out.close()
    return readers.texts(spark, path)


@query("""SELECT '| c_custkey | c_name |' AS line UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '| ' || c_custkey || ' | ' || CASE WHEN c_custkey % 3 = 0 THEN 'a\\|b ' || c_name ELSE c_name END || ' |' FROM customer""")
def markdown_table(spark, d):
    rows = _Tables(spark, d).customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("a|b\n"), "c_name")).otherwise(F.col("c_name")).alias("c_name"))
    path = scratch(spark)
    writers.markdown(rows, path, ["c_custkey"])
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT event_id::VARCHAR AS file_id, strftime(ts + INTERVAL 90 SECOND, '%Y-%m-%dT%H:%M:%S.%f') AS processed_at, 'in/' || event_id AS input_key, 'out/' || event_id AS output_key, CASE WHEN user_id % 4 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, 90000 AS duration_ms, CASE WHEN user_id % 4 = 0 THEN event_type END AS error_message FROM events")
def processing_log(spark, d):
    e = _Tables(spark, d).events
    i = F.col("event_id").cast("string")
    return writers.log_rows(e, F.col("ts"), F.col("ts") + F.expr("interval 90 seconds"), i, F.concat(F.lit("in/"), i), F.concat(F.lit("out/"), i), F.when(F.col("user_id") % 4 == 0, F.col("event_type")))


# -- filters, aggregates ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL OR toxic IS NOT NULL")
def present_fields(spark, d):
    t = _Tables(spark, d)
    return records.present(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), ["quality", "toxic"], ["doc_id"])


@query("SELECT user_id FROM events GROUP BY 1 HAVING bool_or(event_type = 'purchase')")
def users_with_event(spark, d):
    g = _Tables(spark, d).events.groupBy("user_id").agg(F.collect_set("event_type").alias("names"))
    return g.where(records.has_event(F.col("names"), "purchase")).select("user_id")


@query("SELECT page_id, CASE WHEN contains(url, '7') THEN url WHEN page_id % 2 = 0 THEN 'x7.pdf' END AS first FROM pages")
def first_matching_file(spark, d):
    p = _Tables(spark, d).pages
    return p.select("page_id", records.first_matching(F.array(F.col("url"), F.when(F.col("page_id") % 2 == 0, "x7.pdf").otherwise("none")), "7").alias("first"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 2 AND p_partkey % 6 >= 3")
def real_table_filter(spark, d):
    p = _Tables(spark, d).part.select("p_partkey", "p_size", (F.col("p_partkey") % 6).alias("n_cols"))
    return records.real_tables(p, "p_size", "n_cols").select("p_partkey", "p_size")


@query("""WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT d.source AS path, doc_id AS page, text, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS line FROM documents d JOIN n USING (source) WHERE NOT (doc_id < 5 AND n > 10)),
  m AS (SELECT path, s, min(page) FILTER (WHERE regexp_matches(line, w) OR regexp_matches(reverse(line), w)) AS a, min(page) FILTER (WHERE regexp_matches(text, w) OR regexp_matches(reverse(text), w)) AS b FROM p, (VALUES ('one', 'with'), ('two', 'ungsch'), ('none', 'Zqx')) v(s, w) GROUP BY 1, 2)
  SELECT path, s AS section, coalesce(a, b) AS start FROM m WHERE coalesce(a, b) IS NOT NULL""")
def heading_pages(spark, d):
    p = _Tables(spark, d).documents.select(F.col("source").alias("path"), F.col("doc_id").alias("page"), "text")
    return records.section_starts(p, {"one": "with", "two": "ungsch", "none": "Zqx"})


@query("SELECT coalesce(lang, 'UNKNOWN') AS lang, doc_id, row_number() OVER (PARTITION BY coalesce(lang, 'UNKNOWN') ORDER BY doc_id) - 1 AS pos FROM documents")
def rows_of_each_key(spark, d):
    g = stats.collected(_Tables(spark, d).documents.select("lang", "doc_id", "n_chars"), "lang", ["doc_id"], ["n_chars"])
    return g.select("lang", F.posexplode("rows").alias("pos", "r")).select("lang", "r.doc_id", F.col("pos").cast("long").alias("pos"))


@query("SELECT a AS pca, b AS components, c AS covariance FROM (VALUES (30), (35)) x(a), (VALUES (2), (3), (5)) y(b), (VALUES ('full'), ('tied')) z(c)")
def parameter_grid(spark, d):
    return stats.grid(spark, pca=[30, 35], components=[2, 3, 5], covariance=["full", "tied"])


@query("SELECT vec_id::VARCHAR AS doc_id, label AS label_0, vec_id % 7 AS label_1, vec_id % 5 AS label_2 FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 2 = 0")
def aligned_labels(spark, d):
    v = _vec(_Tables(spark, d))
    part = lambda c, where: v.where(where).select("doc_id", c.alias("label"))
    return fusion.aligned(part(F.col("cluster"), "vec_id % 3 <> 0"), part(F.col("vec_id") % 7, "true"), part(F.col("vec_id") % 5, "vec_id % 2 = 0"))


@query("SELECT label AS label_0, vec_id % 3 AS label_1, count(*) AS n, min(vec_id) AS first_id FROM embeddings GROUP BY 1, 2")
def combined_label_sizes(spark, d):
    e = _Tables(spark, d).embeddings.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("label_0"), (F.col("vec_id") % 3).alias("label_1"))
    return fusion.coassociation_labels(e, ["label_0", "label_1"])


@query("""WITH c AS (SELECT doc_id % 20 AS doc_id, doc_id // 20 AS chunk_id, text FROM documents), w AS (SELECT doc_id, chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}_]{2,}')) AS w FROM c),
  tf AS (SELECT doc_id, chunk_id, w, count(*) AS tf FROM w GROUP BY 1, 2, 3), n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1), df AS (SELECT doc_id, w, count(*) AS df FROM tf GROUP BY 1, 2),
  x AS (SELECT tf.doc_id, chunk_id, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (doc_id, w) JOIN n USING (doc_id)), r AS (SELECT doc_id, chunk_id, sum(x) / sqrt(sum(x * x)) AS s FROM x GROUP BY 1, 2),
  s AS (SELECT c.doc_id, c.chunk_id, coalesce(s, 0) + 1e-9 AS s FROM c LEFT JOIN r USING (doc_id, chunk_id)), y AS (SELECT doc_id, chunk_id, s / sum(s) OVER (PARTITION BY doc_id) AS weight FROM s)
  SELECT y.doc_id, i - 1 AS pos, round(sum(weight * embedding[i]::DOUBLE), 6) AS x FROM y JOIN embeddings ON vec_id % 20 = y.doc_id AND vec_id // 20 = chunk_id, range(1, 65) r(i) GROUP BY 1, 2""")
def tfidf_pooled_vectors(spark, d):
    t = _Tables(spark, d)
    c = t.documents.select((F.col("doc_id") % 20).alias("doc_id"), F.expr("doc_id div 20").alias("chunk_id"), "text")
    v = _vec(t).select((F.col("vec_id") % 20).alias("doc_id"), F.expr("vec_id div 20").alias("chunk_id"), "vector")
    return _rounded_vector(pooling.tfidf_vectors(v, c), "doc_id")


# -- text and JSON ------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, CASE WHEN contains(text, 'with') THEN regexp_replace(substr(text, 1, instr(text, 'with') - 1), '^\s+|\s+$', '', 'g') ELSE text END AS text FROM documents")
def text_before_marker(spark, d):
    return _Tables(spark, d).documents.select("doc_id", text.before_marker(F.col("text"), "with").alias("text"))


_HEBREW = ("דוח הדירקטוריון לשנת 2023 על מצב החברה", "הסברי   הדירקטוריון", "דוחות כספיים מאוחדים ליום 31 בדצמבר", "דוח כספיים", "the company reports in English only", "קצר", 'חברה בע"מ "ציטוט" וגם תשקיף מדף של החברה')
_HEBREW_SQL = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_HEBREW)) + " END"


def _hebrew():
    return F.get(F.array(*map(F.lit, _HEBREW)), (F.col("doc_id") % 7).cast("int"))


@query(f"SELECT doc_id, doc_id % 7 IN (0, 1) AS directors, doc_id % 7 = 2 AS financials, regexp_matches({_HEBREW_SQL}, 'מצב|מדף') AS other FROM documents")
def headings_found(spark, d):
    t = _hebrew()
    return _Tables(spark, d).documents.select("doc_id", t.rlike(text.SECTION_PATTERNS["directors"]).alias("directors"), t.rlike(text.SECTION_PATTERNS["financials"]).alias("financials"), text.matches_either_way(F.reverse(t), "מצב|מדף").alias("other"))


@query(f"""WITH t AS (SELECT doc_id, {_HEBREW_SQL} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) >= 20 AND length(regexp_replace(t, '[^א-ת]', '', 'g')) >= 0.3 * length(regexp_replace(t, '[^א-תA-Za-z]', '', 'g')) THEN 'he' ELSE 'en' END AS language, replace(t, 'בע"מ', 'בע\\"מ') AS escaped, chr(65279) || chr(8235) || t || chr(8236) AS wrapped FROM t""")
def hebrew_texts(spark, d):
    t = _hebrew()
    return _Tables(spark, d).documents.select("doc_id", text.language_of(t).alias("language"), text.escape_inner_quotes(t).alias("escaped"), text.rtl_wrapped(t).alias("wrapped"))


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids, sum(event_id)::BIGINT AS total, 0 AS n_bad FROM events GROUP BY 1")
def comma_lists(spark, d):
    g = _Tables(spark, d).events.groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("e"))
    g = g.select("user_id", text.csv_of(F.transform("e", lambda x: x.cast("string"))).alias("ids"))
    return g.select("user_id", "ids", F.aggregate(text.ints_of(F.col("ids")), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(text.ints_of(F.concat(F.col("ids"), F.lit(",x")))).alias("n_bad"))


@query("SELECT page_id, 'Page ' || page_id || ' of {unknown}: ' || url AS filled, CASE WHEN page_id % 2 = 0 THEN url ELSE url || chr(10) || chr(10) || page_id END AS joined FROM pages")
def templates_and_parts(spark, d):
    p = _Tables(spark, d).pages
    return p.select("page_id", text.template("Page {id} of {unknown}: {url}", id=F.col("page_id"), url=F.col("url")).alias("filled"), html.combined(F.col("url"), F.lit(""), F.when(F.col("page_id") % 2 == 1, F.col("page_id").cast("string"))).alias("joined"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'application/pdf' WHEN page_id % 3 = 1 THEN 'text/html' ELSE 'application/octet-stream' END AS guessed, CASE WHEN page_id % 2 = 0 THEN 'image/png' WHEN page_id % 3 = 0 THEN 'application/pdf' WHEN page_id % 3 = 1 THEN 'text/html' ELSE 'application/octet-stream' END AS told FROM pages")
def mime_types(spark, d):
    i = F.col("page_id")
    name = F.concat(F.lit("https://x.example/a"), i, F.when(i % 3 == 0, ".PDF?x=1").when(i % 3 == 1, ".htm").otherwise(".bin"))
    return _Tables(spark, d).pages.select("page_id", text.mime_type(name).alias("guessed"), text.mime_type(name, F.when(i % 2 == 0, "image/png")).alias("told"))


@query("SELECT o_orderkey, year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate) AS path FROM orders")
def date_paths(spark, d):
    return _Tables(spark, d).orders.select("o_orderkey", text.date_path(F.col("o_orderdate")).alias("path"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE (props->>'k')::BIGINT END AS k FROM events")
def json_with_default(spark, d):
    bad = F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("props"))
    return _Tables(spark, d).events.select("event_id", jsons.or_default(bad, "k long", '{"k": -1}')["k"].alias("k"))


@query("""SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS first FROM events""")
def typed_json(spark, d):
    e = _Tables(spark, d).events
    listed = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"S": "'), F.col("event_type"), F.lit('"}'))).otherwise(F.lit(""))
    raw = F.concat(F.lit('{"M": {"user": {"N": "'), F.col("user_id").cast("string"), F.lit('"}, "names": {"L": ['), listed, F.lit("]}}}"))
    plain = jsons.unwrap_typed(raw)
    return e.select("event_id", F.get_json_object(plain, "$.user").cast("long").alias("user_id"), F.get_json_object(plain, "$.names[0]").alias("first"))


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE '{"retryDelay": "' || user_id || 's"}' END AS payload, CASE WHEN user_id % 3 = 0 THEN 7 ELSE greatest(user_id, 1) + 1 END AS wait_s, user_id % 2 = 0 AS daily FROM events""")
def error_details(spark, d):
    u = F.col("user_id")
    t = F.concat(F.lit("429 "), F.when(u % 3 == 0, "no more").otherwise(F.concat(F.lit('{"retryDelay": "'), u.cast("string"), F.lit('s"}'))), F.when(u % 2 == 0, " PerDay").otherwise(""))
    return _Tables(spark, d).events.select("event_id", jsons.error_blob(t).alias("b")).select("event_id", "b.*")


@query("""SELECT c_custkey, 'cluster_id: ' || c_nationkey || chr(10) || 'excerpts:' || chr(10) || '  - |' || chr(10) || '    ' || c_name || chr(10) || '    of ' || c_mktsegment || chr(10) || chr(10) || '  - |' || chr(10) || '    x' || chr(10) AS text FROM customer""")
def excerpt_blocks(spark, d):
    c = _Tables(spark, d).customer
    return c.select("c_custkey", writers.excerpt_text(F.array(F.concat(F.col("c_name"), F.lit("\nof "), F.col("c_mktsegment")), F.lit("x")), F.col("c_nationkey")).alias("text"))


# -- model shells -------------------------------------------------------------------------------------------------------


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), u AS (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 200 THEN [0] ELSE range(0, len(w), 100) END) AS i FROM t WHERE len(w) > 0)
  SELECT doc_id, string_agg(array_to_string(CASE WHEN len(w) <= 200 THEN w ELSE w[i + 1:i + 100] END, ' '), chr(10) || chr(10) ORDER BY i) AS summary FROM u GROUP BY 1""")
def summaries_in_parts(spark, d):
    return assist.summarised_in_parts(_Tables(spark, d).documents.select("doc_id", "text"), "Summarise:\n{input_text}", most=100, whole_up_to=200)


@query("""SELECT a.doc_id, 'A ' || summary_a || ' B ' || summary_b || ' of ' || d.text || ' task ' || CASE WHEN d.lang = 'en' THEN 'english' ELSE '' END AS prompt FROM (SELECT doc_id::VARCHAR AS doc_id, 'a' || quality AS summary_a, CASE WHEN toxic = 1 THEN 'b' ELSE '' END AS summary_b FROM labels WHERE quality IS NOT NULL) a JOIN documents d ON d.doc_id::VARCHAR = a.doc_id""")
def judge_texts(spark, d):
    t = _Tables(spark, d)
    a = t.labels.where("quality is not null").select("doc_id", F.concat(F.lit("a"), F.col("quality").cast("string")).alias("summary"))
    b = t.labels.where("toxic = 1").select("doc_id", F.lit("b").alias("summary"))
    prompts = spark.createDataFrame([("en", "english")], "handle string, prompt_text string")
    out = assist.judge_prompts(a, b, t.documents.select("doc_id", "text", F.col("lang").alias("category_handle")), "A {summary_a} B {summary_b} of {source} task {task}", prompts)
    return out.select("doc_id", "prompt")


@query("""SELECT c_custkey, 'first' AS winner, c_nationkey + 3 AS score_a, c_custkey % 10 AS score_b FROM customer""")
def judged_scores(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    reply = F.concat(F.lit('```json\n{"analysis": {"evaluation_scores": {"model_A": {"clarity": '), n.cast("string"), F.lit(', "accuracy": 3}, "model_B": {"clarity": '), (k % 10).cast("string"), F.lit('}}, "verdict": {"winner": "model_A", "rationale": "x"}}, "optimized_prompt": "y"}\n```'))
    from .. import schemas

    p = assist.parsed(_Tables(spark, d).customer.select("c_custkey", reply.alias("reply")), schemas.JUDGEMENT)
    return assist.total_scores(assist.relabelled(p, {"model_A": "first", "model_B": "second"}), "first", "second").select("c_custkey", "winner", "score_a", "score_b")


@query("""WITH n AS (SELECT n_name, n_regionkey FROM nation), f AS (SELECT n_regionkey, min(n_name) AS first FROM n GROUP BY 1), k AS (SELECT n_regionkey, row_number() OVER (ORDER BY first) - 1 AS cluster_id FROM f) SELECT n_name AS doc_id, cluster_id FROM n JOIN k USING (n_regionkey)""")
def clusters_one_by_one(spark, d):
    """Nations in the order of their names; the stand-in model puts a nation to the cluster whose title is its region."""
    rows = _Tables(spark, d).nation.orderBy("n_name").collect()  # 25 rows: the method is sequential
    docs = [(r["n_name"], f"region {r['n_regionkey']}") for r in rows]

    def model(prompt: str) -> str:
        listing, excerpt = prompt.split("\n", 1)
        for c in json.loads(listing):
            if c["title"] == excerpt:
                return json.dumps({"cluster_id": c["cluster_id"], "confidence": 5})
        return f'```json\n{{"cluster_id": "NEW_CLUSTER", "title": "{excerpt}"}}\n```'

    made = assist.incremental_clusters(docs, model, "{clusters}\n{excerpt}")
    return spark.createDataFrame([(i, c["cluster_id"]) for c in made for i in c["document_ids"]], "doc_id string, cluster_id long")


@query("SELECT 'h' || r_regionkey AS handle, CASE WHEN r_regionkey < 3 THEN 'better ' || r_name ELSE 'old' END AS prompt_text FROM region")
def refined_prompts(spark, d):
    """Two models and a judge that rewrites the prompts of three handles, once; the second round changes nothing."""
    r = _Tables(spark, d).region
    docs = r.select(F.col("r_regionkey").cast("string").alias("doc_id"), F.concat(F.lit("h"), "r_regionkey").alias("category_handle"), F.col("r_name").alias("text"))
    prompts = docs.select(F.col("category_handle").alias("handle"), F.lit("old").alias("prompt_text"))

    def model(prompt: str) -> str:
        return json.dumps({"summary": assist.stub(prompt)})

    def judge(prompt: str) -> str:
        _, name = prompt.splitlines()[0].split(" ", 1)
        return json.dumps({"analysis": {"verdict": {"winner": "model_A"}}} | ({"optimized_prompt": f"better {name}"} if name[0] in "A" else {}))

    return assist.refined(docs, prompts, {"a": model, "b": model}, judge, "x {source}", 3)[0]

