import os

import pytest

from disclore.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["stats_by_source_lang", "upsert_last_wins", "k_closest_mid_far", "html_body_text", "form_symbol_classify", "reply_parser", "event_sessions", "rows_by_issuer", "daily_report_files", "rest_scan", "comma_lists", "clusters_one_by_one", "hebrew_texts", "workbook_sheets"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "customer", "embeddings", "pages", "events", "orders", "nation", "region"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(str([str(r[c]).replace("+00:00", "") for c in cols]) for r in df.collect())
    res = con.execute(catalog.ORACLE[name])
    at = [[c[0] for c in res.description].index(c) for c in cols]
    assert got == sorted(str([str(r[i]) for i in at]) for r in res.fetchall())


def test_stream_upserts(spark, tmp_path):
    import json

    from disclore.streaming import report_files, upsert_stream

    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"mayaReports": {"result": [{"mayaReportId": str(k), "publicationDate": "d", "title": f"t{k}", "issuer": [{"issuerName": "A"}], "events": [], "attachedfiles": []}]}}))
    q = upsert_stream(report_files(spark, str(tmp_path / "in"), 1), str(tmp_path / "t"), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    rows = spark.read.parquet(str(tmp_path / "t")).collect()
    assert len(rows) == 1 and rows[0]["issuerName"] == "A"


def test_merges_write_touched_buckets_alone(spark, tmp_path):
    from pyspark.sql import functions as F

    from disclore.sources import writers

    path = str(tmp_path / "t")
    rows = spark.range(2000).select("id", F.concat(F.lit("v"), F.col("id")).alias("v"), F.lit(0).alias("at"))
    writers.created(rows, path, ["id"], 32)
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([(5, "new", 1), (5, "newer", 2), (9999, "more", 1)], "id long, v string, at int")
    touched = writers.merged_into(path, new, ["id"], "at", 32)
    after = files()
    assert len(touched) <= 2 and sum(f in before and before[f] == t for f, t in after.items()) >= 30
    want = {i: f"v{i}" for i in range(2000)} | {5: "newer", 9999: "more"}
    assert {r["id"]: r["v"] for r in spark.read.parquet(path).collect()} == want
    writers.merged_into(path, new, ["id"], "at", 32)  # a replay
    assert {r["id"]: r["v"] for r in spark.read.parquet(path).collect()} == want and spark.read.parquet(path).count() == 2001
    assert writers.merged_into(path, new.limit(0), ["id"], "at", 32) == []
    bucket = spark.read.parquet(path).where("id = 7").first()["bucket"]
    assert writers.deleted_from(spark, path, F.col("bucket") == bucket) == [bucket]
    assert spark.read.parquet(path).where(F.col("bucket") == bucket).count() == 0 and len(touched) + spark.read.parquet(path).select("bucket").distinct().count() >= 32
    spark.catalog.clearCache()


def test_rest_source_asks_for_wanted_dates_and_streams(spark, tmp_path):
    from pyspark.sql import functions as F
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    from disclore.sources import rest

    reader = rest.RestReader({"url": "u", "start": "2024-02-27", "days": "10"})
    left = list(reader.pushFilters([GreaterThanOrEqual(("date",), "2024-02-28"), LessThan(("date",), "2024-03-03"), EqualTo(("record",), "x"), In(("date",), ("2024-03-01", "2024-02-28", "2025-01-01"))]))
    assert left == [EqualTo(("record",), "x")]
    assert [d for p in reader.partitions() for d, _ in p.value] == ["2024-02-28", "2024-03-01"]
    rest.registered(spark)
    options = {"url": f"{DATA}/orders.parquet", "start": "1995-01-01", "days": "30", "paged": "true", "pause": "0", "path": "result", "fetcher": "disclore.plans.roundtrips:orders_of_a_day"}
    orders = spark.read.parquet(f"{DATA}/orders.parquet").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), "o_orderkey")
    one = spark.read.format("disclosure_rest").options(**options).load().where("date = '1995-01-07'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == orders.where("date = '1995-01-07'").count()
    for days in ("12", "30", "30"):  # a later start asks for the dates that are new; the last finds none
        q = spark.readStream.format("disclosure_rest").options(**(options | {"days": days, "dates_per_task": "7"})).load()
        q = q.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "o")).select("date", F.get_json_object("record", "$.id").cast("long").alias("id")).collect()
    want = orders.where("date between '1995-01-01' and '1995-01-30'").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_summaries_take_documents_of_many_lines(spark, tmp_path):
    from disclore.operators.assist import stub

    texts = {1: "one line", 2: "first\nlast line", 3: "a\n\nb\n \n", 4: "  lead\r\ntail  "}
    rows = [(i, t, "en", "src1", len(t)) for i, t in texts.items()] + [(5, "no\nprompt", "en", "src7", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["raw_response"] for r in catalog.QUERIES["summaries_by_handle"](spark, str(tmp_path)).collect()}
    assert got == {str(i): stub(t) for i, t in texts.items()}


@pytest.mark.parametrize("name", ["extracted_text", "html_to_text", "html_body_text", "charsets_told"])
def test_odd_texts_equal_sql(spark, tmp_path, name):
    import duckdb

    texts = ["End.\nü", "ü\nEnd.", "a\n\u00e9.\n", "", "a", "b 1", "1 c", "1", "$ 2", "?", "a. b", "to be", "x y z", "é", "\n"]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(t for t in texts for _ in range(3))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    cut = ["&am", "&amp", "&amp;", "&amp;amp", "&quot", "&copy x", "&middot;&quot;", "&"]
    pages = [(i, "u", f"<html><head><title>t {x}</title></head><body><p>{x}</p><p>a{x}</body></html>") for i, x in enumerate(cut)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    got = sorted(str(list(r)) for r in df.collect())
    assert got == sorted(str(list(r)) for r in con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLE[name]})").fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_python_takes_small_batches_of_texts(spark):
    from pyspark.sql import functions as F

    from disclore.functions import text

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    catalog.QUERIES["clean_text"](spark, DATA)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
    row = spark.createDataFrame([("é", "é", "שׁ x", None)], "a string, b string, c string, d string")
    assert list(row.select(*[text.strip_points(F.col(c)) for c in "abcd"]).first()) == ["é", "é", "ש x", None]


def test_rest_fetcher_reads_one_day(spark, tmp_path):
    from disclore.plans import roundtrips

    for day, n in (("2024-03-01", 7), ("2024-03-12", 2)):
        spark.range(n).selectExpr("id as o_orderkey", "'F' as o_orderstatus").repartition(2).write.parquet(str(tmp_path / f"day={day}"))
    assert len(roundtrips._orders(str(tmp_path), "2024-03-01")) == 7
    pages = [roundtrips.orders_of_a_day(f"{tmp_path}/2024/3/{day}?page={page}", {})[1] for day, page in ((1, 0), (1, 1), (1, 2), (12, 0), (2, 0))]
    assert [p.count('"id"') for p in pages] == [5, 2, 0, 2, 0]
