import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from disclore.operators import assist, clustering, evaluation, fusion, pooling, records, sampling, stats
from disclore.schemas import require_columns
from disclore.sources import readers, rest, writers


def vectors(spark, x, labels=None):
    rows = [(f"d{i:03d}", v.tolist(), int(labels[i]) if labels is not None else 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "doc_id string, vector array<double>, label int")


def blobs(n=20, k=3, d=5, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(0, 5, (k, d))
    return np.vstack([c[i] + rng.normal(0, 0.2, (n, d)) for i in range(k)]), np.repeat(np.arange(k), n)


def agree(a, b):
    return len({(x, y) for x, y in zip(a, b)}) == len(set(b)) == len(set(a))


def test_guard(spark):
    with pytest.raises(ValueError, match="missing"):
        require_columns(spark.range(1), "nope")


def test_votes(spark):
    df = spark.createDataFrame([(3, -1, 3), (1, 2, 3), (-1, -1, -1), (-1, 5, -1)], "a int, b int, c int")
    assert [r["vote"] for r in fusion.vote(df, ["a", "b", "c"]).collect()] == [3, 1, -1, 5]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-1, 2), st.integers(-1, 2)), min_size=2, max_size=8))
def test_coassociation_is_symmetric(labels):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(labels)], "doc_id int, label_0 int, label_1 int")
    got = {(r["i"], r["j"]): r["weight"] for r in fusion.coassociation(df, ["label_0", "label_1"]).collect()}
    want = {(i, j): w for i, a in enumerate(labels) for j, b in enumerate(labels) if i != j and (w := sum(x == y != -1 for x, y in zip(a, b)) / 2)}
    assert got == want


def test_coassociation_session(spark):
    assert spark.range(1).count() == 1


@pytest.mark.parametrize("covariance", ["tied", "full", "diag", "spherical"])
def test_mixture_finds_blobs(spark, covariance):
    x, y = blobs()
    got = clustering.gmm(vectors(spark, x), 3, covariance=covariance, steps=5).orderBy("doc_id").collect()
    assert agree([r["label"] for r in got], y.tolist())


def test_methods_find_blobs(spark):
    x, y = blobs()
    df = vectors(spark, x)
    for f in (lambda d: clustering.hdbscan(d, 5, 3, 0.0), lambda d: clustering.agglomerative(d, 3), lambda d: clustering.spectral(d, 3), lambda d: clustering.kmeans(d, 3)):
        assert agree([r["label"] for r in f(df).orderBy("doc_id").collect()], y.tolist())


def test_density_grid_equals_single_runs(spark):
    x, _ = blobs(n=12)
    df = vectors(spark, x).drop("label")
    rows = evaluation.hdbscan_grid(df, sizes=(4,), samples=(2,), eps=(0.0, 0.5), dims=(0,)).collect()
    unit = clustering.normalised(df)
    for r in rows:
        one = evaluation.evaluated(unit.join(clustering.hdbscan(unit, 4, 2, float(r["combo"][-4:])), "doc_id"), noise=-1)
        assert r["n_clusters"] == one["n_clusters"] and r["silhouette"] == pytest.approx(one["silhouette"])
    assert len(rows) == 2


def test_pca_is_centred(spark):
    x, _ = blobs()
    got = np.array([r["vector"] for r in clustering.reduced(vectors(spark, x).drop("label"), 2).orderBy("doc_id").collect()])
    c = x - x.mean(0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    assert np.allclose(np.abs(got), np.abs(want))


def test_indices_by_brute_force(spark):
    x, y = blobs(n=7, seed=3)
    y = y.copy()
    y[0] = 9  # alone in its cluster
    df = vectors(spark, x, y)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    s = []
    for i in range(len(x)):
        own = [j for j in range(len(x)) if y[j] == y[i] and j != i]
        a = d[i, own].mean() if own else None
        b = min(d[i, y == c].mean() for c in set(y.tolist()) - {y[i]})
        s.append(0.0 if a is None else (b - a) / max(a, b))
    assert evaluation.cosine_silhouette(df).first()[0] == pytest.approx(np.mean(s))
    cs = sorted(set(y.tolist()))
    m = np.array([x[y == c].mean(0) for c in cs])
    sp = np.array([np.linalg.norm(x[y == c] - m[i], axis=1).mean() for i, c in enumerate(cs)])
    r = [max((sp[i] + sp[j]) / np.linalg.norm(m[i] - m[j]) for j in range(len(cs)) if j != i) for i in range(len(cs))]
    assert evaluation.davies_bouldin(df).first()[0] == pytest.approx(np.mean(r))


def test_regions_partition_and_overlap(spark):
    x, y = blobs(n=3)
    df = vectors(spark, x, y).withColumnRenamed("label", "cluster")
    placed = sampling.with_distance(df)
    q = sampling.quartiles(placed).groupBy("cluster").pivot("region", ["center", "mid", "edge"]).count().fillna(0).collect()
    assert all((r["center"], r["mid"], r["edge"]) == (0, 2, 1) for r in q)
    assert sampling.regions(placed, 10).count() == 3 * 9
    again = [sampling.seeded_sample(placed, ["cluster"], 2, [0, 1]).orderBy("seed", "doc_id").select("seed", "doc_id").collect() for _ in range(2)]
    assert again[0] == again[1] and len(again[0]) == 12


def test_pooling(spark):
    df = spark.createDataFrame([("a", 0, [0.0, 0.0]), ("a", 1, [1.0, 0.0]), ("a", 2, [5.0, 0.0])], "doc_id string, chunk_id int, vector array<double>")
    assert pooling.mean_vectors(df, ["doc_id"]).first()["vector"] == [2.0, 0.0]
    assert pooling.medoid_vectors(df).first()["vector"] == [1.0, 0.0]


def test_records(spark):
    r = spark.createDataFrame([("7", "d", "t", "u", None, True, [("A",), (None,), ("B",)], [("1", "x"), ("2", "x"), ("9", None)], [("f",)])], "mayaReportId string, publicationDate string, title string, url string, isPriorityReport boolean, isCorrection boolean, issuer array<struct<issuerName:string>>, events array<struct<eventId:string,eventName:string>>, attachedfiles array<struct<url:string>>")
    assert records.flattened(r).first()["issuers"] == "A, , B"
    rows = records.by_issuer(r).orderBy("issuerName").collect()
    assert [x["issuerName"] for x in rows] == ["A", "B"] and rows[0]["events"]["x"]["eventId"] == "2" and rows[0]["isPriority"] is False
    assert records.disclosures_v1(r).count() == 0 and records.disclosures_v1(r, 5).count() == 1
    ids = spark.createDataFrame([("5",), (None,), ("x",)], "i string")
    assert [ids.where(records.id_above(F.col("i"), 0, **k)).count() for k in ({}, {"null_passes": True}, {"null_as": 0})] == [1, 2, 1]


def test_keyed_writes(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), ("c", None, 1)], "k string, v int, s int")
    assert sorted(writers.upserted(t, new, ["k"], "s").collect(), key=lambda r: r["k"]) == [("a", 6), ("b", 2), ("c", None)]
    assert sorted(writers.updated(t, spark.createDataFrame([("a", None)], "k string, v int"), ["k"], ["v"]).collect()) == [("a", 1), ("b", 2)]
    assert writers.purged(t, F.lit(None).cast("boolean")).count() == 2


def test_taxonomies(spark):
    for j in ('{"final_categories": {"c": {"document_ids": ["1", "2"]}}, "provisional_candidate_groups": {"p": {"document_ids": ["2"]}}}', '[{"cluster_id": "c", "document_ids": ["1"]}, {"cluster_id": "p", "document_ids": ["2"]}]', '{"c": {"doc_ids": ["1"]}, "p": {"document_ids": ["2"]}}'):
        got = readers.taxonomy(spark.createDataFrame([(j,)], "value string"))
        assert sorted(map(tuple, got.collect())) == [("c", "1"), ("p", "2")], j


def test_sections(spark):
    starts = spark.createDataFrame([("a", 0), ("b", 5)], "section string, start int")
    items = spark.createDataFrame([(0,), (4,), (5,), (9,), (10,)], "page int")
    got = {r["page"]: r["section"] for r in records.in_sections(items, records.sections(starts, 9)).collect()}
    assert got == {0: "a", 4: "a", 5: "b", 9: "b"}
    starts = spark.createDataFrame([("x", "a", 0), ("x", "b", 5), ("y", "c", 2)], "doc string, section string, start int")
    items = spark.createDataFrame([("x", 3), ("y", 3), ("y", 1), ("z", 3)], "doc string, page int")
    got = records.in_sections(items, records.sections(starts, 9, ["doc"]), key=["doc"], keep_outside=True).collect()
    assert {(r["doc"], r["page"]): r["section"] for r in got} == {("x", 3): "a", ("y", 3): "c", ("y", 1): None, ("z", 3): None}


def test_rest_source(spark):
    assert rest.date_urls("http://x/", "2022-01-31", 2) == [("2022-01-31", "http://x/2022/1/31"), ("2022-02-01", "http://x/2022/2/1")]


def test_model_shell(spark):
    waits = []
    state = {"n": 0}

    def flaky(_):
        state["n"] += 1
        if state["n"] < 3:
            raise RuntimeError('{"retryDelay": "4s"}')
        return "ok"

    assert assist.retried(flaky, sleep=waits.append)("p") == "ok" and waits == [5, 5]
    with pytest.raises(assist.QuotaEnded):
        assist.retried(lambda _: (_ for _ in ()).throw(RuntimeError("PerDay")))("p")
    docs = spark.createDataFrame([("1", "h", "text one"), ("2", "x", "text two")], "doc_id string, category_handle string, text string")
    prompts = spark.createDataFrame([("h", "do")], "handle string, prompt_text string")
    assert [r["raw_response"] for r in assist.summaries(docs, prompts).collect()] == ["text one"]
    new, changed = assist.updated_prompts(prompts, spark.createDataFrame([("h", " do ")], "handle string, prompt_text string"))
    assert not changed and new.first()["prompt_text"] == "do"
    got = assist.incremental_clusters([("1", "a"), ("2", "b")], lambda p: "0" if "b" in p.split("|")[1] else 'NEW_CLUSTER: "T"', "{clusters}|{excerpt}")
    assert got == [{"cluster_id": 0, "title": "T", "examples": ["1", "b"], "document_ids": ["1", "2"]}]


def test_statistics(spark):
    df = spark.createDataFrame([("f", 1, 1000), ("f", None, None), ("g", 2, 2048)], "k string, c int, s int")
    assert [tuple(r) for r in stats.report_stats(df, ["k"], F.col("c"), F.col("s")).collect()] == [("f", 2, "0.5", "0.488"), ("g", 1, "2", "2")]


def test_hashed_embeddings_hash_a_text_once(spark):
    import math
    from collections import Counter

    from disclore.operators import pooling

    texts = ["One two, two", "", "é a_b 1 1 1"]
    got = pooling.hashed_embeddings(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 8)
    assert "transform(array(transform(filter(split(" in got._jdf.queryExecution().analyzed().toString().lower()
    for r in got.collect():
        words = {"One two, two": ["one", "two", "two"], "": [], "é a_b 1 1 1": ["é", "a_b", "1", "1", "1"]}[r["text"]]
        slot = {w: spark.sql(f"select pmod(xxhash64('{w}'), 8L) as s").first()["s"] for w in set(words)}
        n = Counter(slot[w] for w in words)
        size = math.sqrt(sum(x * x for x in n.values())) or 1
        assert r["vector"] == [n[i] / size for i in range(8)]
