"""Periodic runs against a brute-force version."""

import hashlib
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from disclore.llm import queries, runs  # noqa: E402


def plain_runs(w, least=6, repeats=4):
    """All maximal stretches of each period, the least period of a stretch first."""
    best = {}
    for p in range(1, len(w) // repeats + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, repeats * p):
                best.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in best.items())


def plain_digests(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    found = plain_runs(w)
    dropped = {i for s, k, p in found for i in range(s + p, s + k)}
    top = None
    for r in found:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, sha("".join(f"{s},{k},{p}\n" for s, k, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_runs_of_random_words_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        texts = []
        for _ in range(rng.integers(1, 6)):
            n = int(rng.integers(0, 90))
            w = rng.integers(0, rng.integers(1, 6), n)
            if n > 8 and rng.random() < 0.7:
                a, p = int(rng.integers(0, n)), int(rng.integers(1, 9))
                w = np.array([w[min(n - 1, a + (i - a) % p)] if i >= a else w[i] for i in range(n)])
            texts.append(w)
        for w, got in zip(texts, runs.find_runs(texts)):
            assert plain_runs(w.tolist()) == [tuple(r) for r in got.tolist()]


def test_runs_need_three_repeats_and_a_portion_may_be_split(monkeypatch):
    with pytest.raises(ValueError, match="three"):
        runs.find_runs([], repeats=2)
    monkeypatch.setattr(runs, "GRID_POINTS", 10)
    w = np.array([0, 1, 2] * 9 + [5] * 7)
    assert [tuple(r) for r in runs.find_runs([w], repeats=3)[0].tolist()] == [(0, 27, 3), (27, 7, 1)]


def test_query_equals_brute_force_on_whole_texts(spark, tmp_path):
    rng = np.random.default_rng(4)
    texts = [None, "", " \n\t ", "one", "a " * 5, "a " * 6, "x y " * 40, "é 中\xa0x é 中\xa0x é 中\xa0x é 中\xa0x", "a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb"]
    texts += [" ".join(rng.choice(list("abcd"), int(rng.integers(1, 200)))) for _ in range(120)]
    texts += [" ".join(np.tile(rng.choice(list("abcdefgh"), 50), 30)), "w " * 30_000, " ".join(map(str, rng.integers(0, 9, 4000)))]
    rows = [(i * 3, t, "k") for i, t in enumerate(texts)] + [(3, "b b b b b b b", "k"), (3, "b b b b b b b", "k"), (None, "c c c c c c", None)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op11_runs(spark, str(tmp_path)).collect()]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted((plain_digests(i, t) for i, t, _ in rows), key=key)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, t, _ in rows if i is not None and t and t.split())


def test_operator_keeps_columns_whatever_their_names(spark):
    docs = spark.createDataFrame([(1, "z a b a b a b a b y", "r", 7)], "doc_id long, text string, runs string, n_words int")
    row = runs.periodic_runs(docs, keep=["doc_id", "runs", "n_words"]).first().asDict(recursive=True)
    assert row == {"doc_id": 1, "runs": "r", "n_words": 7, "_n_words": 10, "_runs": [{"start": 1, "length": 8, "period": 2}], "collapsed": "z a b y"}
    assert runs.periodic_runs(docs.limit(0)).collect() == [] and runs.digests(docs.limit(0)).count() == 0
