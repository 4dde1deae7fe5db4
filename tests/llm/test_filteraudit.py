"""The interaction audit against a loop over documents and orders."""

import re
from itertools import permutations

import pytest

pytest.importorskip("public_tokenizers")

from disclore.llm import filteraudit  # noqa: E402

DOCS = "doc_id long, text string, source string, A string, key string, part int, n int, mask int"


def plain_audit(docs, labels):
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    marks = {}
    for i, q, x in labels:
        old = marks.get(i, (0, 0))
        marks[i] = (max(old[0], int(q == 1)), max(old[1], int(x == 1)))
    rows = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and t in first and first[t] < i}
        rows.append((s or "", {k for k, v in bad.items() if v}, *(marks.get(i, (0, 0)) if i is not None else (0, 0))))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                before, after = set(order[:k]), set(order[: k + 1])
                gone = [r for r in mine if not r[1] & before and f in r[1]]
                out[part, order, k + 1] = [sum(not r[1] & after for r in mine), len(gone), sum(f in r[1] and bool(r[1] & before) for r in mine), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_a_loop(spark):
    long = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", "short", long, long, long + " #", long.upper(), "a b " * 40, long + " extra", "A B # " * 30, "a\x1cb " * 70, "q " * 20000]
    docs = [(i, t, ["s", "t", None, ""][i % 4]) for i, t in enumerate(texts * 2)] + [(3, long, "u"), (3, long, "u"), (None, long, "u"), (None, "only null ids have this", "u")]
    labels = [(0, 1, 0), (1, 0, 1), (3, 1, 1), (4, None, 1), (5, 1, None), (5, 0, 1), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", "x", 5, 5, 5) for d in docs], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filteraudit.labelled_audit(frame, marks)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(r) for r in got.select(columns).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_audit(docs, labels)
    assert filteraudit.labelled_audit(frame.limit(0), marks).count() == 0
    assert filteraudit.labelled_audit(frame, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_survivors_of_any_flags(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("p", True, False, 2.0), ("p", False, None, 3.0), ("q", True, True, 1.0)], "part string, n boolean, y boolean, mask double")
    got = {(r["part"], r["mask"]): (r["k"], r["w"]) for r in filteraudit.survivors(df, ["n", "y"], "part", {"k": F.lit(1), "w": F.col("mask")}).collect()}
    assert got == {("p", 0): (2, 5), ("p", 1): (1, 3), ("p", 2): (2, 5), ("p", 3): (1, 3), ("q", 0): (1, 1), ("q", 1): (0, 0), ("q", 2): (0, 0), ("q", 3): (0, 0)}
