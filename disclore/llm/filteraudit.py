"""How filters interact: what each removes in every order, from one CUBE over their failure flags.

A filter that runs late finds only what the earlier ones left, so its removals say little about it. All orders
follow from the survivors of each *set* of filters: a step that applies filter ``f`` after the set ``S`` removes
survivors(S) - survivors(S + f). ``survivors`` reads them off a CUBE over the failure flags and the part: the
grouping set of the flags in S, in its row where all of them are false, counts the rows that no filter of S
removes. ``audit`` joins, for each part, order and step, the two subsets around the step.

Rows are aggregated to cells (part, flags) before the cube, so that it expands 2 ** flags rows a part and never the
documents; a part that holds most documents costs a task no more than one row per cell.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_names, written

WORD_GAP = "[\\x20\\x09-\\x0D]+"


def document_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row a document: doc_id, part, and whether it fails A (under 50 words), B (100 * distinct words < 65 * words),
    C (100 * [A-Z] characters > 5 * code points), D (holds one of ``#$%&*|``), E (a smaller doc_id has its text).

    A null text counts as empty (fails A), a null part as ''. Rows that repeat the least doc_id of a text pass E all; a
    null doc_id is larger than none, so it passes E. An empty table gives no row; other columns are not read.
    Texts leave the scan as hashes: equal texts are told by SHA-256, and the first of each is found by the pair (hash,
    doc_id), which no group of copies can make hot.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    slim = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.filter(F.split("text", WORD_GAP, -1), lambda w: w != "")
    slim = slim.withColumn("n", F.size(words)).withColumn("d", F.size(F.array_distinct(words)))
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    flags = {"A": F.col("n") < 50, "B": 100 * F.col("d") < 65 * F.col("n"), "C": 100 * capitals > 5 * F.length("text"), "D": F.col("text").rlike("[#$%&*|]")}
    rows = written(slim.select("doc_id", "part", *[c.alias(k) for k, c in flags.items()], F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key")), "flags")
    first = rows.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    return rows.join(first, ["key", "doc_id"], "left").select("doc_id", "part", *flags, (F.col("doc_id").isNotNull() & F.col("is_first").isNull()).alias("E"))


def survivors(df: DataFrame, flags: list[str], part: str, counts: dict[str, Column]) -> DataFrame:
    """(part, mask, counts...): for every part and every set of flags (bit i of ``mask``: the i-th flag), the sums of
    ``counts`` over the rows where no flag of the set is true; sets without survivors have zeros.

    Null flags count as false. An empty table gives no row. Names of ``df`` other than those given do not matter.
    """
    names = free_names(["_all", "_sets"], [part, *flags, *counts])
    clean = df.select(df[part].alias(part), *[F.coalesce(df[f].cast("boolean"), F.lit(False)).alias(f) for f in flags], *[c.cast("long").alias(k) for k, c in counts.items()])
    cells = clean.groupBy(part, *flags).agg(*[F.sum(k).alias(k) for k in counts])
    cube = cells.cube(*flags, part).agg(F.grouping(part).alias(names[0]), *[F.grouping(f).alias(f"_g{i}") for i, f in enumerate(flags)], *[F.sum(k).alias(k) for k in counts])
    alive = F.col(names[0]) == 0
    mask = F.lit(0)
    for i, f in enumerate(flags):
        alive &= (F.col(f"_g{i}") == 1) | ~F.col(f)
        mask = mask + F.when(F.col(f"_g{i}") == 0, 1 << i).otherwise(0)
    found = cube.where(alive).select(part, mask.cast("int").alias("mask"), *counts)
    parts = cells.select(part).distinct()
    every = parts.select(part, F.explode(F.sequence(F.lit(0), F.lit((1 << len(flags)) - 1))).alias("mask"))
    return every.join(found, [part, "mask"], "left").select(part, "mask", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in counts])


def audit(df: DataFrame, flags: list[str], part: str, counts: dict[str, Column]) -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, ``<count>_lost`` for
    every further count, shapley.

    ``counts`` has the number of rows first (``F.lit(1)`` for rows that are documents). ``filter_order`` joins the flags'
    names; ``step`` counts from 1. redundant: fails this filter and was removed earlier; unique_fails: fails this
    filter alone; shapley: the filter's removals, summed over all orders.
    """
    n, *others = counts
    table = written(survivors(df, flags, part, counts), "survivors")
    full = (1 << len(flags)) - 1
    steps = []
    for order in permutations(range(len(flags))):
        before = 0
        for k, f in enumerate(order):
            steps.append((("".join(flags[i] for i in order)), k + 1, 1 << f, before, before | 1 << f))
            before |= 1 << f
    steps = df.sparkSession.createDataFrame(steps, "filter_order string, step int, bit int, mask int, after int")  # a constant of the flags
    pair = lambda name: table.select(F.col(part), F.col("mask").alias(name), *[F.col(k).alias(f"{k}_{name}") for k in counts])
    # pairs of subsets around a step: every set with every one of its filters that is not in it yet
    links = table.select(part, "mask", *[F.col(k).alias(f"{k}_mask") for k in counts]).withColumn("bit", F.explode(F.array(*[F.lit(1 << i) for i in range(len(flags))])))
    links = links.where(F.col("mask").bitwiseAND(F.col("bit")) == 0).withColumn("after", F.col("mask") + F.col("bit"))
    links = links.join(pair("after"), [part, "after"])
    alone = table.where("mask = 0").select(part, F.col(n).alias("_all"))
    one = table.select(part, F.col("mask").alias("bit"), F.col(n).alias("_one"))
    rest = table.select(part, (F.lit(full) - F.col("mask")).alias("bit"), F.col(n).alias("_rest"))
    none = table.where(F.col("mask") == full).select(part, F.col(n).alias("_none"))
    links = links.join(alone, part).join(none, part).join(one, [part, "bit"]).join(rest, [part, "bit"])
    removed = F.col(f"{n}_mask") - F.col(f"{n}_after")
    links = links.select(
        part, "mask", "after", "bit", F.col(f"{n}_after").alias("kept"), removed.alias("removed"), (F.col("_all") - F.col("_one") - removed).alias("redundant"),
        (F.col("_rest") - F.col("_none")).alias("unique_fails"), *[(F.col(f"{k}_mask") - F.col(f"{k}_after")).alias(f"{k}_lost") for k in others],
    )
    rows = links.join(F.broadcast(steps), ["mask", "after", "bit"])
    rows = written(rows.select(part, "filter_order", "step", "bit", "kept", "removed", "redundant", "unique_fails", *[f"{k}_lost" for k in others]), "steps")
    discard(table)
    total = rows.groupBy(part, "bit").agg(F.sum("removed").alias("shapley"))
    return rows.join(total, [part, "bit"]).drop("bit")


def labelled_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``document_flags`` by part, with the documents that ``labels`` call good (quality 1) or toxic (1) among
    the removed ones.

    Labels are joined by doc_id; of several rows for one doc_id, any that says 1 counts; documents without labels, or with
    null ones, count as neither.
    """
    flags = document_flags(docs)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    rows = flags.join(marks, "doc_id", "left")
    counts = {"n": F.lit(1), "good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("bad", F.lit(0))}
    return audit(rows, ["A", "B", "C", "D", "E"], "part", counts)
