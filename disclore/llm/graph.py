"""Connected components of a link table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of the links, the smallest node it can reach.

    Each round gives a node the least root among its neighbours' and then its root's root, so that trees
    collapse while they join; rounds grow with the logarithm of the longest path. A hub costs one aggregated
    row per task, never its list of neighbours. Null ends and links to itself are ignored.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    edges = written(pairs.union(pairs.select("b", "a")), "edges")
    roots = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "roots")
    while True:
        seen = edges.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        hooked = written(roots.join(seen, "node").select("node", F.least("root", "m").alias("root"), F.col("root").alias("old")), "hooked")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = written(hooked.join(up, "root").select("node", F.col("top").alias("root"), "old"), "roots")
        changed = jumped.where("root <> old").take(1)
        discard(roots)
        discard(hooked)
        roots = jumped
        if not changed:
            discard(edges)
            out = roots.select("node", "root")
            return out
