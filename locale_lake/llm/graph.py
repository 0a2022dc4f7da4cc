"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locale_lake.session import rewritten


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node reachable) for every node that has a link.

    Each round takes the least root of the neighbours and then the root's own root, so
    the rounds grow with the logarithm of the longest path. Every round is
    written; nothing is collected.
    """
    # both directions must come from one evaluation: made anew, links may span otherwise
    one = rewritten(links.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node <> other"))
    both = rewritten(one.unionByName(one.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    roots = both.groupBy("node").agg(F.min("other").alias("root")).select("node", F.least("node", "root").alias("root"))
    roots = rewritten(roots)
    while True:
        near = (
            both.join(roots.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        )
        nearer = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        up = roots.select(F.col("node").alias("new"), F.col("root").alias("up"))
        after = rewritten(nearer.join(up, "new", "left").select("node", "root", F.least("new", "up").alias("new")))
        moved = not after.filter("root <> new").isEmpty()
        roots = after.select("node", F.col("new").alias("root"))
        if not moved:
            return roots
