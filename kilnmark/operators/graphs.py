"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import removed, stored_at
from . import spread


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component of links (a, b); only nodes that have a link.

    Rounds of taking the smallest label around and following it once more: labels fall with every round and double
    their reach, so the rounds end. Every round writes to the shared folder and drops the table before the last. Nodes
    with very many links, and labels that very many nodes share, are dealt out over tasks. Null ends are left out."""
    links = links.select("a", "b").filter("a is not null and b is not null")
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # Tables rather than checkpoints, which would carry what the optimiser knows of their columns from round to round.
    spark = links.sparkSession
    both, links_at = stored_at(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    large = both.count() > spread.HEAVY
    hubs = spread.crowded(both, "b") if large else None
    label, at = stored_at(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        named = label.select(F.col("node").alias("b"), "root")
        near = spread.spread_join(both, named, "b", keys=hubs, rows=0)
        seen = near.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(seen, "node").select("node", "root", F.least("root", "near").alias("new"))
        far = label.select(F.col("node").alias("new"), F.col("root").alias("far"))
        # A label that many nodes share already is the one that many will follow.
        shared = spread.crowded(label, "root") if large else None
        jumped = spread.spread_join(step, far, "new", keys=shared, rows=0)
        nxt, new_at = stored_at(jumped.select("node", F.least("new", "far").alias("root"), (F.least("new", "far") < F.col("root")).alias("moved")), "labels")
        done = nxt.filter("moved").isEmpty()
        removed(spark, at)
        label, at = nxt.select("node", "root"), new_at
        if done:
            removed(spark, links_at)
            return label
