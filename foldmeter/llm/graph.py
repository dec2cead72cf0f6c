"""Connected components of a link table, by joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmeter.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long) to (node, root): the smallest node of each component.

    Every node keeps a label.  In a round both ends of an edge, and the nodes that are their labels, take the smallest label
    seen; then labels are replaced by their own labels.  All rounds only join tables and take grouped minima, which combine
    before the shuffle, so a node with very many links is no hot key.  Ends after a number of rounds that grows with the
    logarithm of the longest chain.
    """
    edges = cut_lineage(edges.select("u", "v").filter("u <> v").distinct())
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = cut_lineage(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        lu = labels.select(F.col("node").alias("u"), F.col("root").alias("lu"))
        lv = labels.select(F.col("node").alias("v"), F.col("root").alias("lv"))
        seen = edges.join(lu, "u").join(lv, "v").filter("lu <> lv")
        low, pairs = F.least("lu", "lv"), F.array("u", "v", "lu", "lv")
        told = seen.select(F.explode(pairs).alias("node"), low.alias("root")).distinct()
        told = cut_lineage(labels.unionByName(told).groupBy("node").agg(F.min("root").alias("root")))
        above = told.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = cut_lineage(told.join(above, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
        if seen.limit(1).count() == 0 and new.filter("moved").limit(1).count() == 0:
            return new.drop("moved")
        labels = new.drop("moved")
