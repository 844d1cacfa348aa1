"""Connected components of a graph by repeated joins: labels spread to neighbours and are shortened by looking up labels' labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.sources.stage import stored

#: Labels reach any node in a number of rounds that grows with the logarithm of a component's breadth.
MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node it hangs together with) of every node of the edges (a, b); order and repeats don't count.

    Each round is written to the shared folder and costs two joins on the edges' scale; the least label of a node's neighbours
    is a partial aggregate, so that a node with many edges isn't collected anywhere. No edges give no row.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        # a root that hears of a lesser label hooks itself to it, then everyone follows its root's label
        told = labels.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "near").alias("least"))
        hooked = stored(told.select(F.col("root").alias("node"), F.col("least").alias("root")).union(told.select("node", F.col("least").alias("root"))).groupBy("node").agg(F.min("root").alias("root")), "labels")
        ahead = hooked.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        new = stored(hooked.join(ahead, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "labels")
        changed = new.join(labels.withColumnRenamed("root", "before"), "node").where("root <> before")
        if changed.isEmpty():
            return new
        labels = new
    raise RuntimeError("components didn't settle")
