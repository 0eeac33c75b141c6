"""Connected components of an edge table, with all state in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaledger.session import write_stage


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of (a, b); comp is the smallest node of its component.

    Each round takes the smallest label among a node's neighbours and then that
    label's own label, so long chains close in a logarithmic number of rounds.
    Minima are pre-aggregated: a hub's many edges do not meet in one task.
    """
    both = write_stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = write_stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")))
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("comp").alias("near"))
        near = both.join(of_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        low = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("comp").alias("up"))
        new = write_stage(low.join(up, "low").select("node", "was", F.least("low", "up").alias("comp")))
        labels = new.select("node", "comp")
        if new.filter("was <> comp").limit(1).count() == 0:
            return labels
