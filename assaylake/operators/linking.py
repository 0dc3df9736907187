"""Connected components of links, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of links (a, b) reaches, itself included; nodes may be of any type that Spark orders.

    Each round every node takes the smallest label among its own and its neighbours', then the label of that label; rounds end when nothing changes. Labels jump over
    twice the distance each round, so a chain of n links needs some log n rounds.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("least"))
        met = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("was"), F.least("root", "least").alias("root"))
        # What a root has found out is handed to all that have it: trees hook onto trees.
        hooked = materialize(met, "hooked")
        best = hooked.groupBy(F.col("was").alias("r")).agg(F.min("root").alias("to"))
        step = hooked.join(best, F.col("was") == F.col("r"), "left").select("node", "was", F.least("root", "to").alias("root"))
        jump = step.select(F.col("node").alias("k"), F.col("root").alias("far"))
        now = materialize(step.join(jump, F.col("root") == F.col("k"), "left").select("node", "was", F.least("root", "far").alias("root")), "labels")
        if now.filter("was <> root").isEmpty():
            return now.select("node", "root")
        labels = now.select("node", "root")
