"""Connected components of links between documents, as joins and aggregations; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Links that a task may handle: a small graph doesn't need a task for each shuffle partition.
TASK_LINKS = 200_000


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of links (a, b) reaches, itself included.

    Alternating stars: every node hands its larger neighbours to its smallest one (large star), then its smaller ones (small star), until the links
    don't change; they then all lead to the smallest node. Each half is a table, so lineage stays short. A node with very many links is
    combined ahead of its aggregation, and its join has two plain inputs that adaptive execution can split.
    """
    a, b = F.col("a"), F.col("b")
    edges = common.materialize(links.filter("a <> b").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    tasks, state = edges.count() // TASK_LINKS + 1, None
    kept = lambda df, name: common.materialize(df.coalesce(tasks), name)
    while True:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = kept(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "stars")
        edges = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        edges = kept(edges, "links")
        least = kept(edges.groupBy("b").agg(F.min("a").alias("m")), "stars")
        joined = edges.join(least, "b")
        edges = joined.select(F.col("m").alias("a"), "b").unionByName(joined.select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
        edges = kept(edges, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(b.alias("node"), a.alias("component")).unionByName(edges.select(a.alias("node"), a.alias("component")).distinct())
