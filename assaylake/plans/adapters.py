"""Cases, scores and events from the star-schema tables, as stand-ins for the tables that the operators are made for.

Features and scores are written once a query and read by all that follows, as they cost far more than any metric on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import rank_hex
from ..functions.vectors import patches
from ..operators.cohort import roles_by_share
from ..operators.scoring import nearest, patch_rows
from ..sources.scratch import materialize

SHARES = {"FIT": 4, "THRESHOLD_TUNING": 3, "BLIND": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as cases of their label's category, with roles by hash order; a third of the blind ones count as anomalies."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("category"), F.col("vec_id").alias("case_id"), "embedding")
    ranked = rows.withColumn("rank_hex", rank_hex(F.lit("case"), F.col("category"), F.col("case_id"), separator="|"))
    out = roles_by_share(ranked, ["category"], "rank_hex", ["case_id"], SHARES)
    out = out.withColumn("kind", F.when((F.col("role") == "BLIND") & (F.col("case_id") % 3 == 0), "ANOMALY").otherwise("NOMINAL"))
    return materialize(out.drop("rank_hex"), "cases")


def scored(all_cases: DataFrame, bank: DataFrame) -> DataFrame:
    """Cases outside of FIT with their distance to the bank, to 6 digits."""
    queries = all_cases.filter("role <> 'FIT'")
    near = nearest(queries, bank, "category", "case_id", "embedding").select("case_id", F.round("distance", 6).alias("score"))
    rows = queries.select("category", "case_id", "role", "kind").join(near, "case_id").select("category", "case_id", "role", "kind", "score")
    return materialize(rows, "scores")


def knn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir)
    return scored(rows, rows.filter("role = 'FIT'"))


def patch_cases(rows: DataFrame) -> DataFrame:
    """64 numbers as 16 patches of 4."""
    return patch_rows(rows.withColumn("patches", patches(F.col("embedding"), 4)), "category", "case_id", "patches")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as derived cases of their orders."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    delta = F.round(F.col("l_extendedprice") / 1000 - F.col("o_totalprice") / 10000, 6)
    return rows.select(F.col("o_orderpriority").alias("category"), F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("variant"), F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("level"), delta.alias("delta"), (F.col("l_extendedprice") > 50000).alias("above"))
