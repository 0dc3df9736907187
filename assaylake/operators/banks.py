"""Bounded memory banks of prototypes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .running import hash_rank, running_totals


def evenly_spaced(rows: DataFrame, by: str, order: str, maximum: int) -> DataFrame:
    """rows of each group at positions ((2k + 1) total) // (2 maximum) of its order, k = 0..maximum - 1; all rows of groups within maximum.

    order is a number, unique within its group.
    """
    return evenly_spaced_sizes(rows, by, order, [maximum]).drop("maximum")


def evenly_spaced_sizes(rows: DataFrame, by: str, order: str, maxima: Sequence[int]) -> DataFrame:
    """Banks of several sizes at once: rows with position and maximum, once for each size that takes them.

    A position p is chosen iff some k gives it: the first k that reaches p must not pass it.
    """
    if min(maxima) < 1:
        raise ValueError("maximum must be positive")
    total = rows.groupBy(by).agg(F.count("*").alias("_total"))
    placed = running_totals(rows.withColumn("_one", F.lit(1).cast("long")), [by], order, ["_one"]).join(total, by)
    placed = placed.withColumn("maximum", F.explode(F.array(*[F.lit(m).cast("long") for m in maxima])))
    p, n, most = F.col("_one_before"), F.col("_total"), F.col("maximum")
    k = F.greatest(F.ceil((2 * most * p - n) / (2 * n)).cast("long"), F.lit(0))
    near = F.exists(F.array(k - 1, k, k + 1), lambda x: (x >= 0) & (x < most) & (F.floor(((2 * x + 1) * n) / (2 * most)) == p))
    return placed.filter((n <= most) | near).withColumnsRenamed({"_one_before": "position"}).drop("_one", "_total")


def stratified(rows: DataFrame, stratum: str, rank_hex: str, tie: str, maximum: int) -> DataFrame:
    """The first maximum rows round-robin over strata, each in hash order, with their bank position; a smaller bank is a prefix of a larger one.

    Only rows within the first maximum of their stratum can be chosen, so the final ordering, a top-k, sees at most that many a stratum.
    """
    ranked = hash_rank(rows, [stratum], rank_hex, [tie]).filter(F.col("rank") < maximum)
    chosen = ranked.orderBy("rank", stratum).limit(maximum)
    return chosen.withColumn("position", F.row_number().over(W.orderBy("rank", stratum)) - 1)


def stratified_sizes(rows: DataFrame, by: Sequence[str], stratum: str, rank_hex: str, tie: str, maxima: Sequence[int]) -> DataFrame:
    """Banks of several sizes for each group at once: rows with position and maximum, once for each size that takes them.

    As stratified, within each group: round-robin over its strata, each in hash order. One ranking serves all sizes, as a smaller bank is a prefix of a larger one; strata, and rows of a group, may be in any number of tasks.
    """
    if min(maxima) < 1:
        raise ValueError("maximum must be positive")
    ranked = hash_rank(rows, [*by, stratum], rank_hex, [tie]).filter(F.col("rank") < max(maxima))
    placed = running_totals(ranked.withColumn("_one", F.lit(1).cast("long")), by, ["rank", stratum], ["_one"]).withColumnRenamed("_one_before", "position").drop("_one", "rank")
    sizes = F.filter(F.array(*[F.lit(m).cast("long") for m in maxima]), lambda m: m > F.col("position"))
    return placed.withColumn("maximum", F.explode(sizes))
