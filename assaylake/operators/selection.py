"""Gates and choice of a configuration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_CHOICE = "NO_ELIGIBLE_CONFIGURATION"
LOCKED = "RESEARCH_CONFIGURATION_LOCKED"

#: Objectives: aggregates over a candidate's categories, least first in this order, then the smallest id.
NORMAL = (("worst_paired_p95", "max", "paired_p95"), ("worst_threshold", "max", "threshold"), ("mean_threshold", "avg", "threshold"))
FRESH = (("worst_above_rate", "max", "above_rate"), ("mean_above_rate", "avg", "above_rate"), ("worst_p95_excess", "max", "p95_minus_threshold"), ("mean_p95_excess", "avg", "p95_minus_threshold"))
SUCCESSOR = (("worst_maximum_excess", "max", "maximum_minus_threshold"), ("worst_above_rate", "max", "above_rate"), ("mean_p95_excess", "avg", "p95_minus_threshold"))


def reasons(checks: Sequence[tuple[str, Column]]) -> Column:
    """Names of all checks that fail, in their order; a null check fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]))


def first_failure(checks: Sequence[tuple[str, Column]]) -> Column:
    """The first check that fails, null if none does; later ones don't count."""
    return F.get(reasons(checks), F.lit(0))


def gate_reasons(metrics: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """metrics with reasons, category.metric for each metric above its limit, in the order of limits; equal is within."""
    return metrics.withColumn("reasons", F.array_compact(F.array(*[F.when(~F.coalesce(F.col(m) <= F.lit(limit), F.lit(False)), F.concat_ws(".", "category", F.lit(m))) for m, limit in limits.items()])))


def evaluate(metrics: DataFrame, limits: Mapping[str, float], objective: Sequence[tuple[str, str, str]], candidate: str = "candidate_id") -> DataFrame:
    """One row for each candidate: passed, reasons in order of category, and the values of the objective."""
    gated = gate_reasons(metrics, limits)
    values = [getattr(F, how)(column).alias(name) for name, how, column in objective]
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("category", "reasons"))), lambda s: s["reasons"]))
    return gated.groupBy(candidate).agg(listed.alias("reasons"), *values).withColumn("passed", F.size("reasons") == 0)


def choose(evaluations: DataFrame, objective: Sequence[tuple[str, str, str]], candidate: str = "candidate_id") -> DataFrame:
    """One row: state and selected, the passed candidate of the least objective; null if none passed."""
    least = F.min(F.when(F.col("passed"), F.struct(*[name for name, _, _ in objective], candidate)))[candidate]
    return evaluations.agg(least.alias("selected")).select(F.when(F.col("selected").isNull(), NO_CHOICE).otherwise(LOCKED).alias("state"), "selected")


def summaries_differ(stated: DataFrame, derived: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Rows of a stated summary that its detail rows don't give again: (keys, column, stated, derived)."""
    both = stated.select(*keys, F.struct(*values).alias("s")).join(derived.select(*keys, F.struct(*values).alias("d")), list(keys), "full_outer")
    cells = both.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("column"), F.col(f"s.{v}").cast("double").alias("stated"), F.col(f"d.{v}").cast("double").alias("derived")) for v in values])).alias("c")).select(*keys, "c.*")
    return cells.filter(~F.coalesce(F.abs(F.col("stated") - F.col("derived")) <= tolerance, F.col("stated").isNull() & F.col("derived").isNull()))
