"""Running totals, look-ups by order, order statistics and hash ranks that no single task has to hold a whole group for.

Rows are sorted across tasks by group and order, so a category with a third of all rows, whatever its values, is spread over as many tasks as its rows need.
Tasks are summed by group (a few rows), and rows are accumulated within a group and task only. Up to FEW rows in all, counted, are ranked in one window instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize


#: Rows that one window may rank: what is counted may be one group.
FEW = 100_000


def range_sorted(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """rows as a table sorted by order across tasks, with _at, which grows along the order, and _task (its upper bits)."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return materialize(placed.withColumn("_task", F.shiftright("_at", 33).cast("int")), name)


def running_totals(rows: DataFrame, by: Sequence[str], order: str | Sequence[str], values: Sequence[str], stored: bool = False) -> DataFrame:
    """rows with <value>_before: sums over the rows of the group that come earlier. order is unique within a group; groups (by) must not be null. stored: rows are columns of a written table."""
    order, rows = [order] if isinstance(order, str) else list(order), rows if stored else materialize(rows, "running")
    if rows.count() <= FEW:
        earlier = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return rows.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(earlier), F.lit(0)) for v in values})
    placed = range_sorted(rows, [*by, *order], "running-sorted")
    before_task = W.partitionBy(*by).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy(*by, "_task").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    starts = starts.select(*by, "_task", *[F.coalesce(F.sum(f"_{v}").over(before_task), F.lit(0)).alias(f"_{v}") for v in values])
    within = W.partitionBy(*by, "_task").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values}).join(starts, [*by, "_task"])
    return summed.withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"_{v}") for v in values}).drop("_task", "_at", *[f"_{v}" for v in values])


def looked_up(asked: DataFrame, rows: DataFrame, by: Sequence[str], key: str, value: str, name: str) -> DataFrame:
    """asked (by, key, ...) with `name`: the value of the last of rows (by, key, value) of the group whose key isn't greater; null if there is none, and for a null key.

    Both are sorted together across tasks by group and key, and each task hands its last row of a group on to those behind it: linear in the rows of both, wherever these are.
    """
    kind = asked.schema[key].dataType
    one = asked.withColumns({"_ask": F.lit(1), "_v": F.lit(None).cast(rows.schema[value].dataType)})
    other = rows.select(*by, F.col(key).cast(kind).alias(key), F.lit(0).alias("_ask"), F.col(value).alias("_v"))
    both = one.unionByName(other, allowMissingColumns=True)
    both = materialize(both, "look-ups")
    if both.count() <= FEW:
        upto = W.partitionBy(*by).orderBy(F.col(key).asc_nulls_first(), "_ask").rowsBetween(W.unboundedPreceding, W.currentRow)
        found = both.withColumn(name, F.last("_v", ignorenulls=True).over(upto))
    else:
        placed = range_sorted(both, [*by, key, "_ask"], "look-ups-sorted")
        upto = W.partitionBy(*by, "_task").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
        last = placed.filter("_ask = 0").groupBy(*by, "_task").agg(F.max_by("_v", "_at").alias("_v"))
        # A task may have rows of a group without any that can be found.
        ends = placed.select(*by, "_task").distinct().join(last, [*by, "_task"], "left")
        handed = ends.select(*by, "_task", F.last("_v", ignorenulls=True).over(W.partitionBy(*by).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)).alias("_handed"))
        found = placed.withColumn(name, F.last("_v", ignorenulls=True).over(upto)).join(handed, [*by, "_task"]).withColumn(name, F.coalesce(name, "_handed")).drop("_handed", "_task", "_at")
    return found.filter("_ask = 1").withColumn(name, F.when(F.col(key).isNotNull(), F.col(name))).drop("_ask", "_v").select(*asked.columns, name)


def hash_rank(rows: DataFrame, by: Sequence[str], rank_hex: str, ties: Sequence[str] = ()) -> DataFrame:
    """rows with rank, 0 for the first by a hexadecimal digest, then by ties."""
    out = running_totals(rows.withColumn("_one", F.lit(1).cast("long")), by, [rank_hex, *ties], ["_one"])
    return out.withColumn("rank", F.col("_one_before")).drop("_one", "_one_before")


def positions(n: Column) -> dict[str, tuple[Column, Column, Column]]:
    """For each definition of a quantile: lower and upper position (0-based) and the weight of the upper.

    p95: nearest rank; upper_median: sorted[n // 2]; median, q05 and q95: linear between neighbours. They differ on purpose.
    """
    rank = F.greatest(F.ceil(n * F.lit(0.95)) - 1, F.lit(0))
    return {"p95": (rank, rank, F.lit(0.0)), "upper_median": (F.floor(n / 2), F.floor(n / 2), F.lit(0.0)), "median": linear(n, 0.5), "q05": linear(n, 0.05), "q95": linear(n, 0.95)}


def linear(n: Column, share: float) -> tuple[Column, Column, Column]:
    """As positions(), of any share."""
    whole = F.floor((n - 1) * F.lit(share))
    return whole, F.least(whole + 1, n - 1), (n - 1) * F.lit(share) - whole


def value_counts(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, _n) of values that aren't null."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))


def order_statistics(rows: DataFrame, by: Sequence[str], value: str, wanted: Mapping[str, str | float]) -> DataFrame:
    """One row for each group: by, n, and each wanted name's quantile (a key of positions(), or a share: linear between neighbours), exact; nulls aren't counted."""
    return quantiles_of_counts(value_counts(rows, by, value), by, value, wanted)


def quantiles_of_counts(counts: DataFrame, by: Sequence[str], value: str, wanted: Mapping[str, str | float], stored: bool = False) -> DataFrame:
    """As order_statistics, of rows (by, value, _n); stored: they are columns of a written table."""
    counts = running_totals(counts, by, value, ["_n"], stored)
    placed = counts.join(counts.groupBy(*by).agg(F.sum("_n").alias("n")), list(by))
    spots = positions(F.col("n"))
    here = lambda at: (F.col("_n_before") <= at) & (at < F.col("_n_before") + F.col("_n"))
    found = []
    for name, kind in wanted.items():
        low, high, weight = spots[kind] if isinstance(kind, str) else linear(F.col("n"), kind)
        a, b = F.max(F.when(here(low), F.col(value))), F.max(F.when(here(high), F.col(value)))
        found.append((a + (b - a) * F.max(weight)).alias(name) if kind not in ("p95", "upper_median") else a.alias(name))
    return placed.groupBy(*by).agg(F.max("n").alias("n"), *found)
