"""Paired differences between derived cases and their parents, and between two reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .cohort import strict_join
from .metrics import auroc, rate
from .running import order_statistics, positions, running_totals

#: Buckets of values by which a quantile is looked for.
BUCKETS = 1 << 10


def paired(children: DataFrame, parents: DataFrame, parent_of: str, case: str, score: str = "score") -> DataFrame:
    """children with parent_score and delta (child less parent); a child without a parent fails the query."""
    known = parents.select(F.col(case).alias(parent_of), F.col(score).alias("parent_score"), F.lit(True).alias("_found"))
    joined = children.join(known, parent_of, "left")
    orphan = F.raise_error(F.concat(F.lit("PARENT_MISSING "), F.col(parent_of).cast("string")))
    return joined.withColumn("delta", F.when(F.col("_found"), F.col(score) - F.col("parent_score")).otherwise(orphan)).drop("_found")


def delta_quantiles(rows: DataFrame, grains: Sequence[Sequence[str]], columns: Sequence[str]) -> DataFrame:
    """(columns, grain, n, p95, max) of delta at every grain; columns outside of a grain are null.

    Rows are counted in BUCKETS of equal width, and only the counts are taken at each grain. They tell the bucket that has a group's quantile; the values of that bucket alone are counted and ranked.
    """
    known = materialize(rows.filter("delta is not null").select(*columns, "delta"), "deltas")
    x = F.col("delta").cast("double")
    finite = F.when(F.abs(x) < float("inf"), x)
    low, high = known.agg(F.min(finite), F.max(finite)).first()
    low, width = (0.0, 1.0) if low is None or not high > low else (low, (high - low) / BUCKETS)
    # Buckets grow with the values, infinite ones and NaN included; no more is asked of them.
    bucket = F.when(F.isnan(x), BUCKETS - 1).otherwise(F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor((x - low) / width)))).cast("int")
    placed = known.withColumn("_bucket", bucket)
    counts = placed.groupBy(*columns, "_bucket").agg(F.count("*").alias("_n"), F.max("delta").alias("max"))
    sets = counts.groupingSets([[*g, "_bucket"] for g in grains], *columns, "_bucket").agg(F.sum("_n").alias("_n"), F.max("max").alias("max"), *[F.grouping(c).alias(f"_out{i}") for i, c in enumerate(columns)])
    named = [F.when(F.col(f"_out{i}") == 0, F.lit(c)) for i, c in enumerate(columns)]
    grain = F.array_join(F.array_compact(F.array(*named)), ",")
    # Nulls of a grain are equal: the group's key is its text.
    key = F.concat_ws("\0", F.col("grain"), *[F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in columns])
    keyed = materialize(sets.withColumn("grain", F.when(grain == "", "all").otherwise(grain)).withColumn("_key", key), "delta-counts")
    whole, upto = W.partitionBy("_key"), W.partitionBy("_key").orderBy("_bucket")
    ranked = keyed.withColumns({"n": F.sum("_n").over(whole), "max": F.max("max").over(whole), "_upto": F.sum("_n").over(upto)}).withColumn("_rank", positions(F.col("n"))["p95"][0])
    at = ranked.filter((F.col("_upto") - F.col("_n") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto")))
    at = materialize(at.select("_key", "grain", *columns, "_bucket", "n", "max", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_left")), "delta-places")
    held = None
    for g in grains:
        own = at.filter(F.col("grain") == (",".join(c for c in columns if c in g) or "all")).select("_key", F.col("_bucket").alias("_b"), *[F.col(c).alias(f"_{c}") for c in g])
        same = F.col("_bucket") == F.col("_b")
        for c in g:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        part = placed.join(own, same).groupBy("_key", "delta").agg(F.count("*").alias("_n"))
        held = part if held is None else held.unionByName(part)
    told = running_totals(held, ["_key"], "delta", ["_n"]).join(at.select("_key", "_left"), "_key")
    told = told.filter((F.col("_n_before") <= F.col("_left")) & (F.col("_left") < F.col("_n_before") + F.col("_n"))).select("_key", F.col("delta").alias("p95"))
    return at.join(told, "_key").select(*columns, "grain", "n", "p95", "max")


def delta_summary(rows: DataFrame, by: Sequence[str], value: str = "delta") -> DataFrame:
    """n, mean, median (between neighbours), min, max, and counts and share by sign."""
    x = F.col(value)
    sums = rows.groupBy(*by).agg(
        F.count(x).alias("pairs"), F.avg(x).alias("mean"), F.min(x).alias("minimum"), F.max(x).alias("maximum"),
        F.count_if(x > 0).alias("positive"), F.count_if(x == 0).alias("zero"), F.count_if(x < 0).alias("negative"), rate(x > 0).alias("positive_rate"),
    )
    return sums.join(order_statistics(rows, by, value, {"median": "median"}).drop("n"), list(by))


def multi_grain(stimuli: DataFrame, raw: DataFrame, by: str, family: str, level: str) -> DataFrame:
    """Responses of stimuli (by, family, level, above, delta) in every cell of family and level and over all, next to those of the raw cases (by, above).

    Raw cases repeat in every cell, so they are counted once a category and joined.
    """
    cells = stimuli.cube(family, level, by).agg(
        F.grouping_id().alias("_id"), F.count("*").alias("stimuli"), F.count_if("above").alias("stimuli_above"), F.avg("delta").alias("mean_delta"), F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"),
        F.count_if(F.col("delta") > 0).alias("positive"), F.count_if(F.col("delta") == 0).alias("zero"),
    ).filter(F.col("_id") % 2 == 0)
    counts = raw.groupBy(by).agg(F.count("*").alias("raw"), F.count_if("above").alias("raw_above"))
    out = cells.join(counts, by)
    return out.select(by, family, level, "stimuli", "stimuli_above", F.try_divide("stimuli_above", "stimuli").alias("stimuli_rate"), "raw", "raw_above", F.try_divide("raw_above", "raw").alias("raw_rate"), "mean_delta", "min_delta", "max_delta", "positive", "zero")


def contrasts(parents: DataFrame, controls: DataFrame, stimuli: DataFrame, parent: str, score: str = "score") -> DataFrame:
    """For each parent: mean differences of its controls and of its stimuli, and stimulus less control. Both sides are aggregated before they meet, so they don't multiply."""
    base = parents.select(parent, F.col(score).alias("parent_score"))
    mean = lambda rows, name: rows.join(base, parent).groupBy(parent).agg(F.count("*").alias(f"{name}_count"), F.avg(F.col(score) - F.col("parent_score")).alias(f"{name}_delta"))
    both = mean(controls, "control").join(mean(stimuli, "stimulus"), parent)
    return base.join(both, parent).withColumn("contrast", F.col("stimulus_delta") - F.col("control_delta"))


def contrast_summary(contrasts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of what contrasts gives: parents, mean control and stimulus deltas, and mean, median, least, greatest and signs of the contrast."""
    means = contrasts.groupBy(*by).agg(F.avg("control_delta").alias("mean_control_delta"), F.avg("stimulus_delta").alias("mean_stimulus_delta"))
    return delta_summary(contrasts, by, "contrast").withColumnRenamed("pairs", "parents").join(means, list(by))


def compare_reports(baseline: DataFrame, candidate: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Case deltas, category comparison and blind anomalies by defect, of two reports (case_id, category, role, kind, defect, source_sha256, score) over the same cases."""
    both = strict_join(baseline, candidate, "case_id", ["source_sha256", "category", "kind"])
    cases = both.select("a.case_id", "a.category", "a.role", "a.kind", "a.defect", F.col("a.score").alias("baseline_score"), F.col("b.score").alias("candidate_score"), (F.col("b.score") - F.col("a.score")).alias("delta"))
    cases = materialize(cases, "report-cases")
    blind = cases.filter("role = 'BLIND'")
    tuning = cases.filter("role = 'THRESHOLD_TUNING'").groupBy("category").agg(F.max("baseline_score").alias("baseline_threshold"), F.max("candidate_score").alias("candidate_threshold"))
    positive: Column = F.col("kind") == "ANOMALY"
    curve = lambda c: auroc(blind, ["category"], f"{c}_score", positive).withColumnRenamed("auroc", f"{c}_auroc")
    categories = delta_summary(cases, ["category"]).select("category", F.col("pairs").alias("cases"), "mean", "median").join(tuning, "category", "left").join(curve("baseline"), "category", "left").join(curve("candidate"), "category", "left")
    categories = categories.withColumns({"auroc_delta": F.col("candidate_auroc") - F.col("baseline_auroc"), "threshold_delta": F.col("candidate_threshold") - F.col("baseline_threshold")})
    defects = delta_summary(blind.filter(positive), ["category", "defect"]).select("category", "defect", F.col("pairs").alias("cases"), "mean", "median")
    return cases, categories, defects
