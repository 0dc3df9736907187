"""Thresholds, summaries and rank metrics of scored cases.

Scored rows have category, case_id, kind (NOMINAL or ANOMALY) and score. A score is above a threshold if it is strictly greater. Rates and metrics
without a denominator are null, never 0. Scores are counted by value before anything is ordered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .running import order_statistics, running_totals


def rate(condition: Column, among: Column | None = None) -> Column:
    """Share of rows that meet condition, among those that meet `among`; null if there are none."""
    among = F.lit(True) if among is None else among
    return F.try_divide(F.count_if(condition & among), F.count_if(among))


def thresholds(tuning: DataFrame, by: str = "category") -> DataFrame:
    """(by, threshold): the greatest tuning score of each category."""
    return tuning.groupBy(by).agg(F.max("score").alias("threshold"))


def auroc_from_counts(counts: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """(by, auroc) from rows (by, score, pos, neg): the share of positive-negative pairs in order, ties half; null if a class is missing."""
    placed = running_totals(counts, by, score, ["neg"])
    pairs = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return placed.groupBy(*by).agg(F.try_divide(pairs, F.sum("pos").cast("double") * F.sum("neg")).alias("auroc"))


def auroc(scored: DataFrame, by: Sequence[str], score: str, positive: Column) -> DataFrame:
    counts = scored.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias(score))
    return auroc_from_counts(counts.agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")), by, score)


def metric_summary(scored: DataFrame, limits: DataFrame, by: str = "category") -> DataFrame:
    """Blind metrics of each category: counts, AUROC, threshold, above rates by kind."""
    anomaly = F.col("kind") == "ANOMALY"
    rows = scored.join(limits, by)
    above = F.col("score") > F.col("threshold")
    rates = rows.groupBy(by).agg(
        F.count("*").alias("cases"), F.count_if(~anomaly).alias("nominal_cases"), F.count_if(anomaly).alias("anomaly_cases"), F.max("threshold").alias("threshold"),
        rate(above, ~anomaly).alias("nominal_above_rate"), rate(above, anomaly).alias("anomaly_above_rate"),
    )
    return rates.join(auroc(scored, [by], "score", anomaly), by, "left")


def calibration_summary(scored: DataFrame, by: str = "category", part: str | None = None) -> DataFrame:
    """(by, part, n, median, p95, max): over all scores ("all") and, by a column `part`, over each of its values. Upper median, nearest-rank P95."""
    every = scored.withColumn("part", F.lit("all"))
    if part is not None:
        every = every.unionByName(scored.withColumn("part", F.col(part)))
    wanted = {"median": "upper_median", "p95": "p95"}
    return order_statistics(every, [by, "part"], "score", wanted).join(every.groupBy(by, "part").agg(F.max("score").alias("max")), [by, "part"])


def against_thresholds(scored: DataFrame, limits: DataFrame, by: Sequence[str] = ("category",), on: str = "category") -> DataFrame:
    """Metrics of scores against frozen thresholds: count, above count and rate, P95, maximum, and both less the threshold."""
    by = list(by)
    rows = scored.join(limits, on)
    sums = rows.groupBy(*by).agg(F.count("*").alias("cases"), F.count_if(F.col("score") > F.col("threshold")).alias("above_count"), rate(F.col("score") > F.col("threshold")).alias("above_rate"), F.max("score").alias("maximum"), F.max("threshold").alias("threshold"))
    out = sums.join(order_statistics(rows, by, "score", {"p95": "p95"}).drop("n"), by)
    return out.withColumns({"p95_minus_threshold": F.col("p95") - F.col("threshold"), "maximum_minus_threshold": F.col("maximum") - F.col("threshold")})


def confusion(scored: DataFrame, by: Sequence[str], positive: Column, predicted: Column) -> DataFrame:
    """TP, FP, FN, TN, precision, recall and F1 of each group."""
    counts = scored.groupBy(*by).agg(
        F.count_if(positive & predicted).alias("tp"), F.count_if(~positive & predicted).alias("fp"), F.count_if(positive & ~predicted).alias("fn"), F.count_if(~positive & ~predicted).alias("tn")
    )
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": precision, "recall": recall}).withColumn("f1", F.try_divide(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion_by_family(scored: DataFrame, by: str, family: str, positive: Column, predicted: Column) -> DataFrame:
    """confusion() for each family: its positives with all nominals of the category. The nominals are counted once and joined to each family."""
    nominal = scored.filter(~positive).groupBy(by).agg(F.count_if(predicted).alias("fp"), F.count_if(~predicted).alias("tn"))
    own = scored.filter(positive).groupBy(by, family).agg(F.count_if(predicted).alias("tp"), F.count_if(~predicted).alias("fn"))
    rows = own.join(nominal, by, "left").na.fill(0, ["fp", "tn"])
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    rows = rows.withColumns({"precision": precision, "recall": recall})
    return rows.select(by, family, "tp", "fp", "fn", "tn", "precision", "recall", F.try_divide(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def aupro(pixels: DataFrame, by: str, score: str, region: str, limit: float = 0.30) -> DataFrame:
    """(by, aupro): area under mean region overlap against the false positive rate up to limit, over limit; null without regions or normal pixels.

    pixels: (by, score, region, n), n pixels of a score in a region, or in none (region is null). With the sizes of regions known, each pixel adds
    1 / (size * regions) to the mean overlap; so overlap and false positives are both running sums over scores, largest first.
    """
    counts = materialize(pixels.groupBy(by, score, region).agg(F.sum("n").alias("n")), "aupro-counts")
    sizes = counts.filter(F.col(region).isNotNull()).groupBy(by, region).agg(F.sum("n").alias("size"))
    regions = sizes.groupBy(by).agg(F.count("*").alias("regions"))
    weighed = counts.join(sizes, [by, region], "left").join(regions, by)
    events = weighed.groupBy(by, score).agg(
        F.sum(F.when(F.col(region).isNull(), F.col("n")).otherwise(0)).cast("double").alias("fp"), F.sum(F.when(F.col(region).isNotNull(), F.col("n") / F.col("size") / F.col("regions")).otherwise(0.0)).alias("pro")
    )
    events = materialize(running_totals(events.withColumn("_order", -F.col(score)), [by], "_order", ["fp", "pro"]), "aupro-events")
    normal = events.groupBy(by).agg(F.sum("fp").alias("normal"))
    steps = events.join(normal.filter("normal > 0"), by).select(by, (F.col("fp_before") / F.col("normal")).alias("x0"), ((F.col("fp_before") + F.col("fp")) / F.col("normal")).alias("x1"), F.col("pro_before").alias("y0"), (F.col("pro_before") + F.col("pro")).alias("y1"))
    share = F.least(F.lit(1.0), (F.lit(limit) - F.col("x0")) / (F.col("x1") - F.col("x0")))
    width = F.when(F.col("x1") > F.col("x0"), (F.col("x1") - F.col("x0")) * share).otherwise(0.0)
    height = F.when(F.col("x1") > F.col("x0"), F.col("y0") + share * (F.col("y1") - F.col("y0"))).otherwise(F.col("y1"))
    return steps.filter(F.col("x0") < limit).groupBy(by).agg((F.sum(width * (F.col("y0") + height) / 2.0) / limit).alias("aupro"))


def pixel_localization(patches: DataFrame, masked: DataFrame, by: str, case: str, size: int) -> DataFrame:
    """(by, mask_cases, regions, pixel_auroc, aupro) of patch scores (by, case, row, col, score), each for size x size pixels, against masks: pixels (case, x, y, region).

    Pixels out of the masks aren't listed: a patch has size * size of them less those that are. A region belongs to its case.
    """
    inside = masked.groupBy(case, F.floor(F.col("y") / size).alias("row"), F.floor(F.col("x") / size).alias("col"), "region").agg(F.count("*").alias("n"))
    hits = patches.join(inside, [case, "row", "col"]).select(by, "score", F.concat_ws("/", F.col(case).cast("string"), F.col("region").cast("string")).alias("region"), "n")
    totals = patches.groupBy(by, "score").agg(F.count("*").alias("patches")).join(hits.groupBy(by, "score").agg(F.sum("n").alias("pos")), [by, "score"], "left").na.fill(0, ["pos"])
    counts = materialize(totals.select(by, "score", "pos", (F.col("patches") * size * size - F.col("pos")).alias("neg")), "pixel-counts")
    pixels = hits.unionByName(counts.select(by, "score", F.lit(None).cast("string").alias("region"), F.col("neg").alias("n")))
    seen = hits.groupBy(by).agg(F.count_distinct("region").alias("regions"), F.count_distinct(F.substring_index("region", "/", 1)).alias("mask_cases"))
    curve = auroc_from_counts(counts, [by], "score").withColumnRenamed("auroc", "pixel_auroc")
    return patches.select(by).distinct().join(seen, by, "left").na.fill(0, ["regions", "mask_cases"]).join(curve, by, "left").join(aupro(pixels.filter("n > 0"), by, "score", "region"), by, "left").select(by, "mask_cases", "regions", "pixel_auroc", "aupro")


def inconsistent_scores(scored: DataFrame, case: str, tolerance: float = 0.0) -> DataFrame:
    """Cases whose parts don't bracket the score: mean_patch_distance <= score <= max_patch_distance."""
    low, high = F.col("mean_patch_distance") - tolerance, F.col("max_patch_distance") + tolerance
    return scored.filter(~F.coalesce((low <= F.col("score")) & (F.col("score") <= high), F.lit(False))).select(case, "score", "mean_patch_distance", "max_patch_distance")


def region_overlap_counts(predicted: Column, actual: Column) -> dict[str, Column]:
    """Aggregates over pixels: intersection over union, missing and protruding shares of the actual area."""
    both, either, area = F.count_if(predicted & actual), F.count_if(predicted | actual), F.count_if(actual)
    return {"iou": F.try_divide(both, either), "missing_ratio": F.try_divide(F.count_if(actual & ~predicted), area), "protruding_ratio": F.try_divide(F.count_if(predicted & ~actual), area), "area_delta": F.try_divide(F.count_if(predicted) - area, area)}


def central_width(points: DataFrame, by: str, along: str, across: str, fallback: float, slices: int = 12, least: int = 32, usable: int = 8, floor: int = 128, angle: float = 0.0) -> DataFrame:
    """(by, width): 0.90 quantile of the cross-section widths (0.005 to 0.995) in the middle 60 % of the long axis, which is `angle` radians from `along`; fallback with fewer
    than `floor` points or `usable` slices of `least` points. Groups aren't null."""
    turned = points.select(by, (F.col(along) * math.cos(angle) + F.col(across) * math.sin(angle)).alias("u"), (F.col(across) * math.cos(angle) - F.col(along) * math.sin(angle)).alias("v"))
    span = turned.groupBy(by).agg(F.min("u").alias("low"), F.max("u").alias("high"), F.count("*").alias("points"))
    part = F.floor(((F.col("u") - F.col("low")) / (F.col("high") - F.col("low")) - 0.2) / 0.6 * slices)
    cut = turned.join(span.filter((F.col("high") - F.col("low") > 1e-9) & (F.col("points") >= floor)), by).withColumn("slice", part).filter(F.col("slice").between(0, slices - 1))
    ends = order_statistics(cut, [by, "slice"], "v", {"low_end": 0.005, "high_end": 0.995}).withColumn("w", F.col("high_end") - F.col("low_end")).filter((F.col("n") >= least) & (F.col("w") > 0))
    widths = ends.groupBy(by).agg(F.count("*").alias("_slices"), F.percentile("w", 0.90).alias("_width"))  # of at most `slices` rows
    return points.select(by).distinct().join(widths, by, "left").select(by, F.when(F.col("_slices") >= usable, F.col("_width")).otherwise(F.lit(fallback)).alias("width"))
