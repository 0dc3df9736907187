"""An extension: scores that arrive as a stream, against frozen thresholds. The batch operators have no event time; this adds a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flagged(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """Stream-static join: score rows with threshold and above."""
    return scores.join(limits, "category").withColumn("above", F.col("score") > F.col("threshold"))


def above_by_window(scores: DataFrame, limits: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour", once: bool = True) -> DataFrame:
    """Cases and above counts of each category and window; rows later than `late` are dropped by the watermark. once: a case that arrives again within
    the watermark isn't counted again."""
    rows = flagged(scores, limits).withWatermark(time, late)
    if once:
        rows = rows.dropDuplicatesWithinWatermark(["case_id"])
    out = rows.groupBy(F.window(time, window).alias("w"), "category").agg(F.count("*").alias("cases"), F.count_if("above").alias("above"))
    return out.select("category", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "cases", "above")
