"""Closed intervals as structs (low, high) of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval(low: Column, high: Column) -> Column:
    return F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"))


def around(centre: Column, half: Column) -> Column:
    return interval(centre - half, centre + half)


def nearest(value: Column, low: float, high: float) -> Column:
    """The point of low..high that is nearest to value; null for null."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def clipped(band: Column, low: float, high: float) -> Column:
    """The part of band within low..high; it holds nothing if the two are apart."""
    return interval(F.when(band["low"] < low, F.lit(low)).otherwise(band["low"]), F.when(band["high"] > high, F.lit(high)).otherwise(band["high"]))


def holds_any(band: Column) -> Column:
    return F.coalesce(band["low"] <= band["high"], F.lit(False))


def margins(inner: Column, outer: Column) -> tuple[Column, Column]:
    """How far inner's ends are inside of outer's; their sum is what inner is narrower by."""
    return inner["low"] - outer["low"], outer["high"] - inner["high"]


def refines(inner: Column, outer: Column, tolerance: float) -> Column:
    """Whether inner lies in outer and is narrower by more than tolerance, up to which an end may stand out; false with a null."""
    below, above = margins(inner, outer)
    return F.coalesce((below >= -tolerance) & (above >= -tolerance) & (below + above > tolerance), F.lit(False)) & holds_any(inner)
