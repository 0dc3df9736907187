"""Joins of rectangles that share area, by cells of the plane.

A box has a level by its longer side, each with cells of twice the side of the one below, so it covers four cells of its level at most. It is also put in the cells of coarser levels that the other side has; two boxes
meet at the coarser of their levels. The pair is told in one cell only, that of the upper left corner of what they share. Cells in which more than DENSE pairs meet are dealt to parts: each part has some of
one side and a copy of the other. So neither an image with very many boxes nor a crowded place is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import overlaps
from ..sources.scratch import materialize

#: Pairs of boxes that are compared in one place, and parts of a cell at most.
DENSE, PARTS = 1 << 20, 1 << 12


def _level(side: Column) -> Column:
    """The least whole number whose power of two isn't below the side."""
    return F.ceil(F.log2(F.greatest(side.cast("double"), F.lit(2.0**-20)))).cast("int")


def _placed(boxes: DataFrame, on: str, levels: list[int], p: str) -> DataFrame:
    """(on, level, cx, cy, p: struct of the box) of each cell that a box of positive area covers, from its own level up."""
    size = F.pow(F.lit(2.0), F.col("level"))
    box = F.struct("_row", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")], _level(F.greatest("width", "height")).alias("own"))
    rows = boxes.filter((F.col("width") > 0) & (F.col("height") > 0)).select(F.col(on).alias("on"), box.alias(p))
    rows = rows.withColumn("level", F.explode(F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k >= F.col(f"{p}.own"))))
    cells = lambda at, by: F.sequence(F.floor(F.col(f"{p}.{at}") / size), F.greatest(F.ceil((F.col(f"{p}.{at}") + F.col(f"{p}.{by}")) / size) - 1, F.floor(F.col(f"{p}.{at}") / size)))
    return rows.withColumn("cx", F.explode(cells("x", "width"))).withColumn("cy", F.explode(cells("y", "height")))


def meeting(left: DataFrame, right: DataFrame, on: str, dense: int = DENSE) -> DataFrame:
    """(on, l, r) for all pairs of the same `on` that share area, once each; l and r are structs with _row, a column of both sides. Null values of `on` meet nothing."""
    sides = [materialize(d.select(on, "_row", "x", "y", "width", "height").filter(F.col(on).isNotNull()), "boxes") for d in (left, right)]
    kinds = [{r[0] for r in d.filter("width > 0 and height > 0").select(_level(F.greatest("width", "height"))).distinct().collect()} for d in sides]  # some tens
    levels = sorted(set.union(*kinds))
    key = ["on", "level", "cx", "cy"]
    one, two = (_placed(d, on, levels, p) for d, p in zip(sides, "lr"))
    counts = [d.groupBy(*key).agg(F.count("*").alias(f"n_{p}")) for d, p in ((one, "l"), (two, "r"))]
    crowded = counts[0].join(counts[1], key).filter(F.col("n_l") * F.col("n_r") > dense)
    crowded = materialize(crowded.select(*key, F.least(F.lit(PARTS), F.ceil(F.col("n_l") * F.col("n_r") / dense)).alias("parts")), "crowded-cells")
    if crowded.isEmpty():
        one, two = (d.withColumn("part", F.lit(0).cast("long")) for d in (one, two))
    else:
        one, two = (d.join(crowded, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))) for d in (one, two))
        one = one.withColumn("part", F.pmod(F.xxhash64("l._row"), F.col("parts"))).drop("parts")
        two = two.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    met = one.join(two, [*key, "part"])
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))  # noqa: E741
    size = F.pow(F.lit(2.0), F.col("level"))
    here = (F.floor(F.greatest(l("x"), r("x")) / size) == F.col("cx")) & (F.floor(F.greatest(l("y"), r("y")) / size) == F.col("cy"))
    share = overlaps(l("x"), l("y"), l("width"), l("height"), r("x"), r("y"), r("width"), r("height"))
    return met.filter((F.col("level") == F.greatest(l("own"), r("own"))) & here & share).select(F.col("on").alias(on), "l", "r")


def _scouted(boxes: DataFrame, regions: DataFrame, on: str) -> DataFrame:
    """_row of boxes that share area with one of their cells' scouts: of each quarter of a cell the region that has most of it. So no more than four pairs for a box and cell."""
    kinds = [r[0] for r in boxes.unionByName(regions).filter("width > 0 and height > 0").select(_level(F.greatest("width", "height"))).distinct().collect()]  # some tens
    key, levels = ["on", "level", "cx", "cy"], sorted(kinds)
    one, two = _placed(boxes, on, levels, "l"), _placed(regions, on, levels, "r")
    l = lambda c: F.col(f"l.{c}")  # noqa: E731,E741
    half = F.pow(F.lit(2.0), F.col("level")) / 2
    part = lambda at, by, c, k: F.greatest(F.least(F.col(f"r.{at}") + F.col(f"r.{by}"), (2 * F.col(c) + k + 1) * half) - F.greatest(F.col(f"r.{at}"), (2 * F.col(c) + k) * half), F.lit(0.0))
    box = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("x", "y", "width", "height")])
    scouts = two.groupBy(*key).agg(*[F.max(F.struct((part("x", "width", "cx", i) * part("y", "height", "cy", j)).alias("area"), box.alias("box"))).alias(f"q{i}{j}") for i in (0, 1) for j in (0, 1)])
    scouts = scouts.select(*key, F.array_distinct(F.array(*[F.col(f"q{i}{j}.box") for i in (0, 1) for j in (0, 1)])).alias("scouts"))
    share = lambda s: overlaps(l("x"), l("y"), l("width"), l("height"), s["x"], s["y"], s["width"], s["height"])
    return one.join(scouts, key).filter(F.exists("scouts", share)).select(F.col("l._row").alias("_row")).distinct()


def touched(boxes: DataFrame, regions: DataFrame, on: str, dense: int = DENSE) -> DataFrame:
    """boxes (on, x, y, width, height and others) that share area with any region of the same `on`; equal rows stay as often as they are.

    Where regions are crowded nearly every box meets one of a few large ones, so boxes are first held against those of their cells; only boxes that meet none go through all regions.
    """
    numbered = materialize(boxes.withColumn("_row", F.monotonically_increasing_id()), "numbered-boxes")
    # Equal regions are one.
    others = materialize(regions.select(on, "x", "y", "width", "height").distinct().withColumn("_row", F.monotonically_increasing_id()), "numbered-regions")
    plain = numbered.select(on, "_row", "x", "y", "width", "height")
    hit = materialize(_scouted(plain, others, on), "scouted-boxes")
    rest = materialize(plain.join(hit, "_row", "left_anti"), "other-boxes")
    hit = hit.unionByName(meeting(rest, others, on, dense).select(F.col("l._row").alias("_row")).distinct())
    return numbered.join(hit, "_row", "left_semi").select(*boxes.columns)
