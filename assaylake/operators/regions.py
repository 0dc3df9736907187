"""Difference regions on numeric grids: thresholds, connected components, ranking, assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance
from ..sources.scratch import materialize
from .rectangles import touched


def priority(distance: Column, high: float, review: float) -> Column:
    """HIGH, REVIEW or LOW; a limit is reached at equality."""
    return F.when(distance >= high, "HIGH").when(distance >= review, "REVIEW").otherwise("LOW")


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components, numbered from 1 in raster order of their first cell, by union of the runs of neighbouring rows."""
    rows, columns = mask.shape
    parent: list[int] = []
    runs: list[tuple[int, int, int]] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    above: list[int] = []
    for r in range(rows):
        edges = np.flatnonzero(np.diff(np.r_[0, mask[r].astype("i1"), 0]))
        here = []
        for a, b in zip(edges[::2], edges[1::2]):
            k = len(runs)
            runs.append((r, int(a), int(b)))
            parent.append(k)
            here.append(k)
            for o in above:
                if runs[o][1] <= b and runs[o][2] >= a:  # corners touch
                    x, y = find(k), find(o)
                    parent[max(x, y)] = min(x, y)
        above = here
    names = {root: n + 1 for n, root in enumerate(sorted({find(k) for k in range(len(runs))}))}
    out = np.zeros(mask.shape, np.int32)
    for k, (r, a, b) in enumerate(runs):
        out[r, a:b] = names[find(k)]
    return out, len(names)


def components(grids: DataFrame, key: str, grid: str, width: int, threshold: float) -> DataFrame:
    """(key, label, area, x, y, width, height, peak, mean) of the components of cells at or above threshold; each grid is one row, an array of numbers in raster order.

    peak and mean are halved and clipped to 0..1.
    """
    kind = grids.schema[key].dataType.simpleString()

    def run(frames):
        for frame in frames:
            out = []
            for k, values in zip(frame[key], frame[grid]):
                cells = np.asarray(values, float).reshape(-1, width)
                labels, n = label(cells >= threshold)
                for i in range(1, n + 1):
                    y, x = np.nonzero(labels == i)
                    v = cells[y, x] / 2.0
                    out.append((k, i, len(v), int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1, float(np.clip(v.max(), 0, 1)), float(np.clip(v.mean(), 0, 1))))
            yield pd.DataFrame(out, columns=[key, "label", "area", "x", "y", "width", "height", "peak", "mean"])

    return grids.select(key, grid).mapInPandas(run, f"`{key}` {kind}, label int, area int, x int, y int, width int, height int, peak double, mean double")


#: Orders of an image's regions, first column first: by evidence, after verification, by area alone, and boundaries by area. "interior" is 1 or 0.
ORDERS = {
    "evidence": ("interior", "peak", "area"),
    "verified": ("interior", "priority_rank", "crop_distance", "peak", "area"),
    "area": ("area",),
}


def rank_regions(regions: DataFrame, by: str, most: int, interior: Column | None = None, prefix: str = "R-", order: str = "evidence") -> DataFrame:
    """The first `most` regions of each image, greatest first in one of ORDERS (nulls last), then by label; with region_id. Boundaries are ranked with order "area" and prefix "B-"."""
    rows = regions.withColumn("interior", F.when(interior, 1).otherwise(0)) if interior is not None else regions
    columns = [c for c in ORDERS[order] if c != "interior" or interior is not None]
    rank = F.row_number().over(W.partitionBy(by).orderBy(*[F.desc(c) for c in columns], "label"))
    ranked = rows.withColumn("rank", rank).filter(F.col("rank") <= most).withColumn("region_id", F.format_string(prefix + "%03d", "rank"))
    return ranked.drop("interior") if interior is not None else ranked


def priority_rank(priority: Column) -> Column:
    """2, 1, 0 for HIGH, REVIEW, LOW; null if not verified."""
    return F.when(priority == "HIGH", 2).when(priority == "REVIEW", 1).when(priority == "LOW", 0)


def largest_mask(masks: DataFrame, by: str) -> DataFrame:
    """Of each image the mask of the greatest (score, ratio)."""
    return masks.groupBy(by).agg(F.max_by(F.struct(*[c for c in masks.columns if c != by]), F.struct("score", "ratio")).alias("m")).select(by, "m.*")


def tile_pairs(current: DataFrame, reference: DataFrame, on: str, distance: str = "distance") -> DataFrame:
    """(on, tiles, score): mean of per-tile distances of two tilings (on, x, y, side, vector), which must have the same tiles; else the query fails."""
    keys = [on, "x", "y", "side"]
    both = current.select(*keys, F.col("vector").alias("_a")).join(reference.select(*keys, F.col("vector").alias("_b")), keys, "full_outer")
    lone = F.raise_error(F.concat(F.lit("TILE_WITHOUT_PARTNER "), F.col(on).cast("string")))
    d = F.when(F.col("_a").isNull() | F.col("_b").isNull(), lone).otherwise(cosine_distance(F.col("_a"), F.col("_b")))
    return both.withColumn(distance, d).groupBy(on).agg(F.count("*").alias("tiles"), F.avg(distance).alias("score"))


def intruding(rois: DataFrame, protected: DataFrame, on: str) -> DataFrame:
    """Regions of interest that share area with a protected one of the same image; none if the two are disjoint."""
    return touching(rois, protected, on)


def touching(boxes: DataFrame, regions: DataFrame, on: str) -> DataFrame:
    """Boxes (on, x, y, width, height) that share area with any region of the same image."""
    return touched(boxes, regions, on)


def assign_boxes(boxes: DataFrame, found: DataFrame, on: str, tolerance: int = 2) -> DataFrame:
    """(on, region_id, label): boxes in order of region_id take the unused component of the least L1 distance, if no side is off by more than tolerance.

    Order matters, so an image's boxes and components, a bounded number, are taken together in one group.
    """
    kind = boxes.schema[on].dataType.simpleString()
    sides = ["x", "y", "width", "height"]

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("region_id"), right.sort_values("label")
        free, out = list(range(len(right))), []
        have = right[sides].to_numpy()
        for name, box in zip(left["region_id"], left[sides].to_numpy()):
            if not free:
                break
            best = min(free, key=lambda i: np.abs(have[i] - box).sum())
            if np.abs(have[best] - box).max() <= tolerance:
                free.remove(best)
                out.append((key[0], name, int(right["label"].iloc[best])))
        return pd.DataFrame(out, columns=[on, "region_id", "label"])

    return boxes.groupBy(on).cogroup(found.groupBy(on)).applyInPandas(run, f"`{on}` {kind}, region_id string, label int")


def keep_large(regions: DataFrame, by: str, least: int = 256, share: float = 0.005) -> DataFrame:
    """Components of at least `least` cells and that share of the image's largest one."""
    largest = F.max("area").over(W.partitionBy(by))
    return regions.withColumn("_largest", largest).filter(F.col("area") >= F.greatest(F.lit(float(least)), share * F.col("_largest"))).drop("_largest")


def overlap_mean(tiles: DataFrame, by: str, values: str, side: str) -> DataFrame:
    """(by, px, py, value): mean over all tiles that cover a cell; a tile is (x, y, side, values in raster order)."""
    cells = tiles.select(by, "x", "y", F.col(side).alias("_s"), F.posexplode(values).alias("i", "v"))
    return cells.groupBy(by, (F.col("x") + F.col("i") % F.col("_s")).alias("px"), (F.col("y") + F.floor(F.col("i") / F.col("_s"))).alias("py")).agg(F.avg("v").alias("value"))


def morph(mask: np.ndarray, radius: int, grow: bool) -> np.ndarray:
    """Dilation or erosion by a disc; outside counts as empty for growing and as full for shrinking."""
    out = mask.copy()
    padded = np.pad(mask, radius, constant_values=not grow)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dx * dx + dy * dy <= radius * radius:
                moved = padded[radius + dy : radius + dy + mask.shape[0], radius + dx : radius + dx + mask.shape[1]]
                out = out | moved if grow else out & moved
    return out


def scopes(masks: DataFrame, key: str, mask: str, width: int, padding: int, band: int) -> DataFrame:
    """(key, support, boundary) of a subject mask: the mask grown by padding, and the band around its edge."""
    kind = masks.schema[key].dataType.simpleString()

    def run(frames):
        for frame in frames:
            grids = [np.asarray(m, bool).reshape(-1, width) for m in frame[mask]]
            flat = lambda g: [bool(x) for x in g.ravel()]
            yield pd.DataFrame({key: frame[key], "support": [flat(morph(g, padding, True)) for g in grids], "boundary": [flat(morph(g, band, True) & ~morph(g, band, False)) if band else [False] * g.size for g in grids]})

    return masks.select(key, mask).mapInPandas(run, f"`{key}` {kind}, support array<boolean>, boundary array<boolean>")


def mutual_nearest(pairs: DataFrame, a: str, b: str, distance: str, ratio: float = 0.75) -> DataFrame:
    """Pairs that are each other's nearest and pass the ratio test (nearest < ratio * second) in both directions; a lone candidate passes."""

    def best(x: str, y: str) -> DataFrame:
        two = pairs.withColumn("_n", F.row_number().over(W.partitionBy(x).orderBy(distance, y))).filter("_n <= 2")
        one = two.groupBy(x).agg(F.min_by(y, "_n").alias(y), F.min(distance).alias(distance), F.max(F.when(F.col("_n") == 2, F.col(distance))).alias("_second"))
        return one.filter(F.col("_second").isNull() | (F.col(distance) < ratio * F.col("_second"))).drop("_second")

    return best(a, b).join(best(b, a).select(a, b), [a, b])


def nearest_two(queries: DataFrame, targets: DataFrame, on: str, name: str) -> DataFrame:
    """(on, x, y, name, distance, second) of each place of queries: the nearest of targets (on, x, y, name) of the same `on` by L1 distance, ties to the least name, and the distance of the next, null if there is none.

    Points of one place count as one with a number. Places meet in the nine cells around a query's, whose side suits how dense the targets of their `on` are; what isn't within a side is looked
    for again with sides twice as long. So pairs grow with the places, not with their square. Points without coordinates take no part.
    """
    known = lambda d: d.filter(F.col(on).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    places = known(targets).groupBy(on, "x", "y").agg(F.count("*").alias("n"), F.min(name).alias(name))
    places = materialize(places.select(on, F.col("x").alias("tx"), F.col("y").alias("ty"), "n", name), "places")
    wide, high = F.max("tx").cast("double") - F.min("tx"), F.max("ty").cast("double") - F.min("ty")
    side = F.greatest(2 * F.sqrt(wide * high / F.count("*")), 2 * F.greatest(wide, high) / F.count("*"))
    spans = materialize(places.groupBy(on).agg(F.sum("n").alias("total"), F.when(side > 0, side).otherwise(1.0).alias("side")), "spans")
    rest = materialize(known(queries).select(on, "x", "y").distinct().join(spans, on), "asked-places")
    found, near, key = None, F.array(*[F.lit(i) for i in (-1, 0, 1)]), [on, "x", "y"]
    while not rest.isEmpty():
        asked = rest.withColumn("cx", F.explode(F.transform(near, lambda i: F.floor(F.col("x") / F.col("side")) + i))).withColumn("cy", F.explode(F.transform(near, lambda i: F.floor(F.col("y") / F.col("side")) + i)))
        there = places.join(rest.select(on, "side").distinct(), on).withColumns({"cx": F.floor(F.col("tx") / F.col("side")), "cy": F.floor(F.col("ty") / F.col("side"))}).drop("side")
        distance = (F.abs(F.col("x") - F.col("tx")) + F.abs(F.col("y") - F.col("ty"))).cast("double")
        rings = asked.join(there, [on, "cx", "cy"]).groupBy(*key, "side", "total", distance.alias("distance")).agg(F.sum("n").alias("n"), F.min(name).alias(name))
        ranked = rings.withColumns({"_k": F.row_number().over(W.partitionBy(*key).orderBy("distance")), "_seen": F.sum("n").over(W.partitionBy(*key))}).filter("_k <= 2")
        one = ranked.groupBy(*key, "side", "total").agg(F.min_by(name, "_k").alias(name), F.min("distance").alias("distance"), F.min_by("n", "_k").alias("n"), F.max(F.when(F.col("_k") == 2, F.col("distance"))).alias("next"), F.max("_seen").alias("_seen"))
        one = one.withColumn("second", F.when(F.col("n") > 1, F.col("distance")).otherwise(F.col("next")))
        told = materialize(one.filter((F.col("second") <= F.col("side")) | (F.col("_seen") == F.col("total"))).select(*key, name, "distance", "second"), "nearest-places")
        found = told if found is None else found.unionByName(told)
        rest = materialize(rest.join(told, key, "left_anti").withColumn("side", 2 * F.col("side")), "asked-places")
    return found if found is not None else queries.limit(0).select(*key, F.lit(None).cast(targets.schema[name].dataType).alias(name), *[F.lit(None).cast("double").alias(c) for c in ("distance", "second")])


def mutual_nearest_points(left: DataFrame, right: DataFrame, on: str, a: str, b: str, ratio: float = 0.75) -> DataFrame:
    """(a, b, distance), as mutual_nearest over all pairs of points (on, a or b, x, y) of the same `on` by L1 distance, without making the pairs."""

    def best(d: DataFrame, x: str, other: DataFrame, y: str) -> DataFrame:
        told = nearest_two(d, other, on, y).filter(F.col("second").isNull() | (F.col("distance") < ratio * F.col("second")))
        return d.join(told, [on, "x", "y"]).select(x, y, "distance")

    return best(left, a, right, b).join(best(right, b, left, a).select(a, b), [a, b])
