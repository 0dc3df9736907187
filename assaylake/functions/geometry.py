"""Rectangles, tiles and plane geometry."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the feature extractor's input: the shorter edge is resized, then the centre is cut out.
SHORT_EDGE, INPUT_SIZE = 256, 224
#: Tiles advance by this share of what the extractor sees of them, and have sides within these bounds.
STRIDE, LEAST_SIDE, MOST_SIDE, MARGIN = 0.70, 224.0, 384, 1.25


def overlaps(x1: Column, y1: Column, w1: Column, h1: Column, x2: Column, y2: Column, w2: Column, h2: Column) -> Column:
    """Whether two rectangles share area; touching edges don't count."""
    return (x1 < x2 + w2) & (x2 < x1 + w1) & (y1 < y2 + h2) & (y2 < y1 + h1)


def window_starts(start: Column, length: Column, window: Column) -> Column:
    """Starts, as an array, of windows that cover one axis: every STRIDE of a window from the axis' start on, and one that closes at its end. A longer window is centred."""
    room = length - window
    last = F.ceil(room / (STRIDE * window)) - 1  # the last start short of the end
    along = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0))), lambda i: start + i * (STRIDE * window))
    closing = F.filter(F.array(start + room), lambda x: x - (start + F.greatest(last, F.lit(0)) * (STRIDE * window)) > 1e-6)
    return F.when(room <= 0, F.array(start + room / 2.0)).otherwise(F.concat(along, closing))


def tiles_of(regions: Column, width: Column, height: Column) -> Column:
    """Square tiles (x, y, side) whose seen centres cover all regions, an array of structs (x, y, width, height); distinct, by y, x and side."""

    def cover(r: Column) -> Column:
        side = F.ceil(F.least(F.lit(float(MOST_SIDE)), width.cast("double"), height.cast("double"), F.greatest(F.lit(LEAST_SIDE), MARGIN * F.least(r["width"], r["height"]))))
        seen = side * (INPUT_SIZE / SHORT_EDGE)
        edge = (side - seen) / 2.0
        place = lambda at, whole: F.greatest(F.lit(0), F.least(whole.cast("int") - side.cast("int"), F.rint(at - edge).cast("int")))
        down, across = window_starts(r["y"], r["height"], seen), window_starts(r["x"], r["width"], seen)
        return F.flatten(F.transform(down, lambda b: F.transform(across, lambda a: F.struct(place(b, height).alias("y"), place(a, width).alias("x"), side.cast("int").alias("side")))))

    found = F.array_sort(F.array_distinct(F.flatten(F.transform(regions, cover))))
    return F.transform(found, lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"), t["side"].alias("side")))


def quad_residual(a: Column, b: Column) -> Column:
    """Least RMS distance of two quads (arrays of 4 structs x, y) over all starts and both directions."""
    point = lambda i, j: F.pow(F.get(a, F.lit(i))["x"] - F.get(b, F.lit(j))["x"], 2) + F.pow(F.get(a, F.lit(i))["y"] - F.get(b, F.lit(j))["y"], 2)
    orders = [[(d * k + s) % 4 for k in range(4)] for s in range(4) for d in (1, -1)]
    return F.least(*[F.sqrt(sum((point(i, j) for j, i in enumerate(o)), F.lit(0.0)) / 4) for o in orders])


def plane_intersection(ray: Sequence[Column], normal: Sequence[Column], point: Sequence[Column], offset: Column) -> tuple[Column, ...]:
    """Where a camera ray meets the plane that lies `offset` in front of another (unit normal, a point on it); null if parallel or behind."""
    along = sum((r * n for r, n in zip(ray, normal)), F.lit(0.0))
    reach = sum((p * n for p, n in zip(point, normal)), F.lit(0.0)) + offset
    t = F.when(F.abs(along) > 1e-12, reach / along)
    t = F.when(t > 0, t)
    return tuple(r * t for r in ray)


def front_offset(ray: Sequence[Column], depth: Column, normal: Sequence[Column], point: Sequence[Column]) -> Column:
    """Distance in front of the plane of the point at a camera depth (z) on the ray."""
    at = [r / ray[2] * depth for r in ray]
    return sum(((a - p) * n for a, p, n in zip(at, point, normal)), F.lit(0.0))


def dimension_uncertainty(edge: Column, perimeter: Column) -> dict[str, Column]:
    """Of an edge uncertainty: that of a length (both ends) and of an area (a band along the outline, rounded at corners)."""
    return {"length": 2.0 * edge, "area": perimeter * edge + math.pi * edge * edge}
