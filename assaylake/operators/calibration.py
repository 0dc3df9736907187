"""Focal length of a camera from one view of a known planar board: square pixels and a centred principal point are assumed.

The homography of an image is the least eigenvector of a 9 x 9 matrix of sums over its point pairs, 24 different ones, which Spark adds up ahead of the shuffle. Only these sums reach the task that solves it.
Points whose reprojection is off by more than INLIER pixels are left out of a second fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Least points and image side, reprojection error of an inlier, range of focal lengths, largest share of skew, least difference of norms.
LEAST_POINTS, LEAST_SIDE, INLIER, FOCAL, SKEW, LEAST_DIFFERENCE = 4, 64, 2.5, (100.0, 100_000.0), 0.25, 1e-14
STATES = ("AVAILABLE", "INPUT_INVALID", "HOMOGRAPHY_INVALID", "FOCAL_UNIDENTIFIABLE", "FOCAL_INVALID", "ASSUMPTION_VIOLATED")
_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]


def homographies(sums: np.ndarray) -> np.ndarray:
    """(images, 3, 3) from (images, 4, 6) sums of p p', u p p', v p p' and (u u + v v) p p' over pairs of p = (x, y, 1) and (u, v)."""
    m = np.zeros((len(sums), 4, 3, 3))
    for k, (i, j) in enumerate(_PAIRS):
        m[:, :, i, j] = m[:, :, j, i] = sums[:, :, k]
    # The board is moved to its points' mean and scaled to their spread, which only changes how well the sums are conditioned.
    n = m[:, 0, 2, 2]
    mean = m[:, 0, :2, 2] / n[:, None]
    spread = np.sqrt(np.maximum((m[:, 0, 0, 0] + m[:, 0, 1, 1]) / n - (mean**2).sum(axis=1), 1e-300))
    t = np.zeros((len(sums), 3, 3))
    t[:, 0, 0] = t[:, 1, 1] = 1.0 / spread
    t[:, :2, 2], t[:, 2, 2] = -mean / spread[:, None], 1.0
    m = t[:, None] @ m @ t[:, None].transpose(0, 1, 3, 2)
    normal = np.zeros((len(sums), 9, 9))
    normal[:, :3, :3] = normal[:, 3:6, 3:6] = m[:, 0]
    for row, block in ((0, m[:, 1]), (3, m[:, 2])):
        normal[:, row : row + 3, 6:], normal[:, 6:, row : row + 3] = -block, -block
    normal[:, 6:, 6:] = m[:, 3]
    return np.linalg.eigh(normal)[1][:, :, 0].reshape(-1, 3, 3) @ t


def focal(h: np.ndarray) -> tuple[str, float, float]:
    """(state, focal length, residual) of a homography into pixels from the principal point."""
    if not np.isfinite(h).all() or abs(h[2, 2]) < 1e-12 * np.abs(h).max():
        return "HOMOGRAPHY_INVALID", np.nan, np.nan
    first, second = (h / h[2, 2])[:, 0], (h / h[2, 2])[:, 1]
    difference = (first[:2] ** 2).sum() - (second[:2] ** 2).sum()
    if abs(difference) <= LEAST_DIFFERENCE:
        return "FOCAL_UNIDENTIFIABLE", np.nan, np.nan
    inverse = (second[2] ** 2 - first[2] ** 2) / difference
    if not inverse > 0 or not FOCAL[0] <= inverse**-0.5 <= FOCAL[1]:
        return "FOCAL_INVALID", np.nan, np.nan
    scale = np.array([inverse**0.5, inverse**0.5, 1.0])
    a, b = first * scale, second * scale
    residual = abs(a @ b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12)
    return ("ASSUMPTION_VIOLATED" if residual > SKEW else "AVAILABLE"), inverse**-0.5, residual


def _summed(points: DataFrame, by: str) -> DataFrame:
    p = [F.col("x"), F.col("y"), F.lit(1.0)]
    by_weight = [F.lit(1.0), F.col("u"), F.col("v"), F.col("u") * F.col("u") + F.col("v") * F.col("v")]
    sums = [F.sum(w * p[i] * p[j]) for w in by_weight for i, j in _PAIRS]
    whole = F.coalesce(F.isnan(F.col("x") + F.col("y") + F.col("u") + F.col("v")), F.lit(True))
    return points.groupBy(by).agg(F.count("*").alias("n"), F.max("width").alias("width"), F.max("height").alias("height"), F.count_if(whole).alias("odd"), F.array(*sums).alias("s"))


def _solved(sums: DataFrame, by: str) -> DataFrame:
    kind = sums.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("s").to_pylist()
            good = [n >= LEAST_POINTS and not odd and min(w or 0, h or 0) >= LEAST_SIDE and None not in s and np.isfinite(s).all() for n, odd, w, h, s in zip(*(batch.column(c).to_pylist() for c in ("n", "odd", "width", "height")), values)]
            h = homographies(np.array([s for s, ok in zip(values, good) if ok], float).reshape(-1, 4, 6)) if any(good) else np.zeros((0, 3, 3))
            found = iter(h)
            kept = [next(found) if ok else None for ok in good]
            told = [focal(k) if k is not None else ("INPUT_INVALID", np.nan, np.nan) for k in kept]
            real = lambda x: None if np.isnan(x) else float(x)
            columns = [batch.column(by), pa.array([t[0] for t in told]), pa.array([real(t[1]) for t in told], pa.float64()), pa.array([real(t[2]) for t in told], pa.float64()), pa.array([None if k is None else k.ravel().tolist() for k in kept], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[by, "state", "focal", "residual", "h"])

    return sums.mapInArrow(run, f"`{by}` {kind}, state string, focal double, residual double, h array<double>")


def focal_lengths(points: DataFrame, by: str = "image") -> DataFrame:
    """(by, points, inliers, state, focal, residual) of points (by, x, y on the board; px, py in the image; width, height of it).

    States: STATES. An image with a null or odd coordinate, too few points or too small a side is INPUT_INVALID.
    """
    centred = points.select(by, *[F.col(c).cast("double").alias(c) for c in ("x", "y")], (F.col("px") - F.col("width") / 2.0).alias("u"), (F.col("py") - F.col("height") / 2.0).alias("v"), "width", "height")
    first = _solved(_summed(centred, by), by)
    near = first.filter("h is not null").select(by, "h")
    at = lambda r: F.get("h", F.lit(3 * r)) * F.col("x") + F.get("h", F.lit(3 * r + 1)) * F.col("y") + F.get("h", F.lit(3 * r + 2))
    off = F.sqrt(F.pow(at(0) / at(2) - F.col("u"), 2) + F.pow(at(1) / at(2) - F.col("v"), 2))
    kept = centred.join(near, by).withColumn("_off", off).filter(F.col("_off") <= INLIER).drop("h", "_off")
    second = _solved(_summed(kept, by), by).select(by, F.struct("state", "focal", "residual").alias("two"))
    counts = centred.groupBy(by).agg(F.count("*").alias("points"))
    inliers = kept.groupBy(by).agg(F.count("*").alias("inliers"))
    out = counts.join(first.drop("h"), by).join(inliers, by, "left").join(second, by, "left")
    few = F.coalesce("inliers", F.lit(0)) < LEAST_POINTS
    state = F.when(F.col("state") == "INPUT_INVALID", F.col("state")).when(few, "HOMOGRAPHY_INVALID").otherwise(F.col("two.state"))
    value = lambda c: F.when((F.col("state") != "INPUT_INVALID") & ~few, F.col(f"two.{c}"))
    return out.select(by, "points", F.coalesce("inliers", F.lit(0)).alias("inliers"), state.alias("state"), value("focal").alias("focal"), value("residual").alias("residual"))
