"""Grids that are larger than a row: strips of rows, whose components, tiles and resized values don't depend on how high the strips are.

A strip is (image, y, width, values): rows from y on, one after another in an array. Components of cells at or above a threshold, by eight neighbours, are first found
within strips, as runs; where components of two strips touch across the border between them they are one, which joins on the border and a range of columns tell. Tiles are put
together from the strips that they touch. Bilinear resizing is two small matrices of weights, applied to blocks of grids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .linking import connected

#: Columns of a border that are compared in one place.
BIN = 64


def strips(rows: DataFrame, image: str, y: str, values: str, height: int) -> DataFrame:
    """(image, y, width, values) of `height` rows each, of rows (image, y, values) with y from 0 on."""
    packed = rows.groupBy(F.col(image).alias("image"), F.floor(F.col(y) / height).alias("s")).agg(F.array_sort(F.collect_list(F.struct(F.col(y).cast("long").alias("y"), F.col(values).alias("v")))).alias("r"))
    return packed.select("image", F.element_at("r", 1)["y"].alias("y"), F.size(F.element_at("r", 1)["v"]).alias("width"), F.flatten(F.transform("r", lambda x: x["v"])).alias("values"))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and the column behind the last of each run of true cells, in order."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (y, start), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return y, start, end


def touching(y: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs of neighbouring rows that touch, corners included."""
    span = width + 2
    first, last, below = y * span + start, y * span + end, (y + 1) * span
    low, high = np.searchsorted(last, below + start, side="left"), np.searchsorted(first, below + end, side="right")
    count = np.maximum(high - low, 0)
    i = np.repeat(np.arange(len(y)), count)
    return i, np.arange(len(i)) + np.repeat(low - (np.cumsum(count) - count), count)


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that links i, j lead to."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := root[root], root):
            root = up


def _strip_components(threshold: float):
    struct = pa.struct([("border", pa.int64()), ("side", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                top, width = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                grid = batch.column(3)[k].values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                y, start, end = runs(grid >= threshold)
                if not len(y):
                    continue
                root = least_labels(len(y), *touching(y, start, end, width))
                own, which = np.unique(root, return_inverse=True)
                cells = np.flatnonzero(np.repeat(True, (end - start).sum()))
                of = np.repeat(np.arange(len(y)), end - start)
                flat = grid.ravel()[y[of] * width + start[of] + cells - np.repeat(np.cumsum(end - start) - (end - start), end - start)]
                peak, total = np.full(len(own), -np.inf), np.bincount(which[of], flat, len(own))
                np.maximum.at(peak, which[of], flat)
                box = [np.full(len(own), f) for f in (width, 1 << 60, -1, -1)]
                np.minimum.at(box[0], which, start), np.minimum.at(box[1], which, y), np.maximum.at(box[2], which, end - 1), np.maximum.at(box[3], which, y)
                edges: list[list[dict]] = [[] for _ in own]
                for row, side, border in ((0, 1, top), (len(grid) - 1, 0, top + len(grid))):
                    for r in np.flatnonzero(y == row):
                        edges[which[r]].append({"border": border, "side": side, "start": int(start[r]), "end": int(end[r])})
                columns = [
                    batch.column(0).slice(k, 1).take(pa.array(np.zeros(len(own), np.int64))), pa.array((y[own] + top) * width + start[own]), pa.array(np.bincount(which, end - start, len(own)).astype(np.int64)), pa.array(peak), pa.array(total),
                    *[pa.array(b.astype(np.int64) + shift) for b, shift in zip(box, (0, top, 0, top))], pa.array(edges, pa.list_(struct)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["image", "label", "area", "peak", "total", "x0", "y0", "x1", "y1", "edges"])

    return run


def components(grid: DataFrame, threshold: float) -> DataFrame:
    """(image, label, area, peak, mean, x0, y0, x1, y1) of each component of strips as strips() gives them; label is its first cell, row by row. Null and NaN cells are below any threshold."""
    kind = grid.schema["image"].dataType.simpleString()
    schema = f"image {kind}, label long, area long, peak double, total double, x0 long, y0 long, x1 long, y1 long, edges array<struct<border:long,side:int,start:long,end:long>>"
    local = materialize(grid.select("image", "y", "width", "values").mapInArrow(_strip_components(threshold), schema), "strip-components")
    cells = local.select("image", "label", F.explode("edges").alias("e")).select("image", "label", "e.*")
    # A run above touches the runs below from the column before it to the column behind it.
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / BIN), F.floor(high / BIN)))
    above = cells.filter("side = 0").select("image", "border", F.col("label").alias("l0"), F.col("start").alias("s0"), F.col("end").alias("e0"), bins(F.greatest(F.col("start") - 1, F.lit(0)), F.col("end")).alias("bin"))
    below = cells.filter("side = 1").select("image", "border", F.col("label").alias("l1"), F.col("start").alias("s1"), F.col("end").alias("e1"), bins(F.col("start"), F.col("end") - 1).alias("bin"))
    met = above.join(below, ["image", "border", "bin"]).filter("s1 <= e0 and e1 >= s0")
    node = lambda label: F.struct("image", F.col(label).alias("label"))
    roots = connected(met.select(node("l0").alias("a"), node("l1").alias("b"))).select(F.col("node.image").alias("image"), F.col("node.label").alias("label"), F.col("root.label").alias("root"))
    whole = local.join(roots, ["image", "label"], "left").groupBy("image", F.coalesce("root", "label").alias("label"))
    out = whole.agg(F.sum("area").alias("area"), F.max("peak").alias("peak"), (F.sum("total") / F.sum("area")).alias("mean"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    return out.select("image", "label", "area", "peak", "mean", "x0", "y0", "x1", "y1")


def weights(size: int, to: int) -> np.ndarray:
    """Bilinear weights of `size` cells for each of `to`: centres are aligned, and cells beyond an edge are the edge's."""
    at = np.clip((np.arange(to) + 0.5) * size / to - 0.5, 0, size - 1)
    low = np.minimum(at.astype(int), max(size - 2, 0))
    out = np.zeros((to, size))
    out[np.arange(to), low] = 1 - (at - low)
    out[np.arange(to), np.minimum(low + 1, size - 1)] += at - low
    return out


def resized(rows: DataFrame, grid: str, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """rows with `grid`, height x width numbers row by row, replaced by to_height x to_width ones; other sizes are an error, null stays."""
    down, across = weights(height, to_height), weights(width, to_width)
    at = rows.columns.index(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            kept = column.is_valid().to_numpy(zero_copy_only=False)
            flat = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float)
            if len(flat) != kept.sum() * height * width:
                raise ValueError("grid has another size")
            made = (down @ flat.reshape(-1, height, width) @ across.T).reshape(-1)
            sizes = np.r_[0, np.cumsum(kept * to_height * to_width)].astype(np.int32)
            new = pa.ListArray.from_arrays(pa.array(sizes, mask=np.r_[~kept, False]), pa.array(made))
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    fields = ", ".join(f"`{f.name}` {'array<double>' if f.name == grid else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, fields)


def tile_digests(raster: DataFrame, tiles: DataFrame, height: int, neutral: int = 127, kind: str = "GRAY8") -> DataFrame:
    """(image, x, y, side, sha256) of tiles (image, x, y, side) over a raster of strips (image, y, width, bytes, scope), `height` rows each but the last.

    bytes has a byte for each cell, scope a 1 where a cell is in scope; all other cells of a tile, those beyond the raster too, are `neutral`. The digest is over "x:y:side:kind:" and the tile's bytes row by row.
    A tile meets the strips that it touches and takes its rows from them, so neither a raster nor an image's tiles are in one place.
    """
    rows = F.explode(F.sequence(F.floor(F.col("y") / height), F.floor((F.col("y") + F.col("side") - 1) / height))).alias("strip")
    asked = tiles.select("image", "x", F.col("y").alias("ty"), "side", F.col("y"), rows).drop("y")
    given = raster.select("image", F.floor(F.col("y") / height).alias("strip"), F.col("y").alias("top"), "width", "bytes", "scope")
    met = asked.join(given, ["image", "strip"], "left").select("image", "x", "ty", "side", "strip", "top", "width", "bytes", "scope")
    image = tiles.schema["image"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for r in batch.select(["x", "ty", "side", "strip", "top", "width", "bytes", "scope"]).to_pylist():
                x, y, side, first = r["x"], r["ty"], r["side"], r["strip"] * height
                low, high = max(y, first), min(y + side, first + height)
                out = np.full((high - low, side), neutral, np.uint8)
                if r["bytes"] is not None:
                    cells, scope = (np.frombuffer(r[c], np.uint8).reshape(-1, r["width"]) for c in ("bytes", "scope"))
                    own = slice(max(low - r["top"], 0), max(min(high - r["top"], len(cells)), 0))
                    piece, seen = cells[own, max(x, 0) : max(x + side, 0)], scope[own, max(x, 0) : max(x + side, 0)] > 0
                    at = (max(r["top"] - low, 0), max(-x, 0))
                    place = out[at[0] : at[0] + piece.shape[0], at[1] : at[1] + piece.shape[1]]
                    place[seen] = piece[seen]
                parts.append(out.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("image", "x", "ty", "side", "strip")), pa.array(parts, pa.binary())], names=["image", "x", "y", "side", "strip", "part"])

    cut = met.mapInArrow(run, f"image {image}, x long, y long, side long, strip long, part binary")
    whole = cut.groupBy("image", "x", "y", "side").agg(F.array_sort(F.collect_list(F.struct("strip", "part"))).alias("p"))
    joined = F.aggregate("p", F.encode(F.concat_ws(":", "x", "y", "side", F.lit(kind), F.lit("")), "utf-8"), lambda s, p: F.concat(s, p["part"]))
    return whole.select("image", "x", "y", "side", F.sha2(joined, 256).alias("sha256"))


def mask_bytes(cells: Column) -> Column:
    """An array of numbers 0 to 255 as binary."""
    return F.unhex(F.array_join(F.transform(cells, lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), ""))
