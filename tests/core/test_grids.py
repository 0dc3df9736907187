import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import grids
from assaylake.operators.linking import connected


def flood(mask):
    """Labels by first cell, eight neighbours, by a plain search."""
    label, (h, w) = -np.ones(mask.shape, int), mask.shape
    for s in range(h * w):
        if mask.flat[s] and label.flat[s] < 0:
            stack = [s]
            label.flat[s] = s
            while stack:
                y, x = divmod(stack.pop(), w)
                for v in range(max(y - 1, 0), min(y + 2, h)):
                    for u in range(max(x - 1, 0), min(x + 2, w)):
                        if mask[v, u] and label[v, u] < 0:
                            label[v, u] = s
                            stack.append(v * w + u)
    return label


@pytest.fixture(scope="module")
def pictures():
    rnd = np.random.default_rng(3)
    noise = rnd.random((37, 90))
    comb = np.zeros((40, 61))
    comb[:, ::2], comb[-1, :] = 1, 1  # teeth that meet in the last row only
    spiral = np.zeros((31, 31))
    y, x, dy, dx, left = 0, 0, 0, 1, 31
    while left > 0:
        for _ in range(left):
            spiral[y, x] = 1
            y, x = y + dy, x + dx
        y, x, dy, dx, left = y - dy + dx, x - dx - dy, dx, -dy, left - 2
    return {"noise": noise, "comb": comb, "spiral": spiral, "none": np.zeros((5, 5)), "full": np.ones((9, 70))}


@pytest.mark.parametrize("height", [1, 4, 100])
def test_components_do_not_depend_on_strips(spark, pictures, height):
    rows = [(name, y, [float(v) for v in line]) for name, p in pictures.items() for y, line in enumerate(p)]
    frame = spark.createDataFrame(rows, "name string, y long, v array<double>").repartition(5)
    out = grids.components(grids.strips(frame, "name", "y", "v", height), 0.62)
    got = {(r["image"], r["label"]): tuple(r)[2:] for r in out.collect()}
    want = {}
    for name, p in pictures.items():
        labels = flood(p >= 0.62)
        for k in np.unique(labels[labels >= 0]):
            y, x = np.nonzero(labels == k)
            want[name, k] = (len(y), p[y, x].max(), pytest.approx(p[y, x].mean()), x.min(), y.min(), x.max(), y.max())
    assert got == want


def test_nulls_are_below(spark):
    frame = spark.createDataFrame([(1, 0, [None, 1.0, float("nan")])], "i int, y long, v array<double>")
    assert [tuple(r)[:3] for r in grids.components(grids.strips(frame, "i", "y", "v", 2), -5.0).collect()] == [(1, 1, 1)]


def test_connected(spark):
    rnd = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000 + int(a), 1000 + int(b)) for a, b in rnd.integers(0, 400, (250, 2))] + [(2000, k) for k in range(2001, 2100)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in parent}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_weights():
    assert np.allclose(grids.weights(4, 4), np.eye(4)) and np.allclose(grids.weights(1, 3), 1) and np.allclose(grids.weights(16, 224).sum(axis=1), 1)
    assert np.allclose(grids.weights(2, 4) @ [0.0, 1.0], [0, 0.25, 0.75, 1])


def test_resized_is_a_plain_reading(spark):
    grid = np.random.default_rng(2).random((16, 16))
    out = grids.resized(spark.createDataFrame([(1, [float(v) for v in grid.ravel()]), (2, None)], "i int, g array<double>"), "g", 16, 16, 224, 224).orderBy("i").collect()
    want = np.zeros((224, 224))
    for y in range(224):
        for x in range(224):
            at = [min(max((k + 0.5) * 16 / 224 - 0.5, 0), 15) for k in (y, x)]
            (a, b), (c, d) = [(int(k), min(int(k) + 1, 15)) for k in at]
            fy, fx = at[0] - a, at[1] - c
            want[y, x] = (grid[a, c] * (1 - fx) + grid[a, d] * fx) * (1 - fy) + (grid[b, c] * (1 - fx) + grid[b, d] * fx) * fy
    assert np.allclose(np.array(out[0]["g"]).reshape(224, 224), want, atol=1e-12) and out[1]["g"] is None
    with pytest.raises(Exception, match="another size"):
        grids.resized(spark.createDataFrame([(1, [1.0])], "i int, g array<double>"), "g", 2, 2, 3, 3).collect()


@pytest.mark.parametrize("height", [3, 8])
def test_tiles_over_borders(spark, height):
    rnd = np.random.default_rng(4)
    picture, scope = rnd.integers(0, 256, (20, 33)), rnd.integers(0, 2, (20, 33))
    rows = [("p", y, picture[y].tolist(), scope[y].tolist()) for y in range(20)]
    frame = spark.createDataFrame(rows, "image string, y long, v array<int>, s array<int>")
    pack = lambda c: grids.strips(frame, "image", "y", c, height).select("image", "y", "width", grids.mask_bytes(F.col("values")).alias("bytes"))
    raster = pack("v").join(pack("s").withColumnRenamed("bytes", "scope"), ["image", "y", "width"])
    boxes = [(0, 0, 5), (7, 2, 9), (30, 15, 8), (-3, -2, 6), (0, 40, 4), (2, 1, 20)]
    tiles = spark.createDataFrame([("p", *b) for b in boxes] + [("absent", 0, 0, 2)], "image string, x long, y long, side long")
    got = {tuple(r)[:4]: r["sha256"] for r in grids.tile_digests(raster, tiles, height).collect()}
    want = {}
    for x, y, side in boxes:
        tile = np.full((side, side), 127)
        for i in range(side):
            for j in range(side):
                if 0 <= y + i < 20 and 0 <= x + j < 33 and scope[y + i, x + j]:
                    tile[i, j] = picture[y + i, x + j]
        want["p", x, y, side] = hashlib.sha256(f"{x}:{y}:{side}:GRAY8:".encode() + tile.astype(np.uint8).tobytes()).hexdigest()
    want["absent", 0, 0, 2] = hashlib.sha256(b"0:0:2:GRAY8:" + bytes([127] * 4)).hexdigest()
    assert got == want
