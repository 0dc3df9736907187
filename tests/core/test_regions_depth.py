import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.functions import geometry
from assaylake.operators import augment, depth, regions


def test_components_are_8_connected_in_raster_order():
    mask = np.array([[0, 1, 0, 0, 1], [1, 0, 0, 0, 1], [0, 0, 0, 0, 0], [1, 1, 0, 1, 0], [0, 0, 1, 0, 0]], bool)
    labels, n = regions.label(mask)
    assert n == 3 and labels[0, 1] == labels[1, 0] == 1 and labels[0, 4] == labels[1, 4] == 2 and labels[3, 0] == labels[3, 3] == labels[4, 2] == 3


@pytest.mark.parametrize("seed", range(5))
def test_components_as_flood_fill(seed):
    mask = np.random.default_rng(seed).random((20, 17)) < 0.4
    labels, n = regions.label(mask)
    seen, count = np.zeros(mask.shape, int), 0
    for y in range(20):
        for x in range(17):
            if mask[y, x] and not seen[y, x]:
                count += 1
                stack = [(y, x)]
                seen[y, x] = count
                while stack:
                    a, b = stack.pop()
                    for c in range(max(0, a - 1), min(20, a + 2)):
                        for d in range(max(0, b - 1), min(17, b + 2)):
                            if mask[c, d] and not seen[c, d]:
                                seen[c, d] = count
                                stack.append((c, d))
    assert n == count and (labels == seen).all()


def test_region_table(spark):
    grid = [0.0] * 16
    for i in (0, 1, 4):
        grid[i] = 1.0
    grid[15] = 4.0
    rows = regions.components(spark.createDataFrame([(1, grid), (2, [0.0] * 16)], "k int, g array<double>"), "k", "g", 4, 1.0)
    got = [tuple(r)[1:] for r in regions.rank_regions(rows, "k", 1).drop("rank").collect()]
    assert got == [(2, 1, 3, 3, 1, 1, 1.0, 1.0, "R-001")]
    assert regions.keep_large(rows, "k", least=2).select("label").collect()[0][0] == 1
    boxes = spark.createDataFrame([(1, "R-001", 0, 0, 2, 2), (1, "R-002", 0, 0, 2, 2)], "k int, region_id string, x int, y int, width int, height int")
    assert [(r["region_id"], r["label"]) for r in regions.assign_boxes(boxes, rows, "k").collect()] == [("R-001", 1)]
    touched = regions.touching(boxes.withColumn("x", F.when(F.col("region_id") == "R-002", 2).otherwise(0)), rows.filter("label = 1"), "k").collect()
    assert [r["region_id"] for r in touched] == ["R-001"]  # touching edges don't count


def covered(x, y, w, h, found):
    """Whether the seen centres of the tiles cover the box, but for rounding."""
    xs, ys = sorted({t[0] for t in found}), sorted({t[1] for t in found})
    side = found[0][2]
    edge, seen = side / 16, side * 7 / 8
    for at, upto, starts in ((x, x + w, xs), (y, y + h, ys)):
        for start in starts:
            if start + edge <= at + 1:
                at = max(at, start + edge + seen)
        if at < upto - 1:
            return False
    return True


def test_tiles_cover(spark):
    rnd = random.Random(3)
    boxes = []
    for k in range(200):
        w, h = rnd.randrange(250, 2000), rnd.randrange(250, 2000)
        x, y = rnd.randrange(w - 50), rnd.randrange(h - 50)
        boxes.append((k, w, h, [(float(x), float(y), float(rnd.randrange(20, w - x)), float(rnd.randrange(20, h - y)))]))
    boxes += [(200, 1000, 1000, [(0.0, 0.0, 100.0, 100.0)]), (201, 1000, 1000, [(0.0, 0.0, 100.0, 100.0)] * 2), (202, 1000, 1000, [])]
    frame = spark.createDataFrame(boxes, "k int, w int, h int, r array<struct<x:double,y:double,width:double,height:double>>")
    rows = frame.select("*", geometry.tiles_of(F.col("r"), F.col("w"), F.col("h")).alias("t")).collect()
    for r in rows:
        found = [tuple(t) for t in r["t"]]
        assert found == sorted(set(found), key=lambda t: (t[1], t[0], t[2])) and all(0 <= a <= r["w"] - s and 0 <= b <= r["h"] - s for a, b, s in found)
        if r["k"] < 200:
            x, y, w, h = r["r"][0]
            margin = found[0][2] / 16 + 1  # where tiles are pushed inside, their margins see what is left
            assert covered(max(x, margin), max(y, margin), min(x + w, r["w"] - margin) - max(x, margin), min(y + h, r["h"] - margin) - max(y, margin), found)
    assert [tuple(t) for t in rows[200]["t"]] == [tuple(t) for t in rows[201]["t"]] == [(0, 0, 224)] and rows[202]["t"] == []
    starts = lambda a, n, w: spark.range(1).select(geometry.window_starts(F.lit(a), F.lit(n), F.lit(w))).first()[0]
    assert starts(0.0, 100.0, 50.0) == [0.0, 35.0, 50.0] and starts(10.0, 20.0, 50.0) == [-5.0] and starts(0.0, 50.0, 50.0) == [0.0]


def test_geometry_columns(spark):
    quad = lambda p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p])
    a = [(0, 0), (1, 0), (1, 1), (0, 1)]
    lit = lambda *v: [F.lit(float(x)) for x in v]
    hit = geometry.plane_intersection(lit(0, 0, 1), lit(0, 0, 1), lit(0, 0, 10), F.lit(-2.0))
    r = spark.range(1).select(geometry.quad_residual(quad(a), quad(a[2:] + a[:2])), geometry.quad_residual(quad(a), quad(a[::-1])), hit[2], geometry.front_offset(lit(0, 0, 1), F.lit(7.0), lit(0, 0, -1), lit(0, 0, 10)), *geometry.dimension_uncertainty(F.lit(0.5), F.lit(4.0)).values()).first()
    assert list(r)[:5] == [0.0, 0.0, 8.0, 3.0, 1.0] and r[5] == pytest.approx(2 + np.pi / 4)


def test_morphology_and_scopes(spark):
    dot = np.zeros((5, 5), bool)
    dot[2, 2] = True
    assert regions.morph(dot, 1, True).sum() == 5 and regions.morph(regions.morph(dot, 1, True), 1, False).sum() == 1
    r = regions.scopes(spark.createDataFrame([(1, dot.ravel().tolist())], "k int, m array<boolean>"), "k", "m", 5, 1, 1).first()
    assert sum(r["support"]) == 5 and sum(r["boundary"]) == 5


def test_overlap_mean_and_mutual(spark):
    tiles = spark.createDataFrame([(1, 0, 0, 2, [1.0] * 4), (1, 1, 0, 2, [3.0] * 4)], "k int, x int, y int, side int, v array<double>")
    got = {(r["px"], r["py"]): r["value"] for r in regions.overlap_mean(tiles, "k", "v", "side").collect()}
    assert got[0, 0] == 1.0 and got[1, 1] == 2.0 and got[2, 0] == 3.0
    pairs = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9), (2, 1, 0.5), (2, 2, 0.55)], "a int, b int, d double")
    assert [(r["a"], r["b"]) for r in regions.mutual_nearest(pairs, "a", "b", "d").collect()] == [(1, 1)]


def test_densest_window_as_brute_force(spark):
    rnd = random.Random(9)
    data = [(c, rnd.gauss(0, 20)) for c in "ab" for _ in range(400)] + [("a", None)]
    got = {r["c"]: (r["start"], r["n"]) for r in depth.densest_window(spark.createDataFrame(data, "c string, x double"), "c", "x", 2.5).collect()}
    for c in "ab":
        x = [v for k, v in data if k == c and v is not None]
        assert got[c] == max(((sum(s <= v <= s + 5.0 for v in x), s) for s in x))[::-1]


def test_fits(spark):
    x = np.linspace(1, 5, 60)
    y = 2 * x + 1
    y[::10] += 50
    flat = [("line", float(a), float(b)) for a, b in zip(x, y)] + [("falling", float(a), -float(b)) for a, b in zip(x, y)] + [("few", 1.0 * k, 2.0 * k) for k in range(15)] + [("one x", 1.0, 1.0 * k) for k in range(30)]
    flat += [("exact", 1.0 * k, 3.0 * k) for k in range(20)] + [("null", None, 1.0)]
    fits = {r["k"]: (r["slope"], r["intercept"]) for r in depth.affine_fits(spark.createDataFrame(flat, "k string, x double, y double"), "k", "x", "y").collect()}
    assert fits.pop("line") == pytest.approx((2.0, 1.0)) and fits.pop("exact") == pytest.approx((3.0, 0.0), abs=1e-9) and set(fits.values()) == {(None, None)} and set(fits) == {"falling", "few", "one x", "null"}
    pixels = [(1, r, c, 0.01 * r + 0.02 * c + (0.5 if 12 <= r < 24 and c < 12 and raised else 0.0), not (r >= 12 and c < 12), r >= 12 and c < 12, k) for k, raised in (("flat", 0), ("front", 1)) for r in range(24) for c in range(24)]
    rows = spark.createDataFrame([(k, *p) for *p, k in [(r, c, d, b, s, k) for _, r, c, d, b, s, k in pixels]], "k string, row int, col int, inverse_depth double, is_board boolean, is_subject boolean")
    got = {r["k"]: r["observation"] for r in depth.coplanarity(rows, "k").collect()}
    assert got == {"flat": "COPLANAR_CANDIDATE", "front": "NON_COPLANAR_RISK"}
    assert depth.coplanarity(rows.filter("row < 2"), "k").first()["observation"] == "BOARD_SUPPORT_INSUFFICIENT"


def test_augmentation(spark):
    parents = spark.createDataFrame([("p", "s")], "case_id string, source_sha256 string")
    ranges = [("rotation", -4.0, 4.0), ("scale", -0.1, 0.1)]
    rows = augment.plan(parents, 2, "anchor").withColumn("p", augment.sampled(F.col("seed"), ranges))
    got = rows.orderBy("variant_id").collect()
    rng = random.Random(int(got[0]["seed"]))
    assert got[0]["p"] == {"rotation": round(rng.uniform(-4, 4), 8), "scale": round(rng.uniform(-0.1, 0.1), 8)} and got[0]["child_case_id"] == "p/augmented/01" and got[0]["seed"] != got[1]["seed"]
    assert augment.out_of_bounds(rows, "p", ranges, "child_case_id").collect() == []
    assert {(r["parameter"]) for r in augment.out_of_bounds(rows, "p", [("rotation", 5.0, 6.0), ("gamma", 0.0, 1.0)], "child_case_id").collect()} == {"rotation", "gamma", "scale"}


def test_affine_fits_as_least_squares(spark):
    rnd = np.random.default_rng(5)
    data = {k: (rnd.normal(size=200), rnd.normal(size=200)) for k in range(4)}
    for k, (x, e) in data.items():
        e[: 10 * k] += 30
    rows = spark.createDataFrame([(k, float(a), float(2 * a + 1 + 0.1 * b)) for k, (x, e) in data.items() for a, b in zip(x, e)], "k int, x double, y double")
    for r in depth.affine_fits(rows, "k", "x", "y").collect():
        x, e = data[r["k"]]
        y, kept = 2 * x + 1 + 0.1 * e, np.ones(200, bool)
        for _ in range(4):
            slope, intercept = np.polyfit(x[kept], y[kept], 1)
            off = y - slope * x - intercept
            far = np.abs(off - np.median(off[kept]))
            kept = far <= 3.5 * 1.4826 * np.median(far[kept])
        assert (r["slope"], r["intercept"]) == pytest.approx((slope, intercept), abs=1e-9)


def test_dominant_layer_and_posterior(spark):
    rnd = random.Random(2)
    data = [("a", rnd.gauss(0, 1)) for _ in range(300)] + [("a", rnd.gauss(50, 1)) for _ in range(320)] + [("b", float(k)) for k in range(300)]
    rows = spark.createDataFrame(data, "k string, x double")
    got = {r["k"]: r for r in depth.dominant_layer(rows, "k", "x", 4.0, least=100, share=0.3).collect()}
    near = np.array([x for k, x in data if k == "a" and x > 25])
    assert set(got) == {"a"} and got["a"]["n"] == 320 and got["a"]["offset"] == pytest.approx(np.median(near)) and got["a"]["spread"] == pytest.approx(np.percentile(np.abs(near - np.median(near)), 95))
    band = depth.posterior(F.lit(20.0), F.lit(2.0), F.lit(1.0))
    low, high = band["lower95"], band["upper95"]
    r = spark.range(1).select(band["offset"], low, high, depth.improves_prior(low, high, F.lit(0.0), F.lit(60.0)), depth.improves_prior(low, high, F.lit(10.0), F.lit(60.0)), depth.improves_prior(low, F.lit(None), F.lit(0.0), F.lit(60.0))).first()
    assert list(r) == [20.0, 9.0, 31.0, True, False, False]


def test_subject_scopes_at_the_limit(spark, tmp_path):
    """An entry that is stored as 0.15 is no part of the subject, as in the SQL."""
    import duckdb

    from assaylake.plans import scans

    rows = [(1, [0.15] * 64), (2, [0.15] * 9 + [0.16] + [0.15] * 54), (3, [float(np.nextafter(np.float32(0.15), np.float32(1)))] + [0.0] * 63)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(scans.ORACLES["subject_scopes"]).fetchall())
    assert sorted(map(tuple, scans.subject_scopes(spark, str(tmp_path)).collect())) == want
    assert [r[1] for r in want] == [0, 11, 6]


@pytest.mark.parametrize("wide", [3, 12, 1000])
def test_mutual_points_as_over_all_pairs(spark, wide):
    """Many points in few places with ties, clusters with far outliers, an image with one target and one without; the pairs themselves aren't made."""
    rnd = np.random.default_rng(wide)
    points = lambda n, first: [(int(i), first + k, int(x), int(y)) for k, (i, x, y) in enumerate(np.c_[rnd.integers(0, 2, n), rnd.integers(0, wide, (n, 2))].tolist())] + [(0, first + n, 9 * wide + first, -7 * wide)]
    a, b = points(60, 0) + [(2, 100, 5, 5), (2, 101, 50, 5), (3, 102, 1, 1)], points(50, 1000) + [(2, 1100, 0, 0)]
    kind = "image int, {0} int, x int, y int"
    left, right = spark.createDataFrame(a, kind.format("a")), spark.createDataFrame(b, kind.format("b"))
    pairs = spark.createDataFrame([(p[1], q[1], float(abs(p[2] - q[2]) + abs(p[3] - q[3]))) for p in a for q in b if p[0] == q[0]], "a int, b int, distance double")
    want = sorted(map(tuple, regions.mutual_nearest(pairs, "a", "b", "distance").collect()))
    assert sorted(map(tuple, regions.mutual_nearest_points(left, right, "image", "a", "b").select("a", "b", "distance").collect())) == want and (100, 1100, 10.0) in want


def test_small_groups_are_fitted_after_one_shuffle(spark, monkeypatch):
    """Groups that a task may hold give what larger ones give, with outliers, few rows and one x, and without a table for each pass."""
    rnd, rows = np.random.default_rng(5), [("one-x", 1.0, float(i)) for i in range(20)] + [("few", float(i), float(i)) for i in range(15)] + [("empty", None, 1.0), ("even", 0.0, 0.0)] + [("even", float(i), 2.0 * i) for i in range(30)]
    for k in ("p", "q"):
        x = rnd.uniform(0, 10, 80)
        rows += [(k, float(a), float(2 * a + 1 + e)) for a, e in zip(x, np.where(np.arange(80) % 9 == 0, 40.0, rnd.normal(0, 0.2, 80)))]
    points = spark.createDataFrame(rows, "k string, x double, y double")
    told = lambda d: {r["k"]: (r["slope"] and round(r["slope"], 9), r["intercept"] and round(r["intercept"], 9)) for r in d.collect()}
    large, mixed = told(depth.affine_fits(points, "k", "x", "y", small=0)), told(depth.affine_fits(points, "k", "x", "y", small=50))
    written, materialize = [], depth.materialize
    monkeypatch.setattr(depth, "materialize", lambda d, name, *rest: written.append(name) or materialize(d, name, *rest))
    assert told(depth.affine_fits(points, "k", "x", "y")) == large == mixed and len(large) == 6
    assert len(written) == 2 and large["few"] == large["one-x"] == (None, None) and abs(large["p"][0] - 2) < 0.1
