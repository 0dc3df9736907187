import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import metrics, running


def auroc(labels, scores):
    pairs = [(p > n) + (p == n) / 2 for p, y in zip(scores, labels) if y for n, z in zip(scores, labels) if not z]
    return sum(pairs) / len(pairs) if pairs else None


@pytest.mark.parametrize("labels, scores, want", [([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9], 1.0), ([0, 1], [0.5, 0.5], 0.5), ([0, 0], [0.1, 0.2], None)])
def test_auroc_hand_values(spark, labels, scores, want):
    rows = spark.createDataFrame([("a", bool(y), x) for y, x in zip(labels, scores)], "category string, y boolean, score double")
    assert metrics.auroc(rows, ["category"], "score", F.col("y")).first()["auroc"] == want


def test_auroc_random_and_partitioning(spark):
    rnd = random.Random(1)
    data = [(c, rnd.random() < 0.3, rnd.randrange(40) / 4) for c in "ab" for _ in range(300)]
    rows = spark.createDataFrame(data, "category string, y boolean, score double")
    for parts in (1, 7):
        got = {r["category"]: r["auroc"] for r in metrics.auroc(rows.repartition(parts), ["category"], "score", F.col("y")).collect()}
        for c in "ab":
            assert got[c] == pytest.approx(auroc([y for k, y, _ in data if k == c], [x for k, _, x in data if k == c]))


def test_summary_hand_values(spark):
    rows = spark.createDataFrame([("a", "NOMINAL", 0.2), ("a", "ANOMALY", 0.8), ("a", "ANOMALY", 0.1)], "category string, kind string, score double")
    r = metrics.metric_summary(rows, spark.createDataFrame([("a", 0.5)], "category string, threshold double")).first()
    assert (r["nominal_above_rate"], r["anomaly_above_rate"], r["auroc"]) == (0.0, 0.5, 0.5)
    only = metrics.metric_summary(rows.filter("kind = 'NOMINAL'"), spark.createDataFrame([("a", 0.2)], "category string, threshold double")).first()
    assert only["anomaly_above_rate"] is None and only["auroc"] is None and only["nominal_above_rate"] == 0.0  # strictly greater


@pytest.mark.parametrize("n", [1, 2, 3, 19, 20, 21, 100])
def test_quantile_definitions(spark, n):
    rnd = random.Random(n)
    x = sorted(round(rnd.uniform(-5, 5), 2) for _ in range(n))
    rows = spark.createDataFrame([("a", v) for v in x] + [("a", None)], "g string, x double")
    r = running.order_statistics(rows, ["g"], "x", {"p95": "p95", "upper": "upper_median", "median": "median", "q95": "q95"}).first()
    assert r["n"] == n and r["p95"] == x[math.ceil(0.95 * n) - 1] and r["upper"] == x[n // 2]
    assert r["median"] == pytest.approx(statistics.median(x)) and r["q95"] == pytest.approx(np.percentile(x, 95))


def test_confusion_undefined_is_null(spark):
    rows = spark.createDataFrame([("a", "f", True, False), ("a", "n", False, False)], "c string, fam string, y boolean, p boolean")
    r = metrics.confusion_by_family(rows, "c", "fam", F.col("y"), F.col("p")).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (0, 0, 1, 1) and r["precision"] is None and r["recall"] == 0.0 and r["f1"] is None
    r = metrics.confusion(rows, ["c"], F.col("y"), F.col("p")).first()
    assert r["precision"] is None and r["f1"] is None


def brute_aupro(pixels, limit=0.3):
    sizes, normal = {}, 0
    for s, region, n in pixels:
        if region is None:
            normal += n
        else:
            sizes[region] = sizes.get(region, 0) + n
    fp = area = x0 = y0 = 0.0
    found = dict.fromkeys(sizes, 0)
    for s in sorted({p[0] for p in pixels}, reverse=True):
        for t, region, n in pixels:
            if t == s:
                if region is None:
                    fp += n
                else:
                    found[region] += n
        x, y = fp / normal, sum(found[r] / sizes[r] for r in sizes) / len(sizes)
        if x > limit:
            y = y0 + (limit - x0) / (x - x0) * (y - y0)
            return (area + (limit - x0) * (y + y0) / 2) / limit
        area, x0, y0 = area + (x - x0) * (y + y0) / 2, x, y
    return area / limit


def test_aupro(spark):
    rnd = random.Random(7)
    pixels = [(rnd.randrange(30) / 10, rnd.choice([None, None, None, 1, 2, 3]), rnd.randrange(1, 9)) for _ in range(200)]
    rows = spark.createDataFrame([("a", *p) for p in pixels], "c string, score double, region int, n long")
    assert metrics.aupro(rows, "c", "score", "region").first()["aupro"] == pytest.approx(brute_aupro(pixels))
    assert metrics.aupro(rows.filter("region is null"), "c", "score", "region").collect() == []


def test_empty(spark):
    rows = spark.createDataFrame([], "category string, kind string, score double, part string")
    limits = spark.createDataFrame([], "category string, threshold double")
    assert metrics.metric_summary(rows, limits).collect() == [] and metrics.calibration_summary(rows, part="part").collect() == [] and metrics.against_thresholds(rows, limits).collect() == []


def test_central_width(spark):
    rows = spark.createDataFrame([("a", x / 10, y / 10) for x in range(400) for y in range(60)] + [("b", 0.0, 0.0), ("b", 1.0, 1.0)], "k string, along double, across double")
    got = {r["k"]: r["width"] for r in metrics.central_width(rows, "k", "along", "across", -1.0).collect()}
    assert got["a"] == pytest.approx(5.9, abs=0.1) and got["b"] == -1.0


def test_no_task_has_all_of_a_skewed_group(spark):
    """One far value doesn't bring the others together: rows are cut by rank, not by value."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        rows = spark.range(20_000).selectExpr("'a' AS g", "id / 20000 AS x").unionByName(spark.sql("SELECT 'a' AS g, 1e12 AS x"))
        tasks = [r["count"] for r in running.range_sorted(rows, ["g", "x"], "skew").groupBy("_task").count().collect()]
        assert len(tasks) >= 4 and max(tasks) < 0.5 * 20_001
        r = running.order_statistics(rows, ["g"], "x", {"p95": "p95", "median": "median"}).first()
        assert (r["n"], r["p95"], r["median"]) == (20_001, 19_000 / 20_000, 10_000 / 20_000)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_overlap_counts_and_consistency(spark):
    cells = spark.createDataFrame([(p, a) for p, a, n in ((True, True, 3), (True, False, 2), (False, True, 1), (False, False, 4)) for _ in range(n)], "p boolean, a boolean")
    r = cells.agg(*[c.alias(n) for n, c in metrics.region_overlap_counts(F.col("p"), F.col("a")).items()]).first()
    assert (r["iou"], r["missing_ratio"], r["protruding_ratio"], r["area_delta"]) == (0.5, 0.25, 0.5, 0.25)
    rows = spark.createDataFrame([(1, 0.5, 0.1, 0.9), (2, 1.0, 0.1, 0.9), (3, None, 0.1, 0.9)], "case_id int, score double, mean_patch_distance double, max_patch_distance double")
    assert {r["case_id"] for r in metrics.inconsistent_scores(rows, "case_id").collect()} == {2, 3}


def test_pixel_localization_as_pixels(spark):
    rnd = random.Random(4)
    patches, masked, pixels = [], [], []
    for case in range(12):
        box = {(x, y): 1 + (x > 5) for x in range(2, 8) for y in range(case % 3, 5)} if case % 2 else {}
        for row in range(4):
            for col in range(4):
                score = rnd.randrange(6) / 10
                patches.append(("c", case, row, col, score))
                pixels += [("c", score, f"{case}/{box[2 * col + i, 2 * row + j]}" if (2 * col + i, 2 * row + j) in box else None, 1) for i in range(2) for j in range(2)]
        masked += [(case, x, y, r) for (x, y), r in box.items()]
    got = metrics.pixel_localization(spark.createDataFrame(patches, "c string, k int, row long, col long, score double"), spark.createDataFrame(masked, "k int, x int, y int, region int"), "c", "k", 2).first()
    frame = spark.createDataFrame(pixels, "c string, s double, r string, n long")
    area = metrics.aupro(frame, "c", "s", "r").first()["aupro"]
    curve = metrics.auroc(frame, ["c"], "s", F.col("r").isNotNull()).first()["auroc"]
    assert (got["mask_cases"], got["regions"]) == (6, 12) and got["aupro"] == pytest.approx(area) and got["pixel_auroc"] == pytest.approx(curve)
