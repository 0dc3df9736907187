import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import rectangles

KIND = "image int, x double, y double, width double, height double, _row long"


def boxes(rnd, n, images=3):
    side = np.exp(rnd.normal(1.5, 1.5, (n, 2)))
    return [(int(i), float(round(x)), float(y), float(np.ceil(w)), float(h), k) for k, (i, (x, y), (w, h)) in enumerate(zip(rnd.integers(0, images, n), rnd.uniform(-100, 300, (n, 2)), side))]


def brute(a, b):
    return sorted((p[5], q[5]) for p in a for q in b if p[0] == q[0] and p[1] < q[1] + q[3] and q[1] < p[1] + p[3] and p[2] < q[2] + q[4] and q[2] < p[2] + p[4])


@pytest.mark.parametrize("dense", [1 << 20, 5])
def test_pairs_as_brute_force_and_once(spark, dense):
    rnd = np.random.default_rng(1)
    a, b = boxes(rnd, 300), boxes(rnd, 200)
    b += [(0, -500.0, -500.0, 2000.0, 2000.0, 900), (1, 10.0, 10.0, 0.0, 5.0, 901)]  # one over everything, one without area
    pairs = rectangles.meeting(spark.createDataFrame(a, KIND).repartition(3), spark.createDataFrame(b, KIND).repartition(2), "image", dense)
    assert sorted((r["l"]["_row"], r["r"]["_row"]) for r in pairs.collect()) == brute(a, [q for q in b if q[3] > 0])


def test_touching_edges_and_equal_boxes(spark):
    kind = "image int, x int, y int, width int, height int, name string"
    rows = spark.createDataFrame([(1, 0, 0, 4, 4, "a"), (1, 0, 0, 4, 4, "a"), (1, 4, 0, 4, 4, "edge"), (2, 0, 0, 4, 4, "elsewhere"), (None, 0, 0, 9, 9, "null")], kind)
    others = spark.createDataFrame([(1, 0, 4, 4, 4, "below"), (1, 3, 3, 1, 1, "in"), (1, 3, 3, 1, 1, "in"), (None, 0, 0, 9, 9, "null")], kind)
    assert [r["name"] for r in rectangles.touched(rows, others, "image").collect()] == ["a", "a"]
    assert rectangles.touched(rows.limit(0), others, "image").count() == 0 and rectangles.touched(rows, others.limit(0), "image").count() == 0


def test_one_crowded_image_is_in_many_tasks(spark):
    """All boxes of one image, half of them in one place: no task compares more than a small part of the pairs."""
    n = 3000
    rows = spark.range(n).select(F.lit(7).alias("image"), *[F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id") * 3.0).alias(c) for c in "xy"], F.lit(4.0).alias("width"), F.lit(4.0).alias("height"), F.col("id").alias("_row"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(before, ("false", "-1", "32")):
        spark.conf.set(k, v)
    try:
        met = rectangles.meeting(rows, rows, "image", dense=20_000)
        by_task = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(by_task) >= (n // 2) ** 2 and max(by_task) < sum(by_task) / 8


def test_crowded_boxes_meet_few_regions(spark, monkeypatch):
    """As brute force, and of 2,000 boxes over 2,000 regions only few are held against all of these."""
    rnd = np.random.default_rng(3)
    a, b = boxes(rnd, 2000, 1), [(0, float(x), float(y), 60.0, 50.0, k) for k, (x, y) in enumerate(rnd.integers(-100, 300, (2000, 2)))]
    a += [(0, 900.0 + i, 900.0, 2.0, 2.0, 5000 + i) for i in range(5)]  # far from all regions
    met, meeting = [], rectangles.meeting
    monkeypatch.setattr(rectangles, "meeting", lambda left, *rest: met.append(left.count()) or meeting(left, *rest))
    have = sorted(r["name"] for r in rectangles.touched(spark.createDataFrame(a, KIND).withColumnRenamed("_row", "name"), spark.createDataFrame(b, KIND), "image").collect())
    assert have == sorted({x for x, _ in brute(a, b)}) and sum(met) < 100
