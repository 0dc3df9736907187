import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.functions import vectors
from assaylake.operators import scoring


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("block, values", [(1, 0), (3, 0), (1024, 0), (1024, scoring.BANK_VALUES)])
def test_nearest_as_brute_force(spark, block, values):
    rng = np.random.default_rng(7)
    data = {c: (rng.normal(size=(20, 4)), rng.normal(size=(9, 4))) for c in (1, 2)}
    frame = lambda k: spark.createDataFrame([(c, 100 * c + i, [float(x) for x in v]) for c, d in data.items() for i, v in enumerate(d[k])], "c int, k long, v array<double>")
    got = {r["k"]: (r["distance"], r["nearest"]) for r in scoring.nearest(frame(0), frame(1), "c", "k", "v", block, values).collect()}
    for c, (q, b) in data.items():
        d = np.clip(1 - unit(q) @ unit(b).T, 0, 2)
        for i in range(20):
            assert got[100 * c + i][0] == pytest.approx(d[i].min(), abs=1e-9) and got[100 * c + i][1] == 100 * c + d[i].argmin()


def test_clusters_leave_most_products_out():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    draw = lambda n: unit(centres[rng.integers(0, 40, n)] + 0.05 * rng.normal(size=(n, 16)))
    bank, queries = draw(1600), draw(500)
    keys = rng.permutation(1600)
    held = scoring.Clusters(keys, bank)
    distance, key = held.nearest(queries)
    d = 1 - queries @ bank.T
    assert np.allclose(distance, d.min(axis=1), atol=1e-12) and np.array_equal(key, keys[d.argmin(axis=1)])
    assert held.products < 500 * 1600 / 5
    spread = rng.normal(size=(300, 8))  # nothing to prune: still exact
    held = scoring.Clusters(np.arange(300), spread)
    assert np.array_equal(held.nearest(queries[:, :8] / np.linalg.norm(queries[:, :8], axis=1, keepdims=True))[1], (queries[:, :8] @ unit(spread).T).argmax(axis=1))


def test_small_banks_move_no_query(spark):
    rows = spark.createDataFrame([(1, k, [1.0, float(k)]) for k in range(5)], "c int, k long, v array<double>")
    plan = scoring.nearest(rows, rows, "c", "k", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_ties_and_bad_vectors(spark):
    bank = spark.createDataFrame([(1, 5, [1.0, 0.0]), (1, 3, [2.0, 0.0])], "c int, k long, v array<double>")
    query = spark.createDataFrame([(1, 1, [1.0, 1.0]), (2, 2, [1.0, 1.0])], "c int, k long, v array<double>")
    assert [(r["k"], r["nearest"]) for r in scoring.nearest(query, bank, "c", "k", "v").collect()] == [(1, 3)]
    for bad in ([0.0, 0.0], [float("nan"), 1.0]):
        with pytest.raises(Exception, match="non-finite|zero norm"):
            scoring.nearest(spark.createDataFrame([(1, 1, bad)], "c int, k long, v array<double>"), bank, "c", "k", "v").collect()
    with pytest.raises(ValueError):
        scoring.nearest(query, bank, "c", "k", "v", 0)


def test_patch_top_k_hand_values(spark):
    query = spark.createDataFrame([(1, 7, [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])], "c int, case long, p array<array<double>>")
    bank = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])], "c int, key long, vector array<double>")
    rows = scoring.patch_rows(query, "c", "case", "p")
    r = scoring.patch_scores(rows, bank, "c", "case", 2).first()
    assert (r["score"], r["max_patch_distance"]) == (0.5, 1.0) and r["mean_patch_distance"] == pytest.approx(1 / 3)
    with pytest.raises(Exception, match="TOP_K_INVALID"):
        scoring.patch_scores(rows, bank, "c", "case", 4).collect()


def test_vector_expressions(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    r = df.select(vectors.cosine_distance(a, b), vectors.cosine_distance(a, a), vectors.patch_cosine_distance(a, z), vectors.normalised(b), vectors.patches(b, 1), vectors.top_k_mean(b, 1), vectors.cosine_distance(a, F.lit(None).cast("array<double>"))).first()
    assert list(r) == [1.0, 0.0, 0.0, [0.0, 1.0], [[0.0], [2.0]], 2.0, None]
    for bad in (vectors.cosine_distance(a, z), vectors.normalised(z), vectors.patches(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), 2), vectors.top_k_mean(a, 3), vectors.cosine_distance(a, F.array(F.lit(1.0)))):
        with pytest.raises(Exception, match="INVALID|MISMATCH"):
            df.select(bad).collect()


def test_references(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "case_id int, v array<double>")
    known = spark.createDataFrame([("c", [1.0, 0.0]), ("b", [3.0, 0.0]), ("a", [0.0, 1.0])], "ref string, v array<double>")
    found = scoring.distances_to_references(rows, known, "case_id", "v", "ref")
    got = {r["case_id"]: tuple(r)[1:] for r in scoring.summarised(found, "case_id").collect()}
    assert got[1] == ("b", 0.0, pytest.approx(1 / 3), 1.0) and got[2] == ("a", 0.0, pytest.approx(2 / 3), 1.0)
    assert {r["global_distance"] for r in scoring.summarised(found, "case_id", nearest_only=True).collect()} == {0.0}
    assert scoring.distances_to_references(rows, known.limit(0), "case_id", "v", "ref").collect() == []
    with pytest.raises(Exception, match="zero norm"):
        scoring.distances_to_references(rows, spark.createDataFrame([("z", [0.0, 0.0])], known.schema), "case_id", "v", "ref").collect()
    m = scoring.mean_vectors(spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0])], "k int, v array<double>"), "k", "v").first()
    assert m["mean"] == [2.0, 3.0]
    with pytest.raises(Exception, match="MISMATCH"):
        scoring.mean_vectors(spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0])], "k int, v array<double>"), "k", "v").collect()


def test_one_category_is_spread(spark, monkeypatch):
    """Without a broadcast the products of one category run in several tasks, and the results are those of one block."""
    monkeypatch.setattr(scoring, "SHARE", 1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([("a", k, rng.normal(size=4).tolist()) for k in range(400)], "c string, k long, v array<double>")
    bank = spark.createDataFrame([("a", k, rng.normal(size=4).tolist()) for k in range(60)], "c string, k long, v array<double>")
    want = sorted(map(tuple, scoring.nearest(rows, bank, "c", "k", "v", block=1000).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = scoring.nearest(rows, bank, "c", "k", "v", block=20, values=0)
        got = sorted(map(tuple, found.collect()))
        plan = found._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [(c, k, n) for c, k, _, n in got] == [(c, k, n) for c, k, _, n in want] and np.allclose([r[2] for r in got], [r[2] for r in want])
    assert "_share" in plan and "_at" in plan
