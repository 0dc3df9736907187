import numpy as np
import pytest

from assaylake.llm import whitening

KIND = "vec_id long, embedding array<float>, label int, n string"


def frame(spark, vectors, parts=3):
    return spark.createDataFrame([(k, v, 1, "clash") for k, v in enumerate(vectors)], KIND).repartition(parts)


def by_hand(x):
    n = len(x)
    mean = x.mean(axis=0)
    v = (x - mean).T @ (x - mean) / n
    e, u = np.linalg.eigh(v)
    return e[::-1], ((x - mean) @ u[:, ::-1]), v


@pytest.mark.parametrize("shift", [0.0, 5000.0])
def test_as_numpy(spark, shift):
    rnd = np.random.default_rng(1)
    c = (rnd.normal(size=(300, 6)) @ rnd.normal(size=(6, 6)) + shift).astype(np.float32)
    rows = whitening.whitened(frame(spark, c.tolist())).collect()
    x = np.floor(64 * c.astype(float)) + 1_000_000
    e, turned, v = by_hand(x)
    assert len(rows) == 300 * 6 and {r["n"] for r in rows} == {300}
    got = np.zeros((300, 6))
    for r in rows:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(v), rel=1e-9)
    want = turned / np.sqrt(e)
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-6 and np.abs(got.T @ got / 300 - np.eye(6)).max() < 1e-9
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9
    exact = [[int(a) for a in r] for r in x]
    sums = [sum(r[d] for r in exact) for d in range(6)]
    assert {r["vec_id"]: int(r["deviation"]) for r in rows} == {k: sum((300 * r[d] - sums[d]) ** 2 for d in range(6)) for k, r in enumerate(exact)}


def test_polarised_is_exact(spark):
    """Covariances from squares alone equal products of whole numbers of any length."""
    rnd = np.random.default_rng(2)
    c = np.r_[rnd.normal(size=(40, 4)) * 1e6, rnd.normal(size=(3, 4)) * 1e9].astype(np.float32)
    rows = whitening.usable(frame(spark, c.tolist()), "embedding")
    x = [[int(v) for v in r] for r in np.floor(64 * c.astype(float)) + 1_000_000]
    n, sums = len(x), whitening.totals(rows, "embedding", 4)
    assert sums == [sum(r[d] for r in x) for d in range(4)]
    want = [[sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x) for j in range(4)] for i in range(4)]
    assert whitening.polarised(rows, "embedding", n, sums) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0, None], [nan, 1.0], [inf, 0.0], [1.0, 2.0, 3.0]]
    good = [[0.0, 1.0], [1.0, 0.5], [2.0, 3.0], [2.0, 3.0]]
    rows = whitening.whitened(frame(spark, bad + good)).collect()
    assert {r["vec_id"] for r in rows} == {6, 7, 8, 9} and {r["n"] for r in rows} == {4} and len(rows) == 8
    assert whitening.whitened(frame(spark, bad[:5])).count() == 0
    assert whitening.whitened(frame(spark, [[1.0, 2.0]]).limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_what_does_not_vary(spark):
    same = whitening.whitened(frame(spark, [[1.0, 2.0]] * 3)).collect()
    assert {(r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in same} == {(None, None, 0.0, 0)}
    line = whitening.whitened(frame(spark, [[float(k), 2.0 * k] for k in range(5)])).collect()
    assert {r["component"]: r["whitened"] is None for r in line} == {1: False, 2: True} and line[0]["identity_error"] < 1e-9
    huge = whitening.whitened(frame(spark, [[3e38, 0.0], [-3e38, 1.0], [0.0, 2.0]])).collect()
    assert len(huge) == 6 and all(np.isfinite(r["whitened"]) for r in huge if r["component"] == 1)
