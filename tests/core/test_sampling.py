import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.functions import twister
from assaylake.operators import augment, calibration, photometry

LIMITS = {"rotation_degrees": 4.0, "scale_delta": 0.05, "translation": 0.03, "corner_jitter": 0.02, "exposure_ev": 0.5, "gamma_delta": 0.1, "white_balance_delta": 0.05, "shading_strength": 0.1, "vignette_strength": 0.1, "noise_std": 3.0, "quality_min": 70, "quality_max": 95}


def test_sample_is_cpythons():
    rnd = random.Random(5)
    seeds = [0, 1, -7, 2**32 - 1, 2**32, 2**64 - 1, 10**30] + [rnd.getrandbits(64) for _ in range(6000)]
    draws = twister.camera_draws(LIMITS)
    got = twister.sample(seeds, draws)
    assert all([v[i] for v in got] == twister._plain(s, draws) for i, s in enumerate(seeds))


def test_many_draws_and_hard_ranges():
    many = [("uniform", str(k), -1.0, 2.0, 0.0) for k in range(700)]
    got = twister.sample([3, 4], many)
    assert [v[1] for v in got] == twister._plain(4, many)
    # Half of all words are refused here; some seeds are left to the plain generator.
    hard = [("integer", str(k), 0, 2**16) for k in range(40)]
    got = twister.sample(range(300), hard)
    assert all([v[s] for v in got] == twister._plain(s, hard) for s in range(300))
    assert [len(v) for v in twister.sample([], hard)] == [0] * 40


def test_columns(spark):
    rows = spark.createDataFrame([(k, None if k == 3 else str(2**60 + k)) for k in range(6)], "k int, seed string").repartition(3)
    got = {r["k"]: r["p"] for r in rows.select("k", augment.camera_parameters(F.col("seed"), LIMITS).alias("p")).collect()}
    want = twister._plain(2**60 + 1, twister.camera_draws(LIMITS))
    assert list(got[1].asDict().values()) == [*want[:-1], str(want[-1])] and set(got[3].asDict().values()) == {None}
    maps = {r["k"]: r["p"] for r in rows.select("k", augment.sampled(F.col("seed"), [("a", 0.0, 1.0)]).alias("p")).collect()}
    assert maps[0] == {"a": round(random.Random(2**60).uniform(0.0, 1.0), 8)} and maps[3] is None


def strips(spark, picture, high, parts, **changed):
    p = dict(exposure_ev=0.1, red_gain=1.02, blue_gain=0.97, gamma=1.1, shading_strength=0.1, shading_angle_degrees=40.0, vignette_strength=0.1, noise_std=4.0, noise_seed=99, lens_strength=0.02, lens_x=0.1, lens_y=-0.1) | changed
    kinds = ", ".join(f"{n} {'long' if n == 'noise_seed' else 'double'}" for n in photometry.PARAMETERS)
    rows = [("i", y, picture.shape[1], picture[y : y + high].astype(np.uint8).tobytes(), len(picture), *(p[n] for n in photometry.PARAMETERS)) for y in range(0, len(picture), high)]
    return spark.createDataFrame(rows, f"image string, y int, width int, rgb binary, height int, {kinds}").repartition(parts)


def test_photometry_does_not_depend_on_partitioning(spark):
    picture = np.random.default_rng(1).integers(0, 256, (24, 17, 3))
    made = []
    for high, parts in ((24, 1), (5, 3), (1, 8)):
        out = photometry.photometric(strips(spark, picture, high, parts)).orderBy("y").collect()
        made.append(b"".join(bytes(r["rgb"]) for r in out))
    assert made[0] == made[1] == made[2] and len(made[0]) == picture.size
    still = photometry.photometric(strips(spark, picture, 24, 1, exposure_ev=0.0, red_gain=1.0, blue_gain=1.0, gamma=1.0, shading_strength=0.0, vignette_strength=0.0, noise_std=0.0, lens_strength=None, lens_x=None, lens_y=None)).first()["rgb"]
    assert bytes(still) == picture.astype(np.uint8).tobytes()


def test_photometry_bounds(spark):
    picture = np.zeros((2, 2, 3))
    for changed, error in (({"lens_strength": 0.5}, "LENS_SHADING_INVALID"), ({"lens_x": None}, "LENS_SHADING_INVALID"), ({"gamma": None}, "PHOTOMETRY_PARAMETER_MISSING")):
        with pytest.raises(Exception, match=error):
            photometry.photometric(strips(spark, picture, 2, 1, **changed)).collect()


def test_noise_is_standard_normal():
    x = photometry.normal(7, np.arange(200_000))
    assert abs(x.mean()) < 0.01 and abs(x.std() - 1) < 0.01 and abs((x[1:] * x[:-1]).mean()) < 0.01 and abs((np.abs(x) > 1.96).mean() - 0.05) < 0.002


def view(f, ax, ay, n=12, tz=420.0):
    x, y = np.arange(n) % 4 * 30.0, np.arange(n) // 4 * 30.0
    turn = np.array([[1, 0, 0], [0, np.cos(ax), -np.sin(ax)], [0, np.sin(ax), np.cos(ax)]]) @ np.array([[np.cos(ay), 0, np.sin(ay)], [0, 1, 0], [-np.sin(ay), 0, np.cos(ay)]])
    at = turn @ np.array([x, y, 0 * x]) + np.array([[-40.0], [-30.0], [tz]])
    return np.array([x, y, f * at[0] / at[2] + 800, f * at[1] / at[2] + 600]).T


def test_planted_focal_lengths(spark):
    rows, want = [], {}
    for k, (f, ax, ay) in enumerate([(812.5, 0.5, 0.3), (3000.0, 0.3, -0.6), (150.0, -0.4, 0.2)]):
        rows += [(k, *map(float, p), 1600, 1200) for p in view(f, ax, ay)]
        want[k] = f
    rows += [(10, *map(float, p), 1600, 1200) for p in view(900.0, 0.4, 0.3, n=3)] + [(11, *map(float, p), 60, 1200) for p in view(900.0, 0.4, 0.3)] + [(12, 0.0, 0.0, 1.0, None, 1600, 1200)] * 5
    rows += [(13, *map(float, p), 1600, 1200) for p in view(50.0, 0.4, 0.3)]
    noisy = view(1200.0, 0.5, 0.4, n=40)
    noisy[7, 2] += 6.0
    rows += [(14, *map(float, p), 1600, 1200) for p in noisy]
    frame = spark.createDataFrame(rows, "image int, x double, y double, px double, py double, width int, height int").repartition(4)
    got = {r["image"]: r for r in calibration.focal_lengths(frame).collect()}
    for k, f in want.items():
        assert got[k]["state"] == "AVAILABLE" and got[k]["focal"] == pytest.approx(f, rel=1e-6) and got[k]["residual"] < 1e-6
    assert [got[k]["state"] for k in (10, 11, 12, 13)] == ["INPUT_INVALID"] * 3 + ["FOCAL_INVALID"] and got[10]["focal"] is None
    assert got[14]["inliers"] == 39 and got[14]["focal"] == pytest.approx(1200.0, rel=1e-6)


def test_homography_states():
    assert calibration.focal(np.diag([1.0, 1.0, 1.0]))[0] == "FOCAL_UNIDENTIFIABLE"
    assert calibration.focal(np.array([[1.0, 0, 0], [0, 1, 0], [1, 0, 0]]))[0] == "HOMOGRAPHY_INVALID"
    assert calibration.focal(np.array([[900.0, 890, 0], [0, 10, 0], [0.1, 0.5, 1]]))[0] in ("ASSUMPTION_VIOLATED", "FOCAL_INVALID")
