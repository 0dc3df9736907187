"""Queries over grids larger than a row, made of the vectors of each label one below the other, and over views of planar boards; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration, grids, photometry
from ..operators.running import running_totals
from ..sources.scratch import materialize
from .adapters import table

#: Rows of a strip, threshold of a component, cells of a resized grid's side, side and stride of tiles.
HEIGHT, ABOVE, SIDE, TILE, STRIDE = 7, 0.16, 14, 16, 11


def _rows(s: SparkSession, d: str) -> DataFrame:
    """(image, y, values): a label's vectors in order of their id."""
    rows = table(s, d, "embeddings").select(F.col("label").cast("long").alias("image"), "vec_id", "embedding", F.lit(1).cast("long").alias("one"))
    return running_totals(rows, ["image"], "vec_id", ["one"]).select("image", F.col("one_before").alias("y"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))


def grid_components(s: SparkSession, d: str) -> DataFrame:
    rows = _rows(s, d).withColumn("values", F.transform("values", F.abs))
    out = grids.components(grids.strips(rows, "image", "y", "values", HEIGHT), ABOVE)
    return out.withColumns({c: F.round(c, 6) for c in ("peak", "mean")})


def resized_grids(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("grid"))
    cells = grids.resized(rows, "grid", 8, 8, SIDE, SIDE).select("vec_id", F.posexplode("grid").alias("at", "value"))
    return cells.select("vec_id", F.floor(F.col("at") / SIDE).alias("y"), (F.col("at") % SIDE).cast("long").alias("x"), F.round("value", 6).alias("value"))


def tile_digests(s: SparkSession, d: str) -> DataFrame:
    rows = materialize(_rows(s, d), "grid-rows")
    packed = grids.strips(rows, "image", "y", "values", HEIGHT)
    raster = packed.select("image", "y", "width", grids.mask_bytes(F.transform("values", lambda v: F.floor(F.abs(v) * 64) % 256)).alias("bytes"), grids.mask_bytes(F.transform("values", lambda v: F.when(v > 0, 1).otherwise(0))).alias("scope"))
    high = rows.groupBy("image").agg(F.max("y").alias("last"))
    tiles = high.select("image", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(STRIDE).cast("long"))).alias("y"))
    tiles = tiles.select("image", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"), F.lit(STRIDE).cast("long"))).alias("x"), "y", F.lit(TILE).cast("long").alias("side"))
    return grids.tile_digests(raster, tiles, HEIGHT)


def photometric_strips(s: SparkSession, d: str) -> DataFrame:
    """Each label's vectors as an image 21 cells wide, adjusted; all cells."""
    rows = materialize(_rows(s, d), "grid-rows").select("image", "y", F.slice("values", 1, 63).alias("values"))
    high = rows.groupBy("image").agg((F.max("y") + 1).alias("height"))
    packed = grids.strips(rows, "image", "y", "values", HEIGHT).join(high, "image")
    k = F.col("image")
    given = {
        "exposure_ev": (k % 5 - 2) / 10.0, "red_gain": 1.0 + (k % 3) / 50.0, "blue_gain": 1.0 - (k % 4) / 50.0, "gamma": 1.0 + (k % 7 - 3) / 40.0, "shading_strength": (k % 6) / 60.0, "shading_angle_degrees": (k * 37 % 360).cast("double"),
        "vignette_strength": (k % 8) / 80.0, "noise_std": (k % 9) / 3.0, "noise_seed": (k * 1_000_003 + 17).cast("long"), "lens_strength": F.when(k % 2 == 0, F.lit(0.03)), "lens_x": F.when(k % 2 == 0, F.lit(0.1)), "lens_y": F.when(k % 2 == 0, F.lit(-0.2)),
    }
    strips = packed.select("image", "y", F.lit(21).alias("width"), "height", grids.mask_bytes(F.transform("values", lambda v: F.floor(F.abs(v) * 800) % 256)).alias("rgb"), *[c.alias(n) for n, c in given.items()])
    out = photometry.photometric(strips)
    hexed = out.select("image", "y", F.hex("rgb").alias("h"))
    cells = hexed.select("image", "y", F.explode(F.sequence(F.lit(0), (F.length("h") / 2).cast("int") - 1)).alias("at"), "h")
    return cells.select("image", (F.col("y") + F.floor(F.col("at") / 63)).alias("y"), (F.col("at") % 63).cast("long").alias("at"), F.conv(F.substring(F.col("h"), 2 * F.col("at") + 1, F.lit(2)), 16, 10).cast("long").alias("value"))


#: Views of a board of 4 x 3 points: a part's focal length, tilts and distance; some have too few points.
_VIEW = {"f": "500.0 + p_partkey % 1500", "ax": "0.35 + p_partkey % 7 / 20.0", "ay": "0.2 + p_partkey % 5 / 15.0", "tz": "400.0 + p_partkey % 50"}


def board_focal_lengths(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "part").select("p_partkey", *[F.expr(e).cast("double").alias(n) for n, e in _VIEW.items()])
    points = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.when(F.col("p_partkey") % 13 == 0, 2).otherwise(11))))
    x, y = (F.col("i") % 4 * 30.0), (F.floor(F.col("i") / 4) * 30.0)
    # Turned about the vertical axis, then about the horizontal one.
    cx, sx, cy, sy = F.cos("ax"), F.sin("ax"), F.cos("ay"), F.sin("ay")
    at = cy * x - 40.0, sx * sy * x + cx * y - 30.0, -cx * sy * x + sx * y + F.col("tz")
    seen = points.select(F.col("p_partkey").alias("image"), x.alias("x"), y.alias("y"), (F.col("f") * at[0] / at[2] + 960.0).alias("px"), (F.col("f") * at[1] / at[2] + 540.0).alias("py"), F.lit(1920).alias("width"), F.lit(1080).alias("height"))
    return calibration.focal_lengths(seen).select("image", "points", "inliers", "state", F.round("focal", 3).alias("focal"), (F.col("residual") < 1e-6).alias("square"))


QUERIES = {f.__name__: f for f in (grid_components, resized_grids, tile_digests, photometric_strips, board_focal_lengths)}
_CELLS = "rows AS (SELECT label AS image, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, embedding::DOUBLE[] AS v FROM embeddings), cells AS (SELECT image, y, x, v[x + 1] AS v FROM rows, range(64) t(x))"
_PLACE = lambda n: f"greatest(0.0, least(7.0, ({n} + 0.5) * 8.0 / {SIDE} - 0.5))"


def _hashed(k: str) -> str:
    """The counter-based generator in whole numbers modulo 2 ** 64."""
    wrap = 1 << 64
    z = f"((seed + (2 * cell + {k} + 1) * {photometry.GOLDEN}::UHUGEINT) % {wrap}::UHUGEINT)"
    for shift, by in zip((30, 27), photometry.MIX):
        z = f"((xor({z}::UBIGINT, ({z} // {1 << shift})::UBIGINT)::UHUGEINT * {by}::UHUGEINT) % {wrap}::UHUGEINT)"
    return f"xor({z}::UBIGINT, ({z} // {1 << 31})::UBIGINT)"


ORACLES = {
    "grid_components": f"""
WITH RECURSIVE {_CELLS}, on_ AS (SELECT image, y, x, y * 64 + x AS c, abs(v) AS v FROM cells WHERE abs(v) >= {ABOVE}),
links AS (SELECT a.image, a.c AS a, b.c AS b FROM on_ a JOIN on_ b ON a.image = b.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
reach AS (SELECT image, c AS a, c AS b FROM on_ UNION SELECT r.image, r.a, l.b FROM reach r JOIN links l ON r.image = l.image AND r.b = l.a),
least_ AS (SELECT image, a AS c, min(b) AS label FROM reach GROUP BY 1, 2)
SELECT CAST(image AS BIGINT) AS image, label, count(*) AS area, round(max(v), 6) AS peak, round(avg(v), 6) AS mean, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM on_ JOIN least_ USING (image, c) GROUP BY 1, 2""",
    "resized_grids": f"""
WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS v, y, x, {_PLACE('y')} AS py, {_PLACE('x')} AS px FROM embeddings, range({SIDE}) a(y), range({SIDE}) b(x)),
q AS (SELECT *, CAST(floor(least(py, 6)) AS BIGINT) AS y0, CAST(floor(least(px, 6)) AS BIGINT) AS x0 FROM p)
SELECT vec_id, y, x, round((v[y0 * 8 + x0 + 1] * (1 - (px - x0)) + v[y0 * 8 + x0 + 2] * (px - x0)) * (1 - (py - y0)) + (v[y0 * 8 + x0 + 9] * (1 - (px - x0)) + v[y0 * 8 + x0 + 10] * (px - x0)) * (py - y0), 6) AS value FROM q""",
    "tile_digests": f"""
WITH {_CELLS}, h AS (SELECT image, max(y) AS last FROM rows GROUP BY 1), t AS (SELECT image, x, y FROM h, range(0, 64, {STRIDE}) a(x), (SELECT unnest(range(0, 100000, {STRIDE})) AS y) WHERE y <= last),
k AS (SELECT t.image, t.x, t.y, i, j, coalesce(CASE WHEN c.v > 0 THEN CAST(floor(abs(c.v) * 64) AS BIGINT) % 256 END, 127) AS b FROM t, range({TILE}) p(i), range({TILE}) q(j), LATERAL (SELECT 1) LEFT JOIN cells c ON c.image = t.image AND c.y = t.y + i AND c.x = t.x + j)
SELECT CAST(image AS BIGINT) AS image, x, y, CAST({TILE} AS BIGINT) AS side, sha256(encode(x || ':' || y || ':{TILE}:GRAY8:') || unhex(string_agg(printf('%02x', b), '' ORDER BY i, j))) AS sha256 FROM k GROUP BY image, x, y""",
    "photometric_strips": f"""
WITH {_CELLS}, h AS (SELECT image, max(y) + 1 AS height FROM rows GROUP BY 1),
k AS (SELECT CAST(c.image AS BIGINT) AS image, c.y, c.x AS c_, c.x // 3 AS px, CAST(floor(abs(v) * 800) AS BIGINT) % 256 / 255.0::DOUBLE AS v, height, CAST(c.image * 1000003 + 17 AS UHUGEINT) AS seed, CAST(c.y * 63 + c.x AS UHUGEINT) AS cell FROM cells c JOIN h ON h.image = c.image WHERE c.x < 63),
z AS (SELECT *, {_hashed('0')} AS a, {_hashed('1')} AS b FROM k),
n AS (SELECT *, sqrt(-2 * ln((a // 2048 + 0.5::DOUBLE) * pow(2.0, -53))) * cos(2 * pi() * (b // 2048 + 0.5::DOUBLE) * pow(2.0, -53)) AS noise, px / 20.0::DOUBLE * 2 - 1 AS u, y / greatest(height - 1, 1)::DOUBLE * 2 - 1 AS w, radians(image * 37 % 360) AS g FROM z),
l AS (SELECT *, pow(greatest(0.0, least(1.0, v * pow(2.0, (image % 5 - 2) / 10.0) * CASE c_ % 3 WHEN 0 THEN 1.0 + image % 3 / 50.0 WHEN 2 THEN 1.0 - image % 4 / 50.0 ELSE 1.0 END)), 1.0 + (image % 7 - 3) / 40.0)
  * (1 - image % 6 / 60.0 * (u * cos(g) + w * sin(g) + 1) / 2) * (1 - image % 8 / 80.0 * least(1.0, u * u + w * w)) * CASE WHEN image % 2 = 0 THEN 1 - 0.03 * least(1.0, pow(u - 0.2, 2) + pow(w + 0.4, 2)) ELSE 1.0 END + noise * (image % 9 / 3.0 / 255.0) AS light FROM n)
SELECT image, y, c_ AS "at", CAST(round_even(greatest(0.0, least(1.0, light)) * 255, 0) AS BIGINT) AS value FROM l""",
    "board_focal_lengths": f"""
SELECT p_partkey AS image, CASE WHEN p_partkey % 13 = 0 THEN 3 ELSE 12 END AS points, CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE 12 END AS inliers, CASE WHEN p_partkey % 13 = 0 THEN 'INPUT_INVALID' ELSE 'AVAILABLE' END AS state,
  CASE WHEN p_partkey % 13 <> 0 THEN CAST({_VIEW['f']} AS DOUBLE) END AS focal, CASE WHEN p_partkey % 13 <> 0 THEN true END AS square FROM part""",
}
