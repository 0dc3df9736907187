"""Whitening of embeddings by polarised covariance.

Entries are whole numbers, x = floor(SCALE * c) + SHIFT, so sums are exact. The variance of every dimension and of the sum of every two dimensions is aggregated from squared centred
values; half of what the variance of a sum exceeds those of its two dimensions is their covariance. So all cross-covariances come from sums of squares alone. They are
assembled at the driver, a table of the dimension squared, whatever the number of rows, for the eigenvectors.

Centring: a task subtracts the whole number m next to the mean and squares y = x - m. With r = S - n m, the sum of (n x - S)^2 is n^2 times that of y^2 less n r^2, in whole numbers of any length,
so nothing is rounded before the division by n^3. Partial sums are of each task, as decimals.

Defined results: rows whose vector is null, empty or holds null, NaN or infinite entries are dropped, and so are those that have another dimension than most (the largest of equally frequent ones);
entries beyond LARGEST in magnitude count as that; repeated rows count as often as they occur; a component whose eigenvalue isn't above rounding has a null whitened value, and explained is null if nothing varies;
a deviation of more than 38 digits is null; no rows give none. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Largest magnitude of an entry.
LARGEST = float(1 << 36)
#: Magnitudes of y whose sums of squares a batch can hold in 64 bits.
SMALL = 1 << 22


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False)))


def whole(column: pa.Array, dim: int) -> np.ndarray:
    """A row of whole numbers for each vector."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.floor(SCALE * np.clip(c, -LARGEST, LARGEST)).astype(np.int64) + SHIFT


def _big(x: np.ndarray) -> np.ndarray:
    """Whole numbers of any length, if squares of these don't fit."""
    return x.astype(object) if len(x) and max(-int(x.min()), int(x.max())) > SMALL else x


def _rows(sums: dict[tuple[int, int], int]) -> pa.RecordBatch:
    i, j = zip(*sums) if sums else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(s)) for s in sums.values()], pa.decimal128(38, 0))], names=["i", "j", "s"])


def _summed(rows: DataFrame, vector: str, dim: int, partial) -> dict[tuple[int, int], int]:
    """Sums over all rows of what partial gives for a batch of whole numbers: an array of sums for each i, of j from i on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        for batch in batches:
            if batch.num_rows:
                for i, part in partial(whole(batch.column(0), dim)):
                    for j, s in enumerate(part.tolist(), i):
                        sums[i, j] = sums.get((i, j), 0) + s
        yield _rows(sums)

    made = rows.select(vector).mapInArrow(run, "i int, j int, s decimal(38,0)")
    return {(r["i"], r["j"]): int(r["s"]) for r in made.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}


def totals(rows: DataFrame, vector: str, dim: int) -> list[int]:
    """Sum of each dimension."""
    found = _summed(rows, vector, dim, lambda x: [(0, x.sum(axis=0))])
    return [found[0, d] for d in range(dim)]


def polarised(rows: DataFrame, vector: str, n: int, sums: list[int]) -> list[list[int]]:
    """n^2 times the sum over all rows of the product of two dimensions' deviations, for every two dimensions, exact."""
    dim = len(sums)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, centre)]
    shift = np.array(centre, np.int64)

    def partial(x: np.ndarray):
        y = _big(x - shift)
        for i in range(dim):
            other = np.concatenate([np.zeros((len(y), 1), y.dtype), y[:, i + 1 :]], axis=1)
            yield i, ((y[:, i : i + 1] + other) ** 2).sum(axis=0)

    squares = _summed(rows, vector, dim, partial)
    # (i, i) is the dimension itself, (i, j) the sum of two.
    spread = {(i, j): n * n * s - n * (rest[i] + (rest[j] if i != j else 0)) ** 2 for (i, j), s in squares.items()}
    return [[spread[i, i] if i == j else (spread[min(i, j), max(i, j)] - spread[i, i] - spread[j, j]) // 2 for j in range(dim)] for i in range(dim)]


def components(products: list[list[int]], n: int, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Largest eigenvalues of the covariance of whole numbers, unit eigenvectors as columns (the largest entry positive), and the trace."""
    v = np.array([[p / n**3 for p in row] for row in products])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    return e, u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0), sum(products[d][d] for d in range(len(v))) / n**3


def _white(x: np.ndarray, centre: np.ndarray, off: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return ((x - centre).astype(np.float64) - off) @ turn


def identity_error(rows: DataFrame, vector: str, n: int, white, dim: int, count: int) -> float:
    """Largest entry of the whitened values' covariance less the identity: a second pass over all rows, summed by task and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((count, count)), np.zeros(count)
        for batch in batches:
            if batch.num_rows:
                w = white(whole(batch.column(0), dim))
                products += w.T @ w
                sums += w.sum(axis=0)
        flat = np.r_[products.ravel(), sums]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "s"])

    added = rows.select(vector).mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    flat = np.zeros(count * count + count)
    for r in added:
        flat[r["at"]] = r["s"] / n
    mean = flat[count * count :]
    return float(np.abs(flat[: count * count].reshape(count, count) - np.outer(mean, mean) - np.eye(count)).max(initial=0.0))


def whitened(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation decimal(38,0), whitened, explained, identity_error): a row for each usable vector and component."""
    kind = rows.schema[id_col].dataType
    out = f"`{id_col}` {kind.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = usable(rows.select(id_col, vector), vector)
    most = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return rows.sparkSession.createDataFrame([], out)
    dim, n = most["d"], most["n"]
    rows = rows.filter(F.size(vector) == dim)
    sums = totals(rows, vector, dim)
    e, u, trace = components(polarised(rows, vector, n, sums), n, min(count, dim))
    count, live = len(e), e > 1e-13 * max(trace, 0.0) if trace > 0 else np.zeros(len(e), bool)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, centre)]
    turn = np.where(live, u / np.sqrt(np.where(live, e, 1.0)), 0.0)
    shift, off = np.array(centre, np.int64), np.array([r / n for r in rest])
    error = identity_error(rows, vector, n, lambda x: _white(x, shift, off, turn[:, live]), dim, int(live.sum()))
    explained = [float(x / trace) if trace > 0 else None for x in e]
    dead, arrow = ~live, to_arrow_type(kind)

    def deviations(x: np.ndarray) -> list[Decimal | None]:
        y = x - shift
        far = n * max(-int(y.min()), int(y.max())) + max(map(abs, rest))
        if far * far * dim >= 1 << 63:
            y = y.astype(object)
        total = ((n * y - np.array(rest, y.dtype)) ** 2).sum(axis=1).tolist()
        return [Decimal(d) if d < 10**38 else None for d in total]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(batch.column(1), dim)
            w, times = _white(x, shift, off, turn), np.repeat(np.arange(len(x)), count)
            columns = [
                batch.column(0).take(pa.array(times)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(times), n)),
                pa.array(deviations(x), pa.decimal128(38, 0)).take(pa.array(times)), pa.array(w.ravel(), mask=np.tile(dead, len(x))), pa.array(explained * len(x), pa.float64()), pa.array(np.full(len(times), error)),
            ]
            yield pa.RecordBatch.from_arrays([columns[0].cast(arrow), *columns[1:]], names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, out)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").try_cast("long"))
