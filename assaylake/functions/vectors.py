"""Vector expressions over ARRAY<DOUBLE> columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms up to this count as zero.
ZERO_NORM = 1e-12


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def _clamped(similarity: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1.0 - similarity))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in [0, 2]; unequal dimensions and zero norms are errors; null if either is null."""
    return (
        F.when(F.size(a) != F.size(b), F.raise_error(F.lit("EMBEDDING_DIMENSION_MISMATCH")))
        .when((norm(a) <= ZERO_NORM) | (norm(b) <= ZERO_NORM), F.raise_error(F.lit("EMBEDDING_NORM_INVALID")))
        .when(a.isNotNull() & b.isNotNull(), _clamped(dot(a, b) / (norm(a) * norm(b))))
    )


def patch_cosine_distance(a: Column, b: Column) -> Column:
    """As cosine_distance, but a patch of zero norm is at distance 0."""
    return F.when((norm(a) <= ZERO_NORM) | (norm(b) <= ZERO_NORM), 0.0).otherwise(_clamped(dot(a, b) / (norm(a) * norm(b))))


def normalised(v: Column) -> Column:
    """v at unit length; zero norm and non-finite values are errors."""
    bad = (norm(v) <= ZERO_NORM) | F.exists(v, lambda x: F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(bad, F.raise_error(F.lit("FEATURE_VECTOR_INVALID"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm(v)))


def patches(v: Column, size: int) -> Column:
    """A flat vector as an array of vectors of the given size; a remainder is an error."""
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / size).cast("int") - 1), lambda i: F.slice(v, i * size + 1, size))
    return F.when(F.size(v) % size != 0, F.raise_error(F.lit("PATCH_GRID_INVALID"))).otherwise(cut)


def top_k_mean(values: Column, k: int) -> Column:
    """Mean of the k largest; k out of 1..size is an error."""
    largest = F.slice(F.sort_array(values, asc=False), 1, k)
    return F.when((F.size(values) < k) | F.lit(k < 1), F.raise_error(F.lit("TOP_K_INVALID"))).otherwise(F.aggregate(largest, F.lit(0.0), lambda s, x: s + x) / k)
