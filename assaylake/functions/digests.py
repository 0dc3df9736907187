"""Digest, rank and rounding expressions."""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_hex(*parts: Column, separator: str = "\0") -> Column:
    """SHA-256 of the joined parts, the key of every hash order. A null part is an error, as joining would skip it."""
    text = [p.cast("string") for p in parts]
    joined = F.concat_ws(separator, *text)
    any_null = text[0].isNull()
    for p in text[1:]:
        any_null = any_null | p.isNull()
    return F.when(any_null, F.raise_error(F.lit("RANK_MATERIAL_NULL"))).otherwise(F.sha2(joined, 256))


def seed(*parts: Column, separator: str = "\0") -> Column:
    """First 8 bytes of the digest as an unsigned number, in decimal text."""
    return F.conv(F.substring(rank_hex(*parts, separator=separator), 1, 16), 16, 10)


def _strict(pairs):
    keys = [k for k, _ in pairs]
    if len(keys) != len(set(keys)):
        raise ValueError("JSON object has a key twice")
    return dict(pairs)


def parse_strict(text: str):
    """JSON without repeated keys and without NaN or infinities."""

    def constant(name):
        raise ValueError(f"JSON constant {name}")

    def number(text):
        x = float(text)
        if not math.isfinite(x):
            raise ValueError("JSON number out of range")
        return x

    return json.loads(text, object_pairs_hook=_strict, parse_constant=constant, parse_float=number)


def canonical(value, ensure_ascii: bool = True) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ensure_ascii, allow_nan=False)


def canonical_sha256(document: Column, drop: str | None = None, ensure_ascii: bool = True) -> Column:
    """SHA-256 of the canonical form of a JSON text, with the top-level field `drop` taken out; null for null, an error for other than strict JSON.

    Python prints doubles and keys in the canonical form; the JVM's to_json doesn't.
    """

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            value = parse_strict(text)
            if drop is not None:
                value = {k: v for k, v in value.items() if k != drop}
            return hashlib.sha256(canonical(value, ensure_ascii).encode()).hexdigest()

        return texts.map(one)

    return digest(document)


def python_round(v: np.ndarray, digits: int) -> np.ndarray:
    """Python's round of each value."""
    scaled = v * 10.0**digits
    out = np.rint(scaled) / 10.0**digits
    # Near a tie, or where the product isn't exact, the binary value itself decides.
    odd = np.flatnonzero((np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) < 1e-3) | (np.abs(scaled) > 2.0**50))
    out[odd] = [round(float(v[i]), digits) for i in odd]
    return out


def rounded(value: Column, digits: int) -> Column:
    """Python's round: half-even on the binary value. The JVM's bround goes by the decimal text."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        v = x.to_numpy(float)
        return pd.Series(python_round(v, digits)).where(~np.isnan(v), None)

    return run(value)


def general(value: Column, digits: int = 12) -> Column:
    """Python's general format of a double with so many digits, as gates are reported; null for null."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v != v else f"{v:.{digits}g}" for v in x.to_numpy(float).tolist()], dtype=object)

    return run(value)


def map_union(left: Column, right: Column) -> Column:
    """Both maps in one; where both have a key, right's value stays. Null if either is null."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def is_close(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    return F.abs(a - b) <= tolerance


def safe_relative_path(path: Column) -> Column:
    """Neither absolute, nor with a drive or backslash, nor with empty, "." or ".." parts."""
    parts = F.split(path, "/", -1)
    return path.isNotNull() & (F.length(path) > 0) & ~path.rlike(r"^[A-Za-z]:") & ~path.contains("\\") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))
