"""Augmentation plans: parents by variants, with seeds and sampled parameters. Pixels are rendered elsewhere."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import twister
from ..functions.digests import seed


def plan(parents: DataFrame, variants: int, anchor: str, case: str = "case_id", digest: str = "source_sha256") -> DataFrame:
    """parents once for each variant 1..variants, with variant_id, child_case_id and seed (unsigned 64 bits in decimal text)."""
    rows = parents.withColumn("variant_id", F.explode(F.sequence(F.lit(1), F.lit(variants))))
    child = F.format_string("%s/augmented/%02d", F.col(case).cast("string"), "variant_id")
    return rows.withColumns({"child_case_id": child, "seed": seed(F.lit(anchor), F.col(case), F.col(digest), F.col("variant_id"))})


def sampled(seeds: Column, ranges: Sequence[tuple[str, float, float]]) -> Column:
    """A map of uniform samples within ranges, drawn in their order by CPython's generator from each seed, rounded to 8 digits; null for a null seed."""
    draws = [("uniform", name, low, high, 0.0) for name, low, high in ranges]

    @F.pandas_udf("map<string,double>")
    def draw(values: pd.Series) -> pd.Series:
        kept = values.notna().to_numpy()
        drawn = zip(*(column.tolist() for column in twister.sample(values[kept].tolist(), draws)))
        out = np.full(len(values), None, object)
        out[kept] = [dict(zip([d[1] for d in draws], row)) for row in drawn]
        return pd.Series(out)

    return draw(seeds)


def camera_parameters(seeds: Column, limits: Mapping[str, float]) -> Column:
    """A struct of all that a camera recipe draws from each seed (twister.camera_draws); noise_seed is in decimal text."""
    draws = twister.camera_draws(dict(limits))
    kinds = {"uniform": "double", "integer": "bigint", "bits": "string"}

    @F.pandas_udf(", ".join(f"{d[1]} {kinds[d[0]]}" for d in draws))
    def draw(values: pd.Series) -> pd.DataFrame:
        kept = values.notna().to_numpy()
        made = pd.DataFrame({d[1]: [str(x) for x in v] if d[0] == "bits" else v for d, v in zip(draws, twister.sample(values[kept].tolist(), draws))}, index=values.index[kept])
        return made.reindex(values.index)

    return draw(seeds)


def out_of_bounds(rows: DataFrame, parameters: str, ranges: Sequence[tuple[str, float, float]], key: str) -> DataFrame:
    """(key, parameter, value) of parameters that are missing or out of range, and of those that no range names."""
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("low"), F.lit(b).alias("high")) for n, a, b in ranges])
    value = F.get(F.map_values(F.map_filter(parameters, lambda k, _: k == F.col("r.name"))), F.lit(0))
    named = rows.select(key, parameters, F.explode(known).alias("r")).select(key, F.col("r.name").alias("parameter"), value.alias("value"), "r.low", "r.high")
    bad = named.filter(F.col("value").isNull() | ~F.col("value").between(F.col("low"), F.col("high"))).select(key, "parameter", "value")
    names = F.array(*[F.lit(n) for n, _, _ in ranges])
    extra = rows.select(key, F.explode(F.map_filter(parameters, lambda k, _: ~F.array_contains(names, k))).alias("parameter", "value"))
    return bad.unionByName(extra)


def package_faults(children: DataFrame, parents: DataFrame, variants: int, anchor: str, case: str = "case_id", digest: str = "source_sha256") -> DataFrame:
    """(child_case_id, fault) of a package of derived cases (child_case_id, parent_case_id, parent_source_sha256, variant_id, seed) that isn't what plan() gives for these parents:
    MISSING, UNEXPECTED, TWICE, PARENT_DIFFERS, SOURCE_DIFFERS, VARIANT_DIFFERS, SEED_DIFFERS. A null differs from any value."""
    wanted = plan(parents, variants, anchor, case, digest).select("child_case_id", F.struct(F.col(case).cast("string").alias("parent"), F.col(digest).alias("source"), "variant_id", "seed").alias("w"))
    have = children.groupBy("child_case_id").agg(F.count("*").alias("n"), F.min(F.struct(F.col("parent_case_id").cast("string").alias("parent"), F.col("parent_source_sha256").alias("source"), "variant_id", "seed")).alias("h"))
    both = wanted.join(have, "child_case_id", "full_outer")
    differs = [F.when(F.col("w").isNotNull() & F.col("h").isNotNull() & ~F.col(f"w.{c}").eqNullSafe(F.col(f"h.{c}")), name) for c, name in (("parent", "PARENT_DIFFERS"), ("source", "SOURCE_DIFFERS"), ("variant_id", "VARIANT_DIFFERS"), ("seed", "SEED_DIFFERS"))]
    found = F.array_compact(F.array(F.when(F.col("h").isNull(), "MISSING"), F.when(F.col("w").isNull(), "UNEXPECTED"), F.when(F.col("n") > 1, "TWICE"), *differs))
    return both.select("child_case_id", F.explode(found).alias("fault"))
