"""Batch observation: quality gates, pinned bundles, nearest reference and states, as one projection cascade."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import distances_to_references, summarised
from .selection import first_failure, reasons


def still_gate(blur: Column, least_blur: float, overexposed: Column, most_overexposed: float, corners: Column, least_corners: int) -> Column:
    """Every reason to reject a still, in fixed order."""
    return reasons([("BLUR", blur >= least_blur), ("OVEREXPOSED", overexposed <= most_overexposed), ("CORNERS", corners >= least_corners)])


def transform_gate(scale: Column, rotation: Column, shear: Column, shift: Column, limits: dict[str, tuple[float, float]]) -> Column:
    """Whether a fitted transform is within bounds."""
    return scale.between(*limits["scale"]) & rotation.between(*limits["rotation"]) & shear.between(*limits["shear"]) & shift.between(*limits["shift"])


def pins_equal(left: str, right: str, fields: Sequence[str]) -> Column:
    """Null-safe equality of all pinned fields of two structs."""
    out = F.lit(True)
    for f in fields:
        out = out & F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}"))
    return out


def cascade(stages: Sequence[tuple[str, Column]]) -> dict[str, Column]:
    """A state for each stage: PASSED, FAILED, or NOT_RUN behind the first failure; and the whole's state."""
    out, open_ = {}, F.lit(True)
    for name, ok in stages:
        ok = F.coalesce(ok, F.lit(False))
        out[f"{name}_state"] = F.when(~open_, "NOT_RUN").when(ok, "PASSED").otherwise("FAILED")
        open_ = open_ & ok
    return out | {"state": F.when(open_, "AVAILABLE").otherwise("UNAVAILABLE"), "reason": first_failure(stages)}


def observe(requests: DataFrame, references: DataFrame, case: str = "case_id", vector: str = "embedding", reference: str = "reference_id", stages: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """Requests with stage states and, where all stages pass, the summary of distances to the references of one artifact."""
    rows = requests.withColumns(cascade(stages))
    found = distances_to_references(rows.filter("state = 'AVAILABLE'"), references.select(F.col(reference), F.col(vector)), case, vector, reference)
    return rows.join(summarised(found, case), case, "left")


def extracted(rows: DataFrame, extractor: Callable[[], Callable[[list[bytes]], list[list[float]]]], content: str = "content") -> DataFrame:
    """rows with embedding: an injected extractor is made once a task and called on whole batches; content doesn't leave the task."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != content)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = extractor()
        for frame in frames:
            yield frame.drop(columns=[content]).assign(embedding=model(list(frame[content])))

    return rows.mapInPandas(run, f"{kinds}, embedding array<double>")


def fixture_lookup(requests: DataFrame, fixtures: DataFrame, digest: str = "raw_sha256", value: str = "distance", fallback: float = 0.0) -> DataFrame:
    """requests with the recorded value of their image's digest, else the fallback."""
    return requests.join(fixtures.select(digest, F.col(value).alias("_v")), digest, "left").withColumn(value, F.coalesce("_v", F.lit(fallback))).drop("_v")


def replay_states(expected: DataFrame, recorded: DataFrame, recomputed: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, expected, recorded, recomputed, agrees) over all cases of the three tables."""
    named = lambda d, n: d.select(case, F.col("state").alias(n))
    rows = named(expected, "expected").join(named(recorded, "recorded"), case, "full_outer").join(named(recomputed, "recomputed"), case, "full_outer")
    return rows.withColumn("agrees", F.coalesce((F.col("expected") == F.col("recorded")) & (F.col("expected") == F.col("recomputed")), F.lit(False)))
