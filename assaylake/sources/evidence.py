"""Sinks: write-once documents and tables, one-time slots.

A slot is taken at the driver before a Spark action starts, as tasks may run twice and plans may be built without being run.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame

from ..functions.digests import canonical

T = TypeVar("T")


def sealed(document: dict, field: str = "document_sha256") -> dict:
    """document with the digest of its canonical form without that field."""
    body = {k: v for k, v in document.items() if k != field}
    return body | {field: hashlib.sha256(canonical(body).encode()).hexdigest()}


def is_sealed(document: dict, field: str = "document_sha256") -> bool:
    return field in document and sealed(document, field)[field] == document[field]


def write_document(path: str | Path, document: dict) -> None:
    """A JSON file with sorted keys that must not exist yet, on disk when this returns."""
    data = (json.dumps(document, sort_keys=True, indent=2, allow_nan=False) + "\n").encode()
    handle = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o644)
    with os.fdopen(handle, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())


def write_table(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """A Parquet table that must not exist yet."""
    rows.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def consume(slot: str | Path, receipt: dict, action: Callable[[], T]) -> T:
    """Takes a one-time slot, then runs the action: a second call fails before it does anything, also if the action failed."""
    write_document(slot, sealed(receipt))
    return action()


def publish(rows: DataFrame, path: str, staging: str, identity: Callable[[], str]) -> None:
    """Writes to staging and renames to path if identity() is the same before and after."""
    before = identity()
    rows.write.mode("errorifexists").parquet(staging)
    if identity() != before:
        raise RuntimeError("the extractor changed while its features were written")
    spark = rows.sparkSession
    source, target = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (staging, path))
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target) or not files.rename(source, target):
        raise FileExistsError(path)
