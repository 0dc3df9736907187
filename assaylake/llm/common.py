"""Shared helpers of the training-data operators: scratch tables, bounded broadcasts, Arrow kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from assaylake.sources.scratch import materialize, scratch_path

__all__ = ["ascii_lower", "lookup", "map_batches", "materialize", "numbered", "packed", "range_sorted", "scratch_path", "skew_join", "slices", "spread_lookup", "unpacked", "words_count"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of a lookup table that may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
#: A key with at least 1/HOT_SHARE of all rows is hot. At most HOT_SHARE keys can be, so these fit a broadcast.
HOT_SHARE = 8192

def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """left joined with a materialized table of unique keys: broadcast while its counted rows are within limit, else a shuffled join."""
    small = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if small else right, list(on), how)


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which is materialized and unique by non-null keys; weight is the number of left rows of a key, total of all. how: inner or left.

    Keys with at least total / HOT_SHARE rows are at most HOT_SHARE many: they are broadcast, so that their rows aren't shuffled at all.
    The rest is joined by shuffle, where no key has more than that share of the rows.
    """
    bar = max(2, -(-total // HOT_SHARE))
    hot, cold = right.filter(F.col(weight) >= bar), right.filter(F.col(weight) < bar)
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), list(on), "left")
    added = [c for c in right.columns if c not in on]
    rest = marked.filter("_hot is null").drop("_hot", *added).join(cold, list(on), how)
    return marked.filter("_hot").drop("_hot").unionByName(rest)


def spread_lookup(left: DataFrame, right: DataFrame, on: str, weight: str, total: int | None = None, how: str = "inner", limit: int | None = None) -> DataFrame:
    """left joined with a materialized table: broadcast while its counted rows are within limit (BROADCAST_ROWS), else in two parts as skew_join does. total: rows of left, by default those that
    the table counts; how: left if the table may lack a key of left."""
    if right.limit((most := BROADCAST_ROWS if limit is None else limit) + 1).count() <= most:
        return left.join(F.broadcast(right), on, "left")
    return skew_join(left, right, [on], weight, right.agg(F.sum(weight)).first()[0] if total is None else total, how)


def range_sorted(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """rows as a table sorted by order across tasks, however often a value of the first columns occurs, with _at, which grows along the order, and _task (its upper bits)."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return materialize(placed.withColumn("_task", F.shiftright("_at", 33).cast("int")), name)


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """rows as a table with _rank, 0 for the first by order, whose columns must tell rows apart; the sums that this needs have one row for each task."""
    placed = range_sorted(rows, order, name)
    tasks = placed.groupBy("_task").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(tasks.select("_task", (F.col("first") - before).alias("_base"))), "_task").withColumn("_rank", F.col("_at") - F.col("_base")).drop("_task", "_at", "_base")


def words_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z only; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


#: Texts are handed to a kernel in slices of so many bytes, so that a batch of very long ones needs no more memory. The batches themselves are bounded by Spark (maxBytesPerBatch).
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    step = max(1, min(batch.num_rows, most * batch.num_rows // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_batches(df: DataFrame, kernel: Callable[[], Callable[..., dict[str, list]]], uses: Sequence[str], adds: str | StructType, keep: bool = True, most: int = SLICE_BYTES) -> DataFrame:
    """Runs kernel() once in each task, then what it returns on the columns `uses`, as lists, slice by slice; it returns the columns `adds`.

    keep: the columns of df stay beside the new ones, without passing through Python objects; those named like a new one are replaced.
    Without keep a slice may give any number of rows. most: bytes of a slice.
    """
    new = _parse_datatype_string(adds) if isinstance(adds, str) else adds
    fresh = {f.name for f in new}
    held = StructType([f for f in df.schema if f.name not in fresh]) if keep else StructType([])
    order = [i for i, f in enumerate(df.schema) if f.name not in fresh] if keep else []
    at = [df.columns.index(c) for c in uses]
    out = StructType(held.fields + new.fields)
    arrow, tail = to_arrow_schema(out), to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        step = kernel()
        for batch in batches:
            for part in slices(batch, most):
                made = step(*(part.column(i).to_pylist() for i in at))
                yield pa.RecordBatch.from_arrays([part.column(i).cast(f.type) for i, f in zip(order, arrow)] + [pa.array(made[f.name], type=f.type) for f in tail], schema=arrow)

    return df.mapInArrow(run, out)


def packed(docs: DataFrame, *apart: str) -> DataFrame:
    """(row, apart...): all other columns in one struct, whose names can't clash with what an operator adds."""
    return docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in apart]).alias("row"), *apart)


def unpacked(rows: DataFrame, columns: Sequence[str], **values: str) -> list[Column]:
    """The columns of what was packed, in their order; those named in values come from a column of rows."""
    return [F.col(values[c]).alias(c) if c in values else F.col(f"row.`{c}`") for c in columns]
