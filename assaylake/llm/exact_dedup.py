"""Exact dedup by a log-structured merge index, in DataFrame functions alone.

Rows are dealt to memtables, a log of digests on disk. Each memtable is flushed as a run: one row for each of its digests, with the smallest identifier and the number of rows,
sorted by digest across tasks. A new run is probed against the bit filter of the runs before it, so that what they may share is known without a join.
Compaction merges only these digests and takes over all others as they are; it keeps the smallest identifier of each digest. Digests seen twice are hits: a filter
over them lets the texts of the rest go unread by the byte verification, which compares the smallest and the largest text of each digest. Digests
that stand for several texts, if there are any, are split by text.

Filters have KEY_BITS bits for each key and are broadcast; beyond MAX_PIECES there is none, and digests are merged and looked up by joins on them.

Defined results: null text is empty; ids are ordered as numbers, a null id loses to any other; rows that repeat an id are members of their
own and are kept or dropped alike; an empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Memtables that the rows are dealt to.
RUNS = 4
#: Bits of a filter for each key, bits that each key sets, and pieces of PIECE bits of the largest filter that is broadcast, 64 MB.
KEY_BITS, SETS, PIECE, MAX_PIECES = 16, 4, 32768, 16384


def pieces_for(keys: int) -> int | None:
    """Pieces of a filter over so many keys; None if it would be too large to broadcast."""
    pieces = -(-KEY_BITS * max(keys, 1) // PIECE)
    return pieces if pieces <= MAX_PIECES else None


def _spots(col: str, pieces: int) -> tuple[Column, list[Column]]:
    """A key's piece, and its bits there."""
    bits = F.xxhash64(col, F.lit(1))
    return F.pmod(F.xxhash64(col), F.lit(pieces)), [F.pmod(F.shiftrightunsigned(bits, 16 * k), F.lit(PIECE)) for k in range(SETS)]


def bit_filter(keys: DataFrame, col: str, pieces: int) -> DataFrame:
    """(piece, bitmap): at most `pieces` rows of 4096 bytes, whatever the number of keys."""
    piece, spots = _spots(col, pieces)
    return keys.select(piece.alias("piece"), F.explode(F.array(*spots)).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def marked(rows: DataFrame, col: str, filt: DataFrame, pieces: int) -> DataFrame:
    """rows with _maybe: false only if col is none of the filter's keys; true for some 1 in 400 of the others."""
    piece, spots = _spots(col, pieces)
    byte = lambda bit: F.conv(F.hex(F.substring(F.col("bitmap"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.lit(True)
    for bit in spots:
        held = held & (F.getbit(byte(bit), (bit % 8).cast("int")) == 1)
    told = rows.join(F.broadcast(filt), piece == F.col("piece"), "left")
    return told.withColumn("_maybe", F.coalesce(held, F.lit(False))).drop("piece", "bitmap")


def among(rows: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """The rows whose col is among the materialized keys, and perhaps a few more; those of a null col aren't. Rows move only beyond the largest filter."""
    pieces = pieces_for(keys.count())
    if pieces is None:
        return rows.join(keys.select(col).distinct(), col, "left_semi")
    return marked(rows, col, common.materialize(bit_filter(keys, col, pieces), "digest-filter"), pieces).filter("_maybe").drop("_maybe")


def without(rows: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """The rows whose col isn't among the materialized keys, those of a null col too. Only rows that the filter can't tell apart move, up to the largest filter."""
    wanted, pieces = keys.select(col).distinct(), pieces_for(keys.count())
    if pieces is None:
        return rows.join(wanted, col, "left_anti").select(*rows.columns)
    told = marked(rows, col, common.materialize(bit_filter(keys, col, pieces), "digest-filter"), pieces)
    sure, rest = told.filter("not _maybe").drop("_maybe"), told.filter("_maybe").drop("_maybe")
    return sure.unionByName(rest.join(wanted, col, "left_anti").select(*rows.columns))


class DigestIndex:
    """Sorted runs of (digest, ident, n), the filter over them, and the digests that runs may share. rows: how many rows will come, for the filter's size."""

    def __init__(self, rows: int):
        self.runs: list[DataFrame] = []
        self.shared: list[DataFrame] = []
        self.pieces, self.filter = pieces_for(rows), None

    def flush(self, memtable: DataFrame) -> DataFrame:
        """Writes (digest, ident) as a run and probes it against the runs before it. Sums go ahead of the shuffle."""
        run = memtable.groupBy("digest").agg(F.min("ident").alias("ident"), F.count("*").alias("n"))
        run = common.materialize(run.repartitionByRange("digest").sortWithinPartitions("digest"), f"digest-run-{len(self.runs)}")
        if self.pieces is not None:
            own = bit_filter(run, "digest", self.pieces)
            if self.filter is not None:
                self.shared.append(common.materialize(marked(run.select("digest"), "digest", self.filter, self.pieces).filter("_maybe").select("digest"), "digest-shared"))
                own = own.unionByName(self.filter).groupBy("piece").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
            self.filter = common.materialize(own, "digest-filter")
        self.runs.append(run)
        return run

    def compact(self) -> DataFrame:
        """One segment with a row for each digest: ident (smallest), n."""
        every, whole = _union(self.runs), None
        if self.shared:
            shared = _union(self.shared)
            pieces = pieces_for(shared.count())
            if pieces is not None:
                told = marked(every, "digest", common.materialize(bit_filter(shared, "digest", pieces), "digest-filter"), pieces)
                every, whole = told.filter("_maybe").drop("_maybe"), told.filter("not _maybe").drop("_maybe")
        merged = every.groupBy("digest").agg(F.min("ident").alias("ident"), F.sum("n").alias("n")) if len(self.runs) > 1 else every
        return common.materialize(merged if whole is None else whole.unionByName(merged), "digest-segment")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, keep: str = "largest", digest_bytes: int = 16, runs: int = RUNS) -> DataFrame:
    """For each row: id, keep_id, group_size, kept, text_sha256. text: the bytes to compare, as a string; A-Z lower-cased by default.

    digest_bytes: length of the index's digest, a prefix of SHA-256; shorter ones cost more verification and don't change the result.
    """
    norm = common.ascii_lower(F.col("text")) if text is None else text
    ident = F.bitwise_not(F.col(id_col).cast("long")) if keep == "largest" else F.col(id_col).cast("long")
    log = docs.select(ident.alias("ident"), F.unhex(F.sha2(norm, 256)).alias("sha")).withColumns({"digest": F.substring("sha", 1, digest_bytes), "memtable": F.pmod(F.xxhash64("ident", "sha"), F.lit(runs)).cast("int")})
    rows = common.materialize(log, "digest-log", partition_by="memtable")
    total = rows.count()
    index = DigestIndex(total)
    for k in range(runs):
        index.flush(rows.filter(F.col("memtable") == k).select("digest", "ident"))
    segment, rows = index.compact(), rows.drop("memtable")

    # Byte verification of the hits.
    texts = docs.select(ident.alias("ident"), norm.alias("norm")).select("ident", "norm", F.substring(F.unhex(F.sha2("norm", 256)), 1, digest_bytes).alias("digest"))
    suspects = among(texts, common.materialize(segment.filter("n > 1").select("digest"), "digest-hits"), "digest")
    mixed = suspects.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).filter("a <> b").select("digest")
    mixed = common.materialize(mixed, "digest-mixed")

    groups = segment.select("digest", F.col("ident").alias("keep_ident"), F.col("n").alias("group_size"))
    if not mixed.isEmpty():  # one digest, several texts: those are told apart by their bytes
        split = texts.join(mixed, "digest", "left_semi").groupBy("digest", "norm").agg(F.min("ident").alias("keep_ident"), F.count("*").alias("group_size"))
        split = split.select(F.unhex(F.sha2("norm", 256)).alias("key"), "keep_ident", "group_size")
        whole = groups.join(mixed, "digest", "left_anti").select(F.col("digest").alias("key"), "keep_ident", "group_size")
        groups = common.materialize(whole.unionByName(split), "digest-groups")
        rows = rows.join(mixed.withColumn("m", F.lit(True)), "digest", "left").select("ident", "sha", F.when(F.col("m"), F.col("sha")).otherwise(F.col("digest")).alias("key"))
    else:
        groups, rows = groups.withColumnRenamed("digest", "key"), rows.withColumnRenamed("digest", "key")
    out = common.skew_join(rows, groups, ["key"], "group_size", total)
    back = (lambda c: F.bitwise_not(c)) if keep == "largest" else (lambda c: c)
    return out.select(
        back(F.col("ident")).alias("id"), back(F.col("keep_ident")).alias("keep_id"), "group_size",
        F.col("ident").eqNullSafe(F.col("keep_ident")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


OP1_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""
