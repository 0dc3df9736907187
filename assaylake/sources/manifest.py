"""Sources: case manifests, partitioned cohorts, pools with digests, ledgers, reports, feature caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import safe_relative_path

CASE = (
    "case_id STRING, category STRING, role STRING, kind STRING, defect STRING, source_sha256 STRING, relative_path STRING, mask_relative_path STRING, mask_sha256 STRING, "
    "is_augmentation BOOLEAN, variant_id INT, parent_case_id STRING, parent_source_sha256 STRING, augmentation_recipe_sha256 STRING"
)
#: Domains of roles and kinds.
ROLES, KINDS = ("FIT", "THRESHOLD_TUNING", "BLIND"), ("NOMINAL", "ANOMALY")


def read_manifest(spark: SparkSession, path: str, normal_only: bool = False) -> DataFrame:
    """The records of JSON manifests {..., "records": [...]}. normal_only drops BLIND records ahead of all else, so their payload isn't looked at."""
    rows = spark.read.schema(f"records ARRAY<STRUCT<{CASE.replace(' STRING', ': STRING').replace(' BOOLEAN', ': BOOLEAN').replace(' INT', ': INT')}>>").json(path, multiLine=True)
    records = rows.select(F.explode("records").alias("r"))
    if normal_only:
        records = records.filter(F.col("r.role") != "BLIND")
    return records.select("r.*")


def manifest_faults(cases: DataFrame) -> DataFrame:
    """(case_id, fault) of records that break the manifest's rules."""
    checks = {
        "CASE_ID_MISSING": F.col("case_id").isNotNull(),
        "ROLE_UNKNOWN": F.col("role").isin(*ROLES),
        "KIND_UNKNOWN": F.col("kind").isin(*KINDS),
        "ANOMALY_OUTSIDE_BLIND": (F.col("kind") == "NOMINAL") | (F.col("role") == "BLIND"),
        "DIGEST_INVALID": F.col("source_sha256").rlike("^sha256:[0-9a-f]{64}$"),
        "PATH_UNSAFE": safe_relative_path(F.col("relative_path")),
        "PARENT_MISSING": ~F.coalesce("is_augmentation", F.lit(False)) | (F.col("parent_case_id").isNotNull() & F.col("variant_id").isNotNull()),
    }
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    single = cases.select("case_id", F.explode(found).alias("fault"))
    twice = cases.groupBy("case_id").agg(F.count("*").alias("n")).filter("n > 1").select("case_id", F.lit("CASE_ID_TWICE").alias("fault"))
    return single.unionByName(twice)


def in_order(cases: DataFrame) -> DataFrame:
    """Parents ahead of their children, by parent, variant and case."""
    return cases.orderBy(F.coalesce("parent_case_id", "case_id"), F.coalesce("variant_id", F.lit(0)), "case_id")


def identities(cases: DataFrame) -> DataFrame:
    """The fields that identify a case."""
    return cases.select("case_id", "category", "role", "kind", "defect", "source_sha256", "is_augmentation", "variant_id", "parent_case_id", "parent_source_sha256")


def read_partitions(spark: SparkSession, path: str, partitions: Sequence[str], column: str = "partition") -> DataFrame:
    """Only the requested partitions of a cohort written with partitionBy(column); the others' files aren't listed as input."""
    return spark.read.option("basePath", path).parquet(*[f"{path}/{column}={p}" for p in partitions])


def read_pool(spark: SparkSession, root: str, metadata: DataFrame, path: str = "source_remote_path", digest: str = "expected_remote_sha256", size: str = "expected_remote_bytes") -> DataFrame:
    """metadata with actual_sha256 and intact, by hashing the files below root; path is relative to root. A missing file isn't intact."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("_path"), F.sha2("content", 256).alias("actual_sha256"), F.col("length").alias("_bytes"))
    below = F.lit(root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/")
    keyed = files.withColumn("_name", F.substring(F.col("_path"), F.position(below, F.col("_path")) + F.length(below), F.length("_path")))
    joined = metadata.join(keyed.drop("_path"), F.col(path) == F.col("_name"), "left")
    intact = (F.concat(F.lit("sha256:"), F.col("actual_sha256")) == F.col(digest)) & (F.col("_bytes") == F.col(size))
    return joined.withColumn("intact", F.coalesce(intact, F.lit(False))).drop("_name", "_bytes")


def read_ledger(spark: SparkSession, path: str, column: str = "normal_source_sha256", lines: bool = False) -> DataFrame:
    """(source_sha256) of a JSON ledger whose list must be sorted and unique; else the query fails. lines: a ledger in each line, else in each file."""
    rows = spark.read.schema(f"{column} ARRAY<STRING>").json(path, multiLine=not lines)
    good = F.array_sort(F.array_distinct(column)) == F.col(column)
    return rows.select(F.explode(F.when(good, F.col(column)).otherwise(F.raise_error(F.lit("LEDGER_NOT_SORTED_UNIQUE")))).alias("source_sha256"))


def read_report(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Scores of JSON reports {..., "scores": [...]}; lines: a report in each line, else in each file."""
    kind = "case_id: STRING, category: STRING, role: STRING, kind: STRING, defect: STRING, source_sha256: STRING, score: DOUBLE"
    return spark.read.schema(f"scores ARRAY<STRUCT<{kind}>>").json(path, multiLine=not lines).select(F.explode("scores").alias("s")).select("s.*")


def cached(cases: DataFrame, cache: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Cases whose features the cache has, with them, and those it lacks."""
    return cases.join(cache, list(keys)), cases.join(cache.select(*keys), list(keys), "left_anti")
