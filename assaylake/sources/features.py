"""A store of features that verifies what it reads and publishes in two phases.

A fragment is a folder of Parquet named by the digest of its rows; it holds (source_sha256, identity, vector, vector_sha256) of what one run extracted. Reading works every vector's digest out again and fails at
the first that differs, and at two fragments that disagree. Only cases that the store lacks are extracted. The extractor tells its identity in each task before it is loaded, after that and after its last batch; all three
must be the one asked for. Rows go to a staging folder first, are read back and checked as a whole, and only then get their fragment's name, by one rename.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An extractor: identity() tells what it is, load() gives a function from contents to vectors.
Identity = Callable[[], str]
Loader = Callable[[], Callable[[list], list]]
SCHEMA = "source_sha256 string, identity string, vector array<double>, vector_sha256 string"


def vector_digest(vector: Column) -> Column:
    """SHA-256 of the vector's numbers as the JVM prints them; null for a null vector."""
    return F.when(vector.isNotNull(), F.sha2(F.concat_ws(",", F.transform(vector, lambda x: F.coalesce(x.cast("string"), F.lit("null")))), 256))


class FeatureStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = lambda p: path(p)
        self._files = path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def fragments(self) -> list[str]:
        at = self._path(f"{self.root}/fragments")
        return sorted(str(f.getPath()) for f in self._files.listStatus(at)) if self._files.exists(at) else []

    def read(self, identity: str) -> DataFrame:
        """(source_sha256, vector) of this identity, once each; damaged rows and fragments that disagree fail the query."""
        found = self.fragments()
        rows = self.spark.read.schema(SCHEMA).parquet(*found) if found else self.spark.createDataFrame([], SCHEMA)
        broken = F.coalesce(vector_digest(F.col("vector")) != F.col("vector_sha256"), F.lit(True))
        checked = F.when(broken, F.raise_error(F.concat(F.lit("FEATURE_DAMAGED "), F.coalesce("source_sha256", F.lit("null"))))).otherwise(F.col("vector"))
        rows = rows.filter(F.col("identity") == identity).select("source_sha256", checked.alias("vector"), "vector_sha256")
        once = rows.groupBy("source_sha256").agg(F.min("vector_sha256").alias("_a"), F.max("vector_sha256").alias("_b"), F.any_value("vector").alias("vector"))
        agreed = F.when(F.col("_a") != F.col("_b"), F.raise_error(F.concat(F.lit("FEATURE_CONFLICT "), F.col("source_sha256")))).otherwise(F.col("vector"))
        return once.select("source_sha256", agreed.alias("vector"))

    def features(self, cases: DataFrame, identity: str, observed: Identity, load: Loader, content: str = "content") -> DataFrame:
        """cases (source_sha256, content, ...) with vector in place of content; what the store lacks is extracted and published first, each source once."""
        known = self.read(identity)
        lacking = cases.select("source_sha256", content).join(known.select("source_sha256"), "source_sha256", "left_anti").groupBy("source_sha256").agg(F.any_value(content).alias("content"))
        self.publish(_extracted(lacking, identity, observed, load), identity)
        return cases.drop(content).join(self.read(identity), "source_sha256", "left")

    def publish(self, rows: DataFrame, identity: str) -> str | None:
        """Writes rows (source_sha256, identity, vector) to staging, checks them as they are read back and renames them to their fragment; none for no rows."""
        staging = f"{self.root}/staging/{uuid.uuid4().hex}"
        rows.withColumn("vector_sha256", vector_digest(F.col("vector"))).select("source_sha256", "identity", "vector", "vector_sha256").write.mode("errorifexists").parquet(staging)
        staged = self.spark.read.schema(SCHEMA).parquet(staging)
        sound = (F.col("identity") == identity) & (vector_digest(F.col("vector")) == F.col("vector_sha256")) & F.col("source_sha256").isNotNull()
        row = F.xxhash64("source_sha256", "vector_sha256").cast("decimal(38,0)")
        told = staged.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(sound, F.lit(False))).alias("bad"), F.sum(row).alias("a"), F.sum(row * row % 1_000_000_007).alias("b"), F.count_distinct("source_sha256").alias("once")).first()
        if told["bad"] or told["once"] != told["n"]:
            self._files.delete(self._path(staging), True)
            raise ValueError(f"FEATURES_NOT_PUBLISHED {told['bad']} faulty of {told['n']}")
        if not told["n"]:
            self._files.delete(self._path(staging), True)
            return None
        name = self.spark.range(1).select(F.sha2(F.concat_ws("|", F.lit(identity), F.lit(str(told["n"])), F.lit(str(told["a"])), F.lit(str(told["b"]))), 256)).first()[0]
        target = self._path(f"{self.root}/fragments/{name}")
        self._files.mkdirs(target.getParent())
        if self._files.exists(target):  # the same rows, published by another run
            self._files.delete(self._path(staging), True)
        elif not self._files.rename(self._path(staging), target):
            raise FileExistsError(str(target))
        return str(target)


def _extracted(rows: DataFrame, identity: str, observed: Identity, load: Loader) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None

        def same(when: str) -> None:
            if (now := observed()) != identity:
                raise RuntimeError(f"EXTRACTOR_CHANGED {when}: {now}")

        for batch in batches:
            if not batch.num_rows:
                continue
            if model is None:
                same("before loading")
                model = load()
                same("after loading")
            vectors = model(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([identity] * batch.num_rows), pa.array(vectors, pa.list_(pa.float64()))], names=["source_sha256", "identity", "vector"])
        if model is not None:
            same("after the last batch")

    return rows.select("source_sha256", "content").mapInArrow(run, "source_sha256 string, identity string, vector array<double>")
