"""Scans, pins, canonical forms and formats as queries over the given tables; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests
from ..operators import observe, regions
from ..sources import evidence, manifest
from ..sources.scratch import scratch_path
from .adapters import table

SEGMENTS = ("AUTOMOBILE", "MACHINERY")
#: Cells of a mask's side, and radii of the grown mask and of the band around its edge.
SIDE, PADDING, BAND = 8, 2, 1


def partition_scan(s: SparkSession, d: str) -> DataFrame:
    """Customers written by segment, of which two are opened; what is opened is told by the files."""
    path = scratch_path(s, "cohort")
    evidence.write_table(table(s, d, "customer").select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("partition")), path, ("partition",))
    rows = manifest.read_partitions(s, path, SEGMENTS).withColumn("file", F.input_file_name())
    return rows.groupBy("partition").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"), F.count_if(~F.col("file").contains(F.concat(F.lit("partition="), "partition"))).alias("others"))


def ledger_scan(s: SparkSession, d: str) -> DataFrame:
    """Sorted digests of a hundred documents to a ledger."""
    rows = table(s, d, "documents").select(F.floor(F.col("doc_id") / 100).alias("k"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    ledgers = rows.groupBy("k").agg(F.array_sort(F.collect_set("h")).alias("normal_source_sha256"))
    path = scratch_path(s, "ledgers")
    ledgers.drop("k").write.json(path)
    return manifest.read_ledger(s, path, lines=True).groupBy("source_sha256").agg(F.count("*").alias("ledgers"))


def report_scan(s: SparkSession, d: str) -> DataFrame:
    """Scores of reports, fifty customers each."""
    rows = table(s, d, "customer").select(F.floor(F.col("c_custkey") / 50).alias("k"), F.struct(F.concat(F.lit("c"), "c_custkey").alias("case_id"), F.col("c_mktsegment").alias("category"), F.lit("BLIND").alias("role"), (F.col("c_acctbal") / 7).alias("score")).alias("x"))
    path = scratch_path(s, "reports")
    rows.groupBy("k").agg(F.collect_list("x").alias("scores")).write.json(path)
    return manifest.read_report(s, path, lines=True).select("case_id", "category", "role", "defect", F.round("score", 6).alias("score"))


def canonical_digests(s: SparkSession, d: str) -> DataFrame:
    """Of orders as JSON with keys out of order and blanks, with and without a field; equal whatever the order."""
    text = F.concat(F.lit('{"z": [1, 2.50], "key": '), F.col("o_orderkey").cast("string"), F.lit(', "status":"'), F.col("o_orderstatus"), F.lit('" , "digest": "x", "a": {"c": null, "b": "\u00e9"}}'))
    return table(s, d, "orders").select("o_orderkey", digests.canonical_sha256(text).alias("whole"), digests.canonical_sha256(text, drop="digest").alias("unsigned"))


def formats(s: SparkSession, d: str) -> DataFrame:
    """Rounding as Python has it, gate messages with 12 digits, and unions of maps in which the right side wins."""
    rows = table(s, d, "part")
    left, right = F.create_map(F.lit("a"), F.col("p_size"), F.lit("b"), F.lit(1)), F.create_map(F.lit("b"), F.col("p_size") + 1, F.lit("c"), F.lit(2))
    both = F.when(F.col("p_partkey") % 5 > 0, digests.map_union(left, right)).otherwise(digests.map_union(right, left))
    third = F.col("p_retailprice").cast("double") / 3
    return rows.select("p_partkey", digests.rounded(F.col("p_size") / 2.0, 0).alias("half_even"), digests.rounded(third, 4).alias("third"), digests.general(third * F.pow(F.lit(10.0), F.col("p_partkey") % 30 - 12)).alias("message"), *[both[k].alias(k) for k in "abc"])


def pinned_bundles(s: SparkSession, d: str) -> DataFrame:
    """Orders' customers against the pins that the order's request names, as a cascade."""
    customer = table(s, d, "customer").select("c_custkey", F.struct("c_nationkey", F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).alias("segment")).alias("have"))
    asked = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice").join(customer, "c_custkey")
    asked = asked.withColumn("want", F.struct(F.when(F.col("o_orderkey") % 11 > 0, F.col("have.c_nationkey")).alias("c_nationkey"), F.when(F.col("o_orderkey") % 13 > 0, F.col("have.segment")).otherwise("OTHER").alias("segment")))
    states = observe.cascade([("pins", observe.pins_equal("have", "want", ["c_nationkey", "segment"])), ("price", F.col("o_totalprice") > 100_000)])
    return asked.select("o_orderkey", *[c.alias(n) for n, c in states.items()])


def subject_scopes(s: SparkSession, d: str) -> DataFrame:
    """Cells above 0.15 as the subject. Entries have single precision, and so has the limit: what is stored as 0.15 isn't above it."""
    rows = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x > F.lit(0.15).cast("float")).alias("mask"))
    told = regions.scopes(rows, "vec_id", "mask", SIDE, PADDING, BAND)
    place = lambda c: F.aggregate(F.transform(c, lambda x, i: F.when(x, i + 1).otherwise(0)), F.lit(0), lambda a, b: a + b)
    return told.select("vec_id", F.size(F.filter("support", lambda x: x)).alias("support"), place("support").alias("support_places"), F.size(F.filter("boundary", lambda x: x)).alias("boundary"), place("boundary").alias("boundary_places"))


QUERIES = {f.__name__: f for f in (partition_scan, ledger_scan, report_scan, canonical_digests, formats, pinned_bundles, subject_scopes)}
_JSON = """'{"a":{"b":"\\u00e9","c":null},' || x || '"key":' || o_orderkey || ',"status":"' || o_orderstatus || '","z":[1,2.5]}'"""
ORACLES = {
    "partition_scan": f"SELECT c_mktsegment AS partition, count(*) AS n, sum(c_custkey) AS keys, CAST(0 AS BIGINT) AS others FROM customer WHERE c_mktsegment IN {SEGMENTS} GROUP BY 1",
    "ledger_scan": "SELECT h AS source_sha256, count(*) AS ledgers FROM (SELECT DISTINCT doc_id // 100 AS k, sha256(coalesce(text, '')) AS h FROM documents) GROUP BY 1",
    "report_scan": "SELECT 'c' || c_custkey AS case_id, c_mktsegment AS category, 'BLIND' AS role, CAST(NULL AS VARCHAR) AS defect, round(c_acctbal / 7, 6) AS score FROM customer",
    "canonical_digests": f"WITH w AS (SELECT *, '\"digest\":\"x\",' AS x FROM orders), u AS (SELECT *, '' AS x FROM orders) SELECT o_orderkey, whole, unsigned FROM (SELECT o_orderkey, sha256({_JSON}) AS whole FROM w) JOIN (SELECT o_orderkey, sha256({_JSON}) AS unsigned FROM u) USING (o_orderkey)",
    "formats": """WITH p AS (SELECT *, p_partkey % 5 > 0 AS r, p_retailprice::DOUBLE / 3 AS third FROM part)
SELECT p_partkey, round_even(p_size / 2.0, 0)::DOUBLE AS half_even, round(third, 4) AS third, printf('%.12g', third * pow(10.0::DOUBLE, p_partkey % 30 - 12)) AS message, p_size AS a, CASE WHEN r THEN p_size + 1 ELSE 1 END AS b, 2 AS c FROM p""",
    "pinned_bundles": """WITH r AS (SELECT o_orderkey, o_totalprice > 100000 AS dear, o_orderkey % 11 > 0 AND (o_orderkey % 13 > 0) AS pinned FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, CASE WHEN pinned THEN 'PASSED' ELSE 'FAILED' END AS pins_state, CASE WHEN NOT pinned THEN 'NOT_RUN' WHEN dear THEN 'PASSED' ELSE 'FAILED' END AS price_state, CASE WHEN pinned AND dear THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS state,
  CASE WHEN NOT pinned THEN 'pins' WHEN NOT dear THEN 'price' END AS reason FROM r""",
    "subject_scopes": f"""WITH c AS (SELECT vec_id, i, i // {SIDE} AS y, i % {SIDE} AS x, embedding[i + 1] > 0.15::FLOAT AS m FROM embeddings, range({SIDE * SIDE}) t(i)),
g AS (SELECT a.vec_id, a.i, bool_or(b.m) AS grown, bool_or(b.m AND pow(a.y - b.y, 2) + pow(a.x - b.x, 2) <= {BAND * BAND}) AND NOT bool_and(b.m OR pow(a.y - b.y, 2) + pow(a.x - b.x, 2) > {BAND * BAND}) AS edge
  FROM c a JOIN c b ON a.vec_id = b.vec_id AND pow(a.y - b.y, 2) + pow(a.x - b.x, 2) <= {PADDING * PADDING} GROUP BY 1, 2)
SELECT vec_id, count(*) FILTER (grown) AS support, coalesce(sum(i + 1) FILTER (grown), 0) AS support_places, count(*) FILTER (edge) AS boundary, coalesce(sum(i + 1) FILTER (edge), 0) AS boundary_places FROM g GROUP BY 1""",
}
