"""Queries over documents that are first written as JSON from the given tables, with faults in their text; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.features import FeatureStore
from ..sources.scratch import scratch_path
from ..sources.strict import strict_documents
from .adapters import table

#: Customers of a document.
SIZE = 20
FIELDS = {"": {"id": True, "records": True}, "records[]": {"case_id": True, "role": True, "payload": True}}
#: The text of a record's payload and of the whole record, in SQL that Spark and DuckDB both read; faults by remainders of the customer's number.
_PAYLOAD = """'{"x":' || CASE WHEN c_custkey % 17 = 0 THEN 'NaN' WHEN c_custkey % 19 = 0 THEN '-1e999' ELSE cast(c_custkey % 7 AS string) || '.25' END || ', "y": [1,2], "role":"]}"}'"""
_RECORD = f"""'{{"case_id":"c' || cast(c_custkey AS string) || '","role":"' || CASE WHEN c_custkey % 3 = 0 THEN 'BLIND' ELSE 'FIT' END || '"' || CASE WHEN c_custkey % 11 = 0 THEN ',"role":"FIT"' ELSE '' END
  || CASE WHEN c_custkey % 13 = 0 THEN ', "note":null' ELSE '' END || CASE WHEN c_custkey % 23 = 0 THEN '' ELSE ', "payload" : ' || {_PAYLOAD} END || '}}'"""


def write_customers(s: SparkSession, d: str) -> str:
    """Documents of SIZE customers each, one a line; some end too soon."""
    rows = table(s, d, "customer").select(F.floor(F.col("c_custkey") / SIZE).alias("doc"), "c_custkey", F.expr(_RECORD).alias("text"))
    whole = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "text"))).alias("r"))
    text = F.concat(F.lit('{"id":"d'), F.col("doc").cast("string"), F.lit('","records":['), F.array_join(F.transform("r", lambda x: x["text"]), ","), F.when(F.col("doc") % 9 == 4, F.lit("]")).otherwise(F.lit("]}")))
    path = scratch_path(s, "customer-documents")
    whole.select(text).write.text(path)
    return path


def strict_scan(s: SparkSession, d: str) -> DataFrame:
    """Every fault and record of the documents; payloads of BLIND records stay undecoded."""
    rows = strict_documents(s, write_customers(s, d), FIELDS, lines=True)
    return rows.groupBy("kind", "fault", F.regexp_extract("path", r"\.(.*)", 1).alias("field"), F.coalesce("identity", F.lit("")).alias("identity"), "decoded", "skipped", F.col("record").isNotNull().alias("given"), "sound").agg(F.count("*").alias("n"))


def _letters():
    """Stands in for a model: shares of the letters a, e, i, o and u, and the length."""
    return lambda texts: [[*((t or "").count(c) / (len(t or "") + 1.0) for c in "aeiou"), float(len(t or ""))] for t in texts]


def stored_features(s: SparkSession, d: str) -> DataFrame:
    """Features of all documents, half of them from a first run's fragment."""
    rows = table(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_sha256"), F.coalesce("text", F.lit("")).alias("content"))
    store = FeatureStore(s, scratch_path(s, "features"))
    store.features(rows.filter(F.substring("source_sha256", 1, 1) < "8"), "letters/1", lambda: "letters/1", _letters)
    out = store.features(rows, "letters/1", lambda: "letters/1", _letters)
    return out.select("doc_id", "source_sha256", *[F.round(F.get("vector", F.lit(i)) * (F.get("vector", F.lit(5)) + 1)).cast("long").alias(c) for i, c in enumerate("aeiou")], F.get("vector", F.lit(5)).cast("long").alias("length"))


QUERIES = {"strict_scan": strict_scan, "stored_features": stored_features}
ORACLES = {
    "strict_scan": f"""
WITH r AS (SELECT c_custkey AS k, c_custkey // {SIZE} AS doc, c_custkey % 3 = 0 AS blind, c_custkey % 11 = 0 AS twice, c_custkey % 13 = 0 AS note, c_custkey % 23 = 0 AS bare, c_custkey % 17 = 0 OR c_custkey % 19 = 0 AS odd, {_PAYLOAD} AS payload FROM customer),
w AS (SELECT * FROM r WHERE doc % 9 <> 4),
f AS (SELECT doc, 'REPEATED_KEY' AS fault, 'role' AS field FROM w WHERE twice UNION ALL SELECT doc, 'UNKNOWN_FIELD', 'note' FROM w WHERE note AND NOT blind
  UNION ALL SELECT doc, 'MISSING_FIELD', 'payload' FROM w WHERE bare AND NOT blind UNION ALL SELECT doc, 'NON_FINITE', 'payload.x' FROM w WHERE odd AND NOT bare AND NOT blind
  UNION ALL SELECT DISTINCT doc, 'MALFORMED', '' FROM r WHERE doc % 9 = 4),
g AS (SELECT 'FAULT' AS kind, fault, field, '' AS identity, NULL AS decoded, NULL AS skipped, false AS given, false AS sound FROM f
  UNION ALL SELECT 'RECORD', NULL, '', 'c' || k, CASE WHEN blind THEN 2 + CAST(twice AS INTEGER) ELSE 2 + CAST(note AS INTEGER) + CASE WHEN bare THEN 0 ELSE 4 END END,
    CASE WHEN blind THEN CASE WHEN note THEN 4 ELSE 0 END + CASE WHEN bare THEN 0 ELSE length(payload) END ELSE 0 END, NOT (blind OR twice OR note OR bare OR odd), doc NOT IN (SELECT doc FROM f) FROM w)
SELECT kind, fault, field, identity, CAST(decoded AS BIGINT) AS decoded, CAST(skipped AS BIGINT) AS skipped, given, sound, count(*) AS n FROM g GROUP BY ALL""",
    "stored_features": "WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, sha256(t) AS source_sha256, "
    + ", ".join(f"length(t) - length(replace(t, '{c}', '')) AS {c}" for c in "aeiou")
    + ", length(t) AS length FROM t",
}
