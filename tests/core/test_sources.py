import hashlib
import json

import pytest
from pyspark.sql import functions as F

from assaylake.sources import evidence, manifest
from assaylake.streaming import scores


def case(i, role="FIT", kind="NOMINAL", **more):
    return {"case_id": f"c{i}", "category": "a", "role": role, "kind": kind, "source_sha256": "sha256:" + f"{i:064x}", "relative_path": f"a/{i}.png", "is_augmentation": False} | more


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.json"
    records = [case(1), case(2, "BLIND", "ANOMALY"), case(3, "X"), case(3), case(4, kind="ANOMALY"), case(5, relative_path="../x", source_sha256="no"), case(6, is_augmentation=True)]
    path.write_text(json.dumps({"records": records}))
    rows = manifest.read_manifest(spark, str(path))
    faults = {(r["case_id"], r["fault"]) for r in manifest.manifest_faults(rows).collect()}
    assert faults == {("c3", "ROLE_UNKNOWN"), ("c3", "CASE_ID_TWICE"), ("c4", "ANOMALY_OUTSIDE_BLIND"), ("c5", "PATH_UNSAFE"), ("c5", "DIGEST_INVALID"), ("c6", "PARENT_MISSING")}
    assert manifest.read_manifest(spark, str(path), normal_only=True).filter("role = 'BLIND'").count() == 0 and rows.count() == 7
    assert manifest.identities(rows).columns[0] == "case_id"


def test_order(spark):
    kind = "case_id string, parent_case_id string, variant_id int"
    rows = spark.createDataFrame([("b/01", "b", 1), ("a/02", "a", 2), ("a", None, None), ("a/01", "a", 1)], kind)
    assert [r["case_id"] for r in manifest.in_order(rows).collect()] == ["a", "a/01", "a/02", "b/01"]


def test_partitions_pool_ledger_report_cache(spark, tmp_path):
    cohort = f"{tmp_path}/cohort"
    evidence.write_table(spark.createDataFrame([(1, "FIT"), (2, "RESERVE")], "i int, partition string"), cohort, ("partition",))
    part = manifest.read_partitions(spark, cohort, ["FIT"])
    assert [r["i"] for r in part.collect()] == [1] and all("RESERVE" not in f for f in part.inputFiles())
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        evidence.write_table(part, cohort)
    (tmp_path / "pool" / "r").mkdir(parents=True)
    (tmp_path / "pool" / "r" / "x.bin").write_bytes(b"abc")
    meta = spark.createDataFrame([("r/x.bin", "sha256:" + hashlib.sha256(b"abc").hexdigest(), 3), ("r/y.bin", "sha256:0", 1)], "source_remote_path string, expected_remote_sha256 string, expected_remote_bytes long")
    assert {r["source_remote_path"]: r["intact"] for r in manifest.read_pool(spark, f"{tmp_path}/pool", meta).collect()} == {"r/x.bin": True, "r/y.bin": False}
    (tmp_path / "l.json").write_text(json.dumps({"normal_source_sha256": ["a", "b"]}))
    (tmp_path / "bad.json").write_text(json.dumps({"normal_source_sha256": ["b", "a"]}))
    assert manifest.read_ledger(spark, f"{tmp_path}/l.json").count() == 2
    with pytest.raises(Exception, match="LEDGER_NOT_SORTED_UNIQUE"):
        manifest.read_ledger(spark, f"{tmp_path}/bad.json").collect()
    (tmp_path / "r.json").write_text(json.dumps({"scores": [{"case_id": "a", "score": 0.5}]}))
    assert manifest.read_report(spark, f"{tmp_path}/r.json").first()["score"] == 0.5
    have, lack = manifest.cached(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1)], "k string, f int"), ["k"])
    assert have.first()["f"] == 1 and lack.first()["k"] == "b"


def test_evidence(spark, tmp_path):
    document = evidence.sealed({"b": 1, "a": [0.1]})
    assert evidence.is_sealed(document) and not evidence.is_sealed(document | {"b": 2}) and not evidence.is_sealed({"a": 1})
    evidence.write_document(tmp_path / "d.json", document)
    assert json.loads((tmp_path / "d.json").read_text()) == document
    with pytest.raises(FileExistsError):
        evidence.write_document(tmp_path / "d.json", document)
    ran = []
    assert evidence.consume(tmp_path / "slot", {"id": 1}, lambda: ran.append(1) or 7) == 7
    with pytest.raises(FileExistsError):
        evidence.consume(tmp_path / "slot", {"id": 1}, lambda: ran.append(2))
    assert ran == [1]
    rows = spark.range(3)
    evidence.publish(rows, f"{tmp_path}/cache", f"{tmp_path}/staging", lambda: "same")
    assert spark.read.parquet(f"{tmp_path}/cache").count() == 3
    changing = iter("ab")
    with pytest.raises(RuntimeError):
        evidence.publish(rows, f"{tmp_path}/cache2", f"{tmp_path}/staging2", lambda: next(changing))


def test_stream(spark, tmp_path):
    kind = "case_id string, category string, score double, ts timestamp"
    spark.createDataFrame([("1", "a", 0.6), ("1", "a", 0.6), ("2", "a", 0.5), ("3", "b", 0.9)], "case_id string, category string, score double").withColumn("ts", F.to_timestamp(F.lit("2026-01-01 00:10:00"))).write.parquet(f"{tmp_path}/in")
    limits = spark.createDataFrame([("a", 0.5)], "category string, threshold double")
    stream = scores.above_by_window(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), limits)
    query = stream.writeStream.format("memory").queryName("above").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    spark.createDataFrame([("4", "a", 0.7)], "case_id string, category string, score double").withColumn("ts", F.to_timestamp(F.lit("2026-01-01 05:00:00"))).write.mode("append").parquet(f"{tmp_path}/in")
    query.processAllAvailable()
    query.stop()
    assert [(r["category"], r["cases"], r["above"]) for r in spark.table("above").collect()] == [("a", 2, 1)]


def test_pool_with_equal_names(spark, tmp_path):
    for c, data in (("a", b"one"), ("b", b"two"), ("a/pool", b"three")):
        (tmp_path / "pool" / c).mkdir(parents=True, exist_ok=True)
        (tmp_path / "pool" / c / "000 x.png").write_bytes(data)
    sha = lambda b: "sha256:" + hashlib.sha256(b).hexdigest()
    meta = spark.createDataFrame([("a/000 x.png", sha(b"one"), 3), ("b/000 x.png", sha(b"two"), 3), ("a/pool/000 x.png", sha(b"three"), 5), ("c/000 x.png", sha(b"two"), 3)], "source_remote_path string, expected_remote_sha256 string, expected_remote_bytes long")
    for root in (f"{tmp_path}/pool", f"file://{tmp_path}/pool/"):
        got = [(r["source_remote_path"], r["intact"]) for r in manifest.read_pool(spark, root, meta).collect()]
        assert sorted(got) == [("a/000 x.png", True), ("a/pool/000 x.png", True), ("b/000 x.png", True), ("c/000 x.png", False)]


def test_pool_in_a_folder_with_a_quote(spark, tmp_path):
    (tmp_path / "it's").mkdir()
    (tmp_path / "it's" / "x.bin").write_bytes(b"abc")
    meta = spark.createDataFrame([("x.bin", "sha256:" + hashlib.sha256(b"abc").hexdigest(), 3)], "source_remote_path string, expected_remote_sha256 string, expected_remote_bytes long")
    assert manifest.read_pool(spark, f"{tmp_path}/it's", meta).first()["intact"]
