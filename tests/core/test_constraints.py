import hashlib
import json

import pytest
from pyspark.sql import functions as F

from assaylake.operators import constraints as c


def found(rows):
    return sorted((r["rule"], r["path"], r["problem"], r["n"]) for r in rows.collect())


@pytest.fixture(scope="module")
def docs(spark):
    header = spark.createDataFrame([("a", 3, ["x"]), ("b", 2, ["x", "z"])], "document string, count long, roles array<string>")
    rows = [("a", 1, "k1", "x", None, None, "s1"), ("a", 2, "k2", "x", "k1", "1", "s1"), ("a", 3, "k3", "x", "k1", "2", "s1"), ("b", 1, "k9", "x", None, None, "s9"), ("b", 2, "k5", "y", "k9", "1", "bad"), ("b", 3, "k5", None, "k0", "1", "s0")]
    records = spark.createDataFrame(rows, "document string, position long, key string, role string, parent string, variant string, source string").repartition(3)
    return {"header": header, "records": records}


def test_sound_document_has_no_faults(docs):
    rules = [c.Total("n", ("header", "''", "count"), ("records", "''", "true")), c.Unique("u", "records", "key"), c.Ascending("o", "records", "position", "key"), c.Check("r", "records", "key", "role = 'x'"),
             c.Covers("v", ("records", "key", "parent IS NULL"), ("records", "parent", "parent IS NOT NULL"), "variant", ("1", "2"))]
    assert [r["rule"] for r in c.violations({n: d.filter("document = 'a'") for n, d in docs.items()}, rules).collect()] == []


def test_every_kind_of_fault(docs):
    child, parent = ("records", "parent", "parent IS NOT NULL"), ("records", "key", "parent IS NULL")
    rules = [
        c.Check("role", "records", "key", "role = 'x'"), c.Unique("once", "records", "key"), c.Ascending("order", "records", "position", "key"), c.Total("count", ("header", "''", "count"), ("records", "''", "true")),
        c.SameSet("roles", ("header", "roles", "true"), ("records", "role", "role IS NOT NULL"), arrays=(True, False)), c.Belongs("parent", child, parent, (("source", "source"),)), c.Covers("variants", parent, child, "variant", ("1", "2")),
        c.Disjoint("apart", ("records", "key", "role = 'y'"), ("records", "key", "role IS NULL")), c.Constant("constant", "records", "key", ("role",)),
    ]
    got = found(c.violations({n: d.filter("document = 'b'") for n, d in docs.items()}, rules))
    assert got == sorted([
        ("role", "records[k5]", "BROKEN", 2), ("once", "records[k5]", "REPEATED", 2), ("order", "records[2]", "UNORDERED", 2), ("order", "records[3]", "UNORDERED", 2), ("count", "header[]", "COUNT", 4),
        ("roles", "header[y]", "MISSING", 1), ("roles", "header[z]", "UNKNOWN", 1), ("parent", "records[k0]", "UNKNOWN", 1), ("parent", "records[k9]", "DIFFERS", 2),
        ("variants", "records[k9#2]", "MISSING", 1), ("variants", "records[k0#1]", "UNKNOWN", 1), ("apart", "records[k5]", "REPEATED", 2), ("constant", "records[k5]", "DIFFERS", 2),
    ])


def test_one_scan_of_each_table_and_one_shuffle(docs):
    rules = [c.Check(f"r{i}", "records", "key", f"position < {i}") for i in range(6)] + [c.Unique("u", "records", "key")]
    plan = c.violations(docs, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("Join") == 0 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_wrong_rule_tables(docs):
    with pytest.raises(ValueError):
        c.violations(docs, [c.Unique("u", "records", "key"), c.Unique("u", "records", "role")])
    with pytest.raises(KeyError):
        c.violations(docs, [c.Unique("u", "nowhere", "key")])
    with pytest.raises(ValueError):
        c.violations(docs, [])


def test_digests_of_lists_are_pythons(spark):
    rows = [(d, i, f"é{i}", None if i % 3 else 1.5, i % 2 == 0) for d in ("a", "b") for i in range(500)]
    frame = spark.createDataFrame(rows, "document string, i long, name string, x double, even boolean").repartition(5)
    got = {(r["document"], r["name"]): r["digest"] for r in c.listed_digests(frame, "i", {"n": "name", "x": "x"}, {"all": "true", "even": "even", "none": "x > 9"}).collect()}
    want = {}
    for d in ("a", "b"):
        for name, keep in (("all", lambda i: True), ("even", lambda i: i % 2 == 0)):
            records = [{"n": n, "x": x} for doc, i, n, x, _ in rows if doc == d and keep(i)]
            want[d, name] = hashlib.sha256(json.dumps(records, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert got == want
    heads = spark.createDataFrame([("a", got["a", "even"]), ("b", "0" * 64), ("c", hashlib.sha256(b"[]").hexdigest())], "document string, stated string")
    digests = c.listed_digests(frame, "i", {"n": "name", "x": "x"}, {"even": "even"})
    assert [r["document"] for r in c.violations({"h": heads, "d": digests}, [c.Digest("identity", ("h", "stated"), "d", "even")]).collect()] == ["b"]


def test_empty_documents(docs):
    none = {n: d.filter(F.lit(False)) for n, d in docs.items()}
    assert c.violations(none, [c.Unique("u", "records", "key"), c.Total("n", ("header", "''", "count"), ("records", "''", "true"))]).count() == 0
