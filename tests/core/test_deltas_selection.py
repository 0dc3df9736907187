import pytest
from pyspark.sql import functions as F

from assaylake.operators import deltas, observe, selection

REPORT = "case_id string, category string, role string, kind string, defect string, source_sha256 string, score double"


def test_paired(spark):
    parents = spark.createDataFrame([("p", 0.2), ("q", 0.5)], "case_id string, score double")
    children = spark.createDataFrame([("p", 1, 0.6), ("p", 2, 0.1), ("q", 1, 0.5)], "parent string, variant int, score double")
    rows = deltas.paired(children, parents, "parent", "case_id").withColumn("category", F.lit("c"))
    s = deltas.delta_summary(rows, ["category"]).first()
    assert (s["pairs"], s["positive"], s["zero"], s["negative"]) == (3, 1, 1, 1) and s["median"] == 0.0 and s["maximum"] == pytest.approx(0.4)
    g = {(r["category"], r["variant"]): (r["n"], round(r["p95"], 6)) for r in deltas.delta_quantiles(rows, [["category"], ["category", "variant"]], ["category", "variant"]).collect()}
    assert g == {("c", None): (3, 0.4), ("c", 1): (2, 0.4), ("c", 2): (1, -0.1)}
    with pytest.raises(Exception, match="PARENT_MISSING"):
        deltas.paired(spark.createDataFrame([("zz", 1.0)], "parent string, score double"), parents, "parent", "case_id").collect()


def test_contrasts_dont_multiply(spark):
    score = lambda rows: spark.createDataFrame(rows, "p string, score double")
    r = deltas.contrasts(score([("a", 1.0)]), score([("a", 1.5)] * 3), score([("a", 2.0)] * 8 + [("a", 3.0)]), "p").first()
    assert (r["control_count"], r["stimulus_count"], r["control_delta"]) == (3, 9, 0.5) and r["contrast"] == pytest.approx(10 / 9 - 0.5)


def test_multi_grain_repeats_raw(spark):
    stimuli = spark.createDataFrame([("c", f, v, f == "x", 0.1) for f in "xy" for v in "12"], "c string, f string, l string, above boolean, delta double")
    raw = spark.createDataFrame([("c", True), ("c", False)], "c string, above boolean")
    got = {(r["f"], r["l"]): (r["stimuli"], r["stimuli_rate"], r["raw"], r["raw_above"]) for r in deltas.multi_grain(stimuli, raw, "c", "f", "l").collect()}
    assert got[None, None] == (4, 0.5, 2, 1) and got["x", None] == (2, 1.0, 2, 1) and got["y", "1"] == (1, 0.0, 2, 1) and len(got) == 9


def test_report_comparison(spark):
    a = spark.createDataFrame([("1", "capsule", "BLIND", "ANOMALY", "crack", "s1", 0.2), ("2", "capsule", "BLIND", "NOMINAL", "good", "s2", 0.1), ("3", "capsule", "THRESHOLD_TUNING", "NOMINAL", "good", "s3", 0.1)], REPORT)
    b = a.withColumn("score", F.when(F.col("case_id") == "1", 0.6).otherwise(F.col("score")))
    cases, categories, defects = deltas.compare_reports(a, b)
    d = defects.first()
    assert (d["category"], d["defect"], d["cases"]) == ("capsule", "crack", 1) and d["mean"] == pytest.approx(0.4)
    c = categories.first()
    assert c["cases"] == 3 and c["threshold_delta"] == 0.0 and c["auroc_delta"] == 0.0 and cases.count() == 3
    with pytest.raises(Exception, match="DIFFERS"):
        deltas.compare_reports(a, b.withColumn("source_sha256", F.lit("other")))[0].collect()


def test_gates_and_choice(spark):
    kind = "candidate_id string, category string, above_rate double, p95_minus_threshold double, maximum_minus_threshold double"
    rows = [("a", "x", 0.1, 0.01, 0.0), ("a", "y", 0.1, 0.01, 0.0), ("b", "x", 0.1, 0.005, 0.0), ("b", "y", 0.1, 0.01, 0.0), ("c", "x", 0.0, 0.0, 0.9), ("c", "y", None, 0.0, 0.0)]
    limits = {"above_rate": 0.1, "maximum_minus_threshold": 0.05}
    judged = selection.evaluate(spark.createDataFrame(rows, kind), limits, selection.FRESH)
    got = {r["candidate_id"]: (r["passed"], list(r["reasons"])) for r in judged.collect()}
    assert got == {"a": (True, []), "b": (True, []), "c": (False, ["x.maximum_minus_threshold", "y.above_rate"])}
    assert tuple(selection.choose(judged, selection.FRESH).first()) == (selection.LOCKED, "b")
    assert tuple(selection.choose(judged.filter("not passed"), selection.FRESH).first()) == (selection.NO_CHOICE, None)
    stated = judged.select("candidate_id", "mean_above_rate")
    assert selection.summaries_differ(stated, stated, ["candidate_id"], ["mean_above_rate"]).collect() == []
    assert selection.summaries_differ(stated, stated.filter("candidate_id <> 'a'"), ["candidate_id"], ["mean_above_rate"]).count() == 1


def test_cascade_and_reasons(spark):
    rows = spark.createDataFrame([(1, True, True), (2, False, True), (3, True, None)], "i int, a boolean, b boolean")
    got = [tuple(r) for r in rows.select("i", *[c.alias(n) for n, c in observe.cascade([("A", F.col("a")), ("B", F.col("b"))]).items()]).orderBy("i").collect()]
    assert got == [(1, "PASSED", "PASSED", "AVAILABLE", None), (2, "FAILED", "NOT_RUN", "UNAVAILABLE", "A"), (3, "PASSED", "FAILED", "UNAVAILABLE", "B")]
    gate = spark.range(1).select(observe.still_gate(F.lit(1.0), 2.0, F.lit(0.9), 0.5, F.lit(8), 8)).first()[0]
    assert gate == ["BLUR", "OVEREXPOSED"]
    pins = spark.createDataFrame([((1, None), (1, None)), ((1, "x"), (1, None))], "l struct<a:int,b:string>, r struct<a:int,b:string>")
    assert [r[0] for r in pins.select(observe.pins_equal("l", "r", ["a", "b"])).collect()] == [True, False]


def test_observation_and_extractor(spark):
    requests = spark.createDataFrame([(1, bytearray(b"\1\2"), True), (2, bytearray(b"\2\1"), False)], "case_id int, content binary, ok boolean")
    rows = observe.extracted(requests, lambda: lambda images: [[float(b) for b in x] for x in images])
    golden = spark.createDataFrame([("g", [1.0, 2.0]), ("h", [2.0, 1.0])], "reference_id string, embedding array<double>")
    got = {r["case_id"]: r for r in observe.observe(rows, golden, stages=[("OK", F.col("ok"))]).collect()}
    assert got[1]["nearest_id"] == "g" and got[1]["nearest_distance"] == pytest.approx(0.0) and got[2]["state"] == "UNAVAILABLE" and got[2]["nearest_id"] is None
    known = observe.fixture_lookup(spark.createDataFrame([("a",), ("b",)], "raw_sha256 string"), spark.createDataFrame([("a", 0.7)], "raw_sha256 string, distance double"), fallback=-1.0)
    assert {r["raw_sha256"]: r["distance"] for r in known.collect()} == {"a": 0.7, "b": -1.0}
    state = lambda rows: spark.createDataFrame(rows, "case_id int, state string")
    replay = {r["case_id"]: r["agrees"] for r in observe.replay_states(state([(1, "A"), (2, "A")]), state([(1, "A")]), state([(1, "A"), (2, "A")])).collect()}
    assert replay == {1: True, 2: False}


def test_rounding_of_ties_as_sql(spark):
    """0.0638695 times a million is below its tie as a double: SQL's round gives 0.063869, that of the decimal text 0.06387."""
    import duckdb

    from assaylake.plans.runs import rounded

    values = [0.0638695, -0.0638695, 0.0000005, 0.1234565, 2.5, -1e-9, 123456.0000015]
    have = [r["x"] for r in rounded(spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(99, None)], "i int, x double"), "x").orderBy("i").collect()]
    want = [duckdb.sql(f"SELECT round({v!r}::DOUBLE, 6)").fetchall()[0][0] for v in values] + [None]
    assert have == want and have[0] == 0.063869


def test_delta_quantiles_rank_few_rows(spark, monkeypatch):
    """As sorted lists have it, with ties, nulls and infinite values; of what is ranked there is one bucket a group."""
    import math
    import random

    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(2), round(rnd.gauss(0, 50), 3)) for _ in range(3000)] + [("c", 1, 2.0)] * 30 + [("d", 0, None), ("d", 0, -1.0), ("e", 0, float("inf")), ("e", 0, float("-inf"))]
    counted, running_totals = [], deltas.running_totals
    monkeypatch.setattr(deltas, "running_totals", lambda d, *rest: counted.append(d.count()) or running_totals(d, *rest))
    out = deltas.delta_quantiles(spark.createDataFrame(rows, "category string, variant int, delta double"), [["category"], ["category", "variant"], []], ["category", "variant"])
    have = {(r["grain"], r["category"], r["variant"]): (r["n"], r["p95"], r["max"]) for r in out.collect()}
    groups: dict = {}
    for c, v, x in rows:
        if x is not None:
            for k in (("category", c, None), ("category,variant", c, v), ("all", None, None)):
                groups.setdefault(k, []).append(x)
    assert have == {k: (len(x), sorted(x)[math.ceil(len(x) * 0.95) - 1], max(x)) for k, x in groups.items()} and counted[0] < 150
