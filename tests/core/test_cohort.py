import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assaylake.functions.digests import canonical, canonical_sha256, parse_strict, rank_hex, rounded, safe_relative_path, seed
from assaylake.operators import banks, cohort


def sha(*parts):
    return hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()


def test_roles_by_share_and_rank(spark):
    rows = spark.createDataFrame([(c, i) for c in "ab" for i in range(137)], "c string, i long").withColumn("h", rank_hex(F.col("c"), F.col("i")))
    want = {}
    for c in "ab":
        order = sorted(range(137), key=lambda i: (sha(c, i), i))
        for r, i in enumerate(order):
            want[c, i] = (r, "FIT" if 10 * r < 137 * 6 else "TUNE", "X" if r < 6 else "Y" if r < 8 else None)
    for parts in (1, 5):
        a = cohort.roles_by_share(rows.repartition(parts), ["c"], "h", ["i"], {"FIT": 6, "TUNE": 4}).collect()
        b = {(r["c"], r["i"]): r["role"] for r in cohort.roles_by_rank(rows, ["c"], "h", ["i"], {"X": 6, "Y": 2}).collect()}
        assert {(r["c"], r["i"]): (r["rank"], r["role"], b[r["c"], r["i"]]) for r in a} == want


def test_quotas(spark):
    groups = spark.createDataFrame([(c, i) for c, n in (("a", 10), ("b", 4)) for i in range(n)], "c string, g long").withColumn("h", rank_hex(F.col("c"), F.col("g")))
    quotas = spark.createDataFrame([("a", "FIT", 0, 6), ("a", "REST", 1, 4), ("b", "FIT", 0, 3)], "c string, partition string, position int, quota long")
    got = cohort.allocate_by_quota(groups, quotas, "c", "h", "g").collect()
    assert Counter((r["c"], r["partition"]) for r in got) == {("a", "FIT"): 6, ("a", "REST"): 4, ("b", "FIT"): 3, ("b", None): 1}
    assert [tuple(r) for r in cohort.unmet_quotas(cohort.allocate_by_quota(groups, quotas, "c", "h", "g"), quotas, "c").collect()] == [("b", 4, 3)]


def test_history_drops_whole_groups(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (3, "w"), (3, None)], "g int, digest string")
    ledger = spark.createDataFrame([("y",), ("q",), (None,)], "digest string")
    assert {r["g"] for r in cohort.exclude_history(rows, ledger, "g", "digest").collect()} == {2, 3}
    assert tuple(cohort.history_counts(rows, ledger, "g", "digest").first()) == (1, 1, 3)
    hits = cohort.overlap(rows.withColumnRenamed("digest", "d"), ledger.withColumnRenamed("digest", "d"), ["d"]).collect()
    assert [(r["key"], r["value"]) for r in hits] == [("d", "y")]


def test_coverage_and_disjointness(spark):
    parents, variants = spark.createDataFrame([(1,), (2,)], "p int"), spark.createDataFrame([("a",), ("b",)], "v string")
    seen = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (3, "a")], "p int, v string")
    assert {tuple(r) for r in cohort.coverage(parents, variants, seen, "p", "v").collect()} == {(1, "b", "DUPLICATE"), (2, "b", "MISSING"), (3, "a", "UNEXPECTED")}
    roles = spark.createDataFrame([("g", "FIT"), ("g", "BLIND"), ("h", "FIT"), ("h", "FIT")], "g string, r string")
    assert [r["g"] for r in cohort.shared_groups(roles, "g", "r").collect()] == ["g"]
    assert {tuple(r) for r in cohort.unique_violations(spark.createDataFrame([(1, "x"), (2, "x")], "a int, b string"), ["a", "b"]).collect()} == {("b", "x", 2)}


@pytest.mark.parametrize("right", [[(1, "s")], [(1, "s"), (2, "t"), (2, "t")], [(1, "s"), (2, "other")]])
def test_strict_join_fails(spark, right):
    left = spark.createDataFrame([(1, "s"), (2, "t")], "k int, d string")
    with pytest.raises(Exception, match="CASE_SET_DIFFERS|CASE_TWICE|DIFFERS"):
        cohort.strict_join(left, spark.createDataFrame(right, "k int, d string"), "k", ["d"]).collect()


@pytest.mark.parametrize("total, most, want", [(4, 8, [0, 1, 2, 3]), (10, 4, [1, 3, 6, 8]), (7, 7, list(range(7))), (100, 3, [16, 50, 83]), (5, 1, [2])])
def test_evenly_spaced(spark, total, most, want):
    rows = spark.createDataFrame([("a", 10 * i) for i in range(total)], "c string, k long").repartition(3)
    got = sorted((r["position"], r["k"]) for r in banks.evenly_spaced(rows, "c", "k", most).collect())
    assert got == [(p, 10 * p) for p in want]


def test_evenly_spaced_all_sizes(spark):
    rows = spark.createDataFrame([(n, i) for n in range(1, 60) for i in range(n)], "c int, k long")
    for most in (1, 5, 16, 31):
        got = {}
        for r in banks.evenly_spaced(rows, "c", "k", most).collect():
            got.setdefault(r["c"], []).append(r["position"])
        assert all(sorted(got[n]) == (list(range(n)) if n <= most else [((2 * k + 1) * n) // (2 * most) for k in range(most)]) for n in range(1, 60))


def test_stratified_banks_are_prefixes(spark):
    rows = spark.createDataFrame([(s, i) for s, n in (("a", 9), ("b", 2), ("c", 5)) for i in range(n)], "s string, i long").withColumn("h", rank_hex(F.col("s"), F.col("i")))
    bank = lambda n: [(r["s"], r["i"]) for r in banks.stratified(rows.repartition(4), "s", "h", "i", n).orderBy("position").collect()]
    queues = {s: sorted(range(n), key=lambda i: sha(s, i)) for s, n in (("a", 9), ("b", 2), ("c", 5))}
    want = [(s, queues[s][k]) for k in range(9) for s in "abc" if k < len(queues[s])]
    assert bank(16) == want and bank(7) == want[:7]


def test_digests(spark):
    df = spark.createDataFrame([('{"b": 1e-5, "a": "é", "x": 1}',), (None,)], "j string")
    got = [r[0] for r in df.select(canonical_sha256(F.col("j"), drop="x")).collect()]
    assert got[0] == hashlib.sha256(canonical({"b": 1e-5, "a": "é"}).encode()).hexdigest() and got[1] is None
    for bad in ('{"a": 1, "a": 2}', "[NaN]", "[1e999]", "{"):
        with pytest.raises(ValueError):
            parse_strict(bad)
    r = spark.range(1).select(seed(F.lit("x"), F.lit(1)), rounded(F.lit(2.675), 2), safe_relative_path(F.lit("a/b.png")), safe_relative_path(F.lit("a/../b")), safe_relative_path(F.lit("/a")), safe_relative_path(F.lit("C:/a"))).first()
    assert r[0] == str(int.from_bytes(hashlib.sha256(b"x\x001").digest()[:8], "big")) and r[1] == 2.67 and list(r)[2:] == [True, False, False, False]
    with pytest.raises(Exception, match="RANK_MATERIAL_NULL"):
        spark.range(1).select(rank_hex(F.lit("a"), F.lit(None))).collect()


def test_sets_and_policies(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "x")], "k int, d string")
    ledger = spark.createDataFrame([("x",), ("x",), (None,)], "d string")
    assert {r["k"] for r in cohort.drop_known(rows, ledger, "d").collect()} == {2, 3}
    expected = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "c string, expected long")
    of = rows.withColumn("c", F.when(F.col("k") < 4, "a").otherwise("b"))
    assert {tuple(r) for r in cohort.remaining_violations(of, ledger, expected, "c", "d").collect()} == {("b", 0, 1), ("c", 0, 1)}
    assert sorted(r["d"] for r in cohort.union_of_sources([rows, ledger], "d").collect()) == ["x", "y"]
    assert {tuple(r) for r in cohort.set_differences(rows, ledger.filter("d is not null"), ["d"]).collect() if r["d"]} == {("y", "UNKNOWN")}
    raw = spark.createDataFrame([(1, "FIT"), (2, "FIT"), (3, "THRESHOLD_TUNING")], "case_id int, role string")
    children = spark.createDataFrame([(10, 1), (11, 1), (30, 3)], "case_id int, parent_case_id int")
    got = {p: sorted(r["case_id"] for r in cohort.development_inputs(raw, children, p).collect()) for p in ("RAW_FIT_ONLY", "RAW_FIT_PLUS_R3")}
    assert got == {"RAW_FIT_ONLY": [1, 2], "RAW_FIT_PLUS_R3": [1, 2, 10, 11]}
    with pytest.raises(ValueError):
        cohort.development_inputs(raw, children, "ALL")


def test_too_many_variants(spark, monkeypatch):
    monkeypatch.setattr(cohort, "MAX_VARIANTS", 2)
    v = spark.createDataFrame([(1, k) for k in range(3)], "p int, v int")
    with pytest.raises(ValueError):
        cohort.coverage(v, v, v, "p", "v")


def test_ordered_digest(spark):
    rows = spark.createDataFrame([("a", i, f"r{i}") for i in range(10)] + [("b", 1, "x")], "g string, i int, r string").repartition(3)
    got = {r["g"]: (r["records"], r["digest"]) for r in cohort.ordered_digest(rows, ["g"], ["i"], F.col("r"), block=4).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got["a"] == (10, sha("\n".join(sha("\n".join(f"r{i}" for i in range(k, min(k + 4, 10)))) for k in (0, 4, 8)))) and got["b"] == (1, sha(sha("x")))


def test_stratified_sizes_are_prefixes_of_one_ranking(spark):
    from pyspark.sql import functions as F

    from assaylake.functions.digests import rank_hex
    from assaylake.operators import banks

    rows = spark.createDataFrame([(g, s, 100 * s + k) for g in "ab" for s in range(5) for k in range(3 + 4 * s)], "g string, s int, k int").repartition(4)
    ranked = rows.withColumn("h", rank_hex(F.lit("x"), F.col("g"), F.col("k")))
    got = banks.stratified_sizes(ranked, ["g"], "s", "h", "k", [4, 17, 1000]).collect()
    for g in "ab":
        at = {}
        for r in sorted((r for r in ranked.collect() if r["g"] == g), key=lambda r: (r["s"], r["h"], r["k"])):
            at.setdefault(r["s"], []).append(r["k"])
        robin = [at[s][i] for i in range(max(map(len, at.values()))) for s in sorted(at) if i < len(at[s])]
        for size in (4, 17, 1000):
            assert [r["k"] for r in sorted((r for r in got if r["g"] == g and r["maximum"] == size), key=lambda r: r["position"])] == robin[:size]
        one = banks.stratified(ranked.filter(F.col("g") == g), "s", "h", "k", 17).orderBy("position").collect()
        assert [r["k"] for r in one] == robin[:17]


def test_count_faults(spark):
    rows = spark.createDataFrame([("a", "FIT"), ("a", "FIT"), ("b", "FIT"), ("b", None)], "c string, role string")
    got = cohort.count_faults(rows, ["c"], {"fit": ("role = 'FIT'", 2), "other": ("role IS NULL", 0)}).collect()
    assert sorted(map(tuple, got)) == [("b", "fit", 1, 2), ("b", "other", 1, 0)]


def test_history_of_lines_moves_no_text_of_digests(spark, tmp_path):
    """Digests are joined as bytes, and those of the lines that stay are told after the join."""
    from assaylake.plans import queries

    rows = [(1, 1, "N"), (1, 2, "R"), (2, 1, "N"), (2, 2, "A"), (3, 1, "R")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = queries.history_group_anti_join(spark, str(tmp_path))
    assert sorted((r["group_id"], r["l_linenumber"], r["digest"]) for r in out.collect()) == [(2, n, hashlib.sha256(f"2|{n}".encode()).hexdigest()) for n in (1, 2)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan.splitlines()[0] and "LeftAnti" in plan.splitlines()[1]
    assert queries.history_counts(spark, str(tmp_path)).first().asDict() == {"matched_sources": 2, "excluded_groups": 2, "eligible_sources": 2}
