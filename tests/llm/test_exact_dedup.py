import hashlib
from collections import defaultdict

import pytest

from assaylake.llm import exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[(r["text"] or "").translate(LOWER)].append(r["doc_id"])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_as_brute_force(odd, digest_bytes):
    # One byte of digest makes different texts meet, so that only their bytes tell them apart.
    got = exact_dedup.exact_dedup(odd, digest_bytes=digest_bytes).collect()
    assert sorted([(r["id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got], key=str) == brute(odd)


def test_collisions(spark):
    docs = spark.createDataFrame([(i, f"text {i % 300}") for i in range(900)], "doc_id long, text string")
    got = exact_dedup.exact_dedup(docs, digest_bytes=1).collect()
    assert {(r["id"], r["keep_id"], r["group_size"]) for r in got} == {(i, 600 + i % 300, 3) for i in range(900)}


def test_smallest_stays(odd):
    kept = {r["id"] for r in exact_dedup.exact_dedup(odd, keep="smallest").filter("kept").collect()}
    assert {0, 2, 7, 10} <= kept and not {1, 3, 4, 9} & kept


def test_empty(none):
    assert exact_dedup.exact_dedup(none).collect() == []


@pytest.mark.parametrize("most", [exact_dedup.MAX_PIECES, 0])
def test_runs_and_segments(spark, monkeypatch, most):
    monkeypatch.setattr(exact_dedup, "MAX_PIECES", most)
    index = exact_dedup.DigestIndex(9)
    for k in range(3):
        index.flush(spark.createDataFrame([(bytearray([i]), 10 * k + i) for i in range(k, 4)] * 2, "digest binary, ident long"))
    if most:  # what a run shares with older ones is known by their filter
        assert [sorted(bytes(r["digest"]) for r in s.collect()) for s in index.shared] == [[b"\1", b"\2", b"\3"], [b"\2", b"\3"]]
    assert all([bytes(r["digest"]) for r in run.collect()] == sorted(bytes(r["digest"]) for r in run.collect()) for run in index.runs)
    got = {(bytes(r["digest"]), r["ident"], r["n"]) for r in index.compact().collect()}
    assert got == {(b"\0", 0, 2), (b"\1", 1, 4), (b"\2", 2, 6), (b"\3", 3, 6)}


def test_beyond_the_filters(odd, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_PIECES", 0)
    got = exact_dedup.exact_dedup(odd, runs=2).collect()
    assert sorted([(r["id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got], key=str) == brute(odd)


def test_filter_loses_nothing(spark):
    keys = spark.range(0, 70_000, 7).withColumnRenamed("id", "k")
    assert exact_dedup.pieces_for(10_000) == 5 and exact_dedup.pieces_for(10**9) is None
    every = spark.range(70_000).withColumnRenamed("id", "k")
    passed = {r["k"] for r in exact_dedup.among(every, keys, "k").collect()}
    assert set(range(0, 70_000, 7)) <= passed and len(passed) - 10_000 < 600
    left = {r["k"] for r in exact_dedup.without(every.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k")), keys, "k").collect()}
    assert left == {k for k in range(70_000) if k % 7} | {None}
