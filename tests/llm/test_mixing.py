import re
from collections import defaultdict

from pyspark.sql import functions as F

from assaylake.llm import mixing

from .conftest import docs_frame


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Water filling as it is told: shares by weight, caps, the excess shared again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    out, left, open_ = {s: 0.0 for s in order}, 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            out[s] += share[s]
            if out[s] >= 2 * sizes[s]:
                left += out[s] - 2 * sizes[s]
                out[s] = 2.0 * sizes[s]
                open_.discard(s)
    return out


def check(rows):
    size, taken = defaultdict(int), defaultdict(int)
    for r, text, source in rows:
        assert r["size"] == words(text) and r["taken"] in (0, r["size"], 2 * r["size"])
        size[source] += r["size"]
        taken[source] += r["taken"]
    want = targets(size)
    most = max([r["size"] for r, _, _ in rows], default=0)
    for r, _, source in rows:
        assert r["source_size"] == size[source] and abs(r["target"] - want[source]) < 1e-6 * max(1, want[source])
        assert abs(taken[source] - want[source]) <= 2 * most
    assert sum(taken.values()) <= 1.5 * sum(size.values())


def test_targets_are_met(spark):
    docs = [(i, " ".join(["w"] * (1 + i * 37 % 23)), ["a", "b", "c", "d", None, "e é"][(i * i) % 6 if i % 3 else 0]) for i in range(1500)]
    frame = docs_frame(spark, docs)
    by = {i: (t, s) for i, t, s in docs}
    got = mixing.mix(frame).collect()
    check([(r, *by[r["id"]]) for r in got])
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(frame.repartition(7)).collect()), key=str)
    counts = {r["id"]: r["copies"] for r in got}
    mixed = mixing.mixed_documents(frame).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in mixed} == {i: n for i, n in counts.items() if n}


def test_odd(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert sum(r["taken"] for r in got) <= 1.5 * sum(r["size"] for r in got)
    assert mixing.mix(none).collect() == []
    assert mixing.mixed_documents(none).collect() == []


def test_one_source_and_no_words(spark):
    check([(r, "a b c", "s") for r in mixing.mix(docs_frame(spark, [(i, "a b c", "s") for i in range(40)])).collect()])
    assert [r["taken"] for r in mixing.mix(docs_frame(spark, [(1, "", "s"), (2, None, None)])).collect()] == [0, 0]


def test_each_row_keeps_its_copies(spark, odd):
    repeated = docs_frame(spark, [(1, "one two three", "a")] * 2 + [(1, "uno dos tres", "a"), (1, "four", "b"), (None, "five six", "a"), (None, "five six", "a")])
    for frame in (odd, repeated):
        want = defaultdict(int)
        for r in mixing.mix(frame).collect():
            want[r["id"], r["size"]] += r["copies"]
        got = defaultdict(int)
        for r in mixing.mixed_documents(frame).collect():
            got[r["doc_id"], words(r["text"])] += 1
        assert got == {k: n for k, n in want.items() if n}


def test_reruns_agree_with_repeated_ids(spark):
    docs = [(i % 40, " ".join(["w"] * (1 + i * 31 % 17) + [f"x{i % 5}"]), "ab"[i % 2]) for i in range(400)] + [(None, f"n {i}", "b") for i in range(50)]
    runs = [sorted(map(str, mixing.mix(docs_frame(spark, docs, parts)).collect())) for parts in (1, 3, 8)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 450


def test_edge_is_sorted_again(spark, monkeypatch):
    docs = [(i, " ".join(["w"] * (1 + i * 37 % 23)), f"s{i % 90:02d}") for i in range(2000)]
    frame = docs_frame(spark, docs)
    want = sorted(map(tuple, mixing.mix(frame).collect()))
    check([(r, docs[r["id"]][1], docs[r["id"]][2]) for r in mixing.mix(frame).collect()])
    monkeypatch.setattr(mixing, "RANGES", 2)
    monkeypatch.setattr(mixing, "EDGE_ROWS", 10)
    assert sorted(map(tuple, mixing.mix(frame).collect())) == want


def test_clashing_columns(spark):
    rows = [(i, "a b c", "s", i, i, i, i, i, i, str(i)) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, number long, size long, pass long, copies long, virtual_finish long, tie long, row string")
    got = mixing.mixed_documents(frame).collect()
    assert len(got) == 45 and all(r["number"] == r["size"] == r["copies"] == r["tie"] == int(r["row"]) == r["doc_id"] for r in got)
