import random
import re
import time

import numpy as np
import pytest

from assaylake.llm import graph, minhash

from .conftest import docs_frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(docs, k):
    out = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        out[i] = {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set()
    return out


def brute(docs, k, percent):
    sets = sets_of(docs, k)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rnd, vocabulary, size, copies, change):
    base = [rnd.choice(vocabulary) for _ in range(size)]
    for _ in range(copies):
        yield " ".join(rnd.choice(vocabulary) if rnd.random() < change else w for w in base)


def test_as_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [t for size, copies, change in [(60, 40, 0.02), (200, 30, 0.03), (12, 20, 0.01), (400, 60, 0.025), (90, 25, 0.05)] for t in family(rnd, vocabulary, size, copies, change)]
    chain = [rnd.choice(vocabulary) for _ in range(200)]
    for k in range(25):  # each is like the next, the ends aren't
        chain = chain[:-4] + [] if k % 2 else [rnd.choice(vocabulary)] * 1 + chain[5:] + [rnd.choice(vocabulary) for _ in range(4)]
        texts.append(" ".join(chain))
    texts += [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(80))) for _ in range(60)] + ["", None, "a", "A", "a b", "a b c", "a b d"]
    ids = rnd.sample(range(5000), len(texts))
    docs = list(zip(ids, texts))
    for words, percent in [(3, 85), (5, 80)]:
        got = minhash.near_dedup(docs_frame(spark, [(i, t, "a") for i, t in docs]), words, percent).collect()
        want = brute(docs, words, percent)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd(odd):
    got = minhash.near_dedup(odd, 3, 85).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert by[8]["component_id"] == by[9]["component_id"] == 7 and by[1]["component_id"] == 0
    assert by[2]["n_shingles"] == 0 and by[2]["kept"] and by[3]["component_id"] == 3
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert by[5]["component_id"] == 5 and by[6]["component_id"] == 6  # only A-Z are folded


def test_empty(none):
    assert minhash.near_dedup(none).collect() == []


def test_region_takes_all_pairs_across():
    rnd = np.random.default_rng(1)
    labels = np.zeros((500, 2 * minhash.DEPTH), np.uint8)
    component = np.r_[np.zeros(498, np.int64), [1, 2]]
    pairs = {(int(a), int(b)) for i, j in minhash._region(labels, component, minhash.START) for a, b in zip(i, j)}
    assert pairs == {(i, j) for i in range(500) for j in range(i + 1, 500) if component[i] != component[j]}
    crowd = rnd.integers(0, 2, (400, 2 * minhash.DEPTH)).astype(np.uint8)
    crowd[:, : 2 * minhash.START] = 0
    crowd = crowd[np.lexsort(crowd.T[::-1])]
    pairs = [(int(a), int(b)) for i, j in minhash._region(crowd, np.arange(400), minhash.START) for a, b in zip(i, j)]
    assert 399 <= len(set(pairs)) < 400 * 399 // 2 and {(i, i + 1) for i in range(399)} <= set(pairs)


def test_components(spark):
    links = [(i + 1, i) for i in range(60)] + [(100, 105), (105, 103), (7, 7)] + [(200, i) for i in range(201, 400)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 103: 100, 105: 100} | {i: 200 for i in range(200, 400)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_template_below_the_threshold(spark):
    rnd = random.Random(8)
    base = [f"t{i}" for i in range(172)]
    texts = [base + [f"d{d}x{i}" for i in range(28)] for d in range(1100)]  # 0.75 to each other
    links = rnd.sample(range(1100), 60)
    texts += [texts[d][:-21] + [f"e{d}x{i}" for i in range(21)] for d in links]  # 0.81 to one of them
    got = minhash.near_dedup(docs_frame(spark, [(i, " ".join(t), "a") for i, t in enumerate(texts)]), 3, 80).collect()
    want = {i: i for i in range(len(texts))} | {1100 + k: d for k, d in enumerate(links)}
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_exact_pairs_with_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = list(family(rnd, vocabulary, 60, 60, 0.02)) + list(family(rnd, vocabulary, 30, 40, 0.02))
    docs = list(enumerate(texts))
    classes = spark.createDataFrame([(i, 0 if i < 45 else i, 0) for i, _ in docs], "id long, component long, home long")
    found = minhash.exact_pairs(docs_frame(spark, [(i, t, "a") for i, t in docs]), classes, 3, 80, "doc_id", "text").collect()
    got = {tuple(map(int, p)) for r in found for p in minhash.unpack(list(r["packed"]))}
    sets = sets_of(docs, 3)
    like = {(a, b) for a in sets for b in sets if a < b and max(a, b) >= 45 and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert like and like <= got and not any(b < 45 for _, b in got)


@pytest.mark.parametrize("parts", [1, 50])
def test_regions_meet_across_borders(spark, parts):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        sig = bytes(2 * minhash.HASHES)
        frame = lambda parts: spark.createDataFrame([(i, 100, c, i // 128, sig) for i, c in enumerate(parts)], "id long, size long, component long, home long, sig binary")
        component = [1000] + [7] * 298 + [2000]
        pairs, split = minhash.second_round(frame(component), 80)
        got = {tuple(map(int, p)) for r in pairs.collect() for p in minhash.unpack(list(r["packed"]))}
        assert got == {(a, b) for a in range(300) for b in range(a + 1, 300) if component[a] != component[b]}
        assert split.collect() == []
        assert {r["id"] for r in minhash.second_round(frame(range(300)), 80)[1].collect()} == set(range(300))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_homes_with_many_pairs_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", 8)
    pairs = [(a, b) for a in range(5) for b in range(100, 140)] + [(200, 201)]
    rows = [(minhash.PAIRS, 0 if a < 5 else 1, np.array([(a, b)], np.int64).tobytes()) for a, b in pairs]
    found = minhash.by_home(spark.createDataFrame(rows, "kind int, home long, packed binary"), "test").collect()
    groups = [(r["home"], [tuple(map(int, p)) for p in minhash.unpack(list(r["packed"]))]) for r in found]
    assert sorted(p for _, g in groups for p in g) == pairs and [len(g) for h, g in groups if h == 1] == [1]
    assert len([g for h, g in groups if h == 0]) > 10 and max(len({b for _, b in g}) for _, g in groups) <= 8


def test_region_of_one_component_and_an_outsider_is_quick():
    n = 200_000
    labels, component = np.zeros((n, 2 * minhash.DEPTH), np.uint8), np.zeros(n, np.int64)
    component[n // 2] = 1
    began = time.process_time()
    assert sum(len(i) for i, _ in minhash._region(labels, component, minhash.START)) == n - 1
    assert time.process_time() - began < 2


def test_pairs_with_few_others_stay_together(spark):
    """20,000 pairs need 300 sets: dealt by pairs, each set of the home went to some 20 groups."""
    pairs = np.array([(a, b) for a in range(100) for b in range(1000, 1200)], np.int64)
    found = minhash.by_home(spark.createDataFrame([(minhash.PAIRS, 0, pairs.tobytes())], "kind int, home long, packed binary"), "test").collect()
    assert sum(len(np.unique(minhash.unpack(list(r["packed"])))) for r in found) <= 400
    assert sorted(tuple(map(int, p)) for r in found for p in minhash.unpack(list(r["packed"]))) == sorted(map(tuple, pairs.tolist()))


def test_crowd_of_unlinked_near_copies_moves_few_sets(spark, monkeypatch):
    """Near copies of one text, most below the threshold: each set moves a few times, not once for each group of its pairs, and no link is lost."""
    rnd = random.Random(12)
    vocabulary = [f"w{i}" for i in range(20000)]
    base = [rnd.choice(vocabulary) for _ in range(150)]
    texts = []
    for _ in range(900):
        words = list(base)
        for _ in range(rnd.randrange(1, 18)):
            words[rnd.randrange(150)] = rnd.choice(vocabulary)
        texts.append(" ".join(words))
    visits, write = [], minhash.common.materialize

    def counted(df, name, *more):
        out = write(df, name, *more)
        if name == "minhash-visits":
            visits.append(out.count())
        return out

    monkeypatch.setattr(minhash.common, "materialize", counted)
    docs = list(enumerate(rnd.sample(texts, len(texts))))
    got = minhash.near_dedup(docs_frame(spark, [(i, t, "a") for i, t in docs]), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs, 3, 85)
    assert sum(visits) <= 20 * len(docs)
