import random

import numpy as np
import pytest
import xxhash

from assaylake.llm import simhash

from .conftest import docs_frame


def plain(text, words=3):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute(docs, limit=3):
    """doc_id -> (fingerprint, component) of rows (id, text, ...) with an id."""
    prints = {}
    for i, text, *_ in docs:
        if i is not None:
            prints.setdefault(plain(text), []).append(i)
    x = np.array(sorted(prints), np.uint64)
    root = list(range(len(x)))
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x) <= limit):
            a, b = root[i], root[j]
            if a != b:
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for i, f in enumerate(x.tolist()):
        least[root[i]] = min(least.get(root[i], 1 << 62), *prints[f])
    low = {}
    for i, f in enumerate(x.tolist()):
        for d in prints[f]:
            low[d] = min(low.get(d, 1 << 62), least[root[i]])
    return low


def family(rnd, n):
    """Long texts that differ in a few words, chains of changes, short texts and copies."""
    vocabulary = [f"w{k}" for k in range(3000)]
    docs, k = [], 0
    for _ in range(8):
        base = [rnd.choice(vocabulary) for _ in range(900)]
        for _ in range(n):
            docs.append((k, " ".join(base), "s"))
            base[rnd.randrange(len(base))] = rnd.choice(vocabulary)
            k += 1
    docs += [(k + i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 5))), "t") for i in range(60)]
    return docs + [(5000 + i, docs[i][1].upper(), "u") for i in range(0, 40, 3)]


@pytest.mark.parametrize("least", [4, 256])
def test_as_brute_force(spark, least):
    docs = family(random.Random(1), 25)
    got = {r["doc_id"]: (r["fingerprint"] % (1 << 64), r["component"]) for r in simhash.simhash_groups(docs_frame(spark, docs), least=least).collect()}
    want = brute(docs)
    assert got == {i: (plain(t), want[i]) for i, t, _ in docs} and len(set(want.values())) < len({f for f, _ in got.values()})


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = simhash.simhash_groups(odd).collect()
    want = brute(rows)
    assert sorted((str(r["doc_id"]), r["fingerprint"] % (1 << 64), r["component"]) for r in got) == sorted((str(i), plain(t), None if i is None else want[i]) for i, t in rows) or len({i for i, _ in rows}) < len(rows)
    assert all(r["component"] is None for r in got if r["doc_id"] is None) and len(got) == len(rows)
    assert {r["doc_id"] for r in got if r["fingerprint"] == 0} >= {2, 3, 4}
    assert simhash.simhash_groups(none).count() == 0
    only = simhash.simhash_groups(docs_frame(spark, [(7, "one text", "a")])).collect()
    assert [(r["doc_id"], r["component"]) for r in only] == [(7, 7)]


def test_descent_finds_every_pair_once():
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base[rnd.integers(0, 40, 700)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rnd.integers(0, 64, 700).astype(np.uint64))
    x = np.unique(np.r_[near, base, rnd.integers(0, 1 << 63, 300, dtype=np.uint64)])
    rank = simhash.gray_rank(x)
    assert np.array_equal(rank ^ (rank >> np.uint64(1)), x)
    x = x[np.argsort(rank)]
    a, b = x[::2], x[1::2]
    for limit in (0, 3, 6):
        found = [(int(i), int(j)) for i, j in zip(*map(np.concatenate, zip(*simhash.near(a, b, limit))))]
        assert sorted(found) == [(i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i] ^ b) <= limit)]
        found = [tuple(sorted((int(i), int(j)))) for i, j in zip(*map(np.concatenate, zip(*simhash.near(x, x, limit, same=True))))]
        assert sorted(found) == [(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i] ^ x) <= limit) if i < j]
    one = x[:1]
    assert [len(i) for i, _ in simhash.near(one, one, 3, same=True)] in ([0], []) and sum(len(i) for i, _ in simhash.near(one, x, 64)) == len(x)


def test_groups_are_pruned_from_above():
    """Of spread fingerprints few pairs are looked at."""
    x = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    x = x[np.argsort(simhash.gray_rank(x))]
    looked, count = 0, np.bitwise_count

    class Counting:
        def __call__(self, v):
            nonlocal looked
            looked += v.size
            return count(v)

    np.bitwise_count = Counting()
    try:
        list(simhash.near(x, x, 3, same=True))
    finally:
        np.bitwise_count = count
    assert looked < len(x) ** 2 / 2 / 4


def test_spanning_gives_a_forest():
    rnd = np.random.default_rng(4)
    i, j = rnd.integers(0, 200, (2, 5000))
    root, kept = np.arange(200), []
    for at in range(0, 5000, 500):
        kept += [p for a, b in simhash.spanning(root, i[at : at + 500], j[at : at + 500]) for p in zip(a.tolist(), b.tolist())]
    assert len(kept) == 200 - len(set(root.tolist())) and set(kept) <= set(zip(i.tolist(), j.tolist()))
