from collections import Counter

import numpy as np
import pandas as pd
import pytest

from assaylake.llm import linededup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)


def brute(texts, min_docs):
    found = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if found[key(x)] < min_docs]
        out.append((t, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs", [1, 2, 10])
@pytest.mark.parametrize("volume_bytes", [64 << 20, 1])
def test_as_brute_force(odd, min_docs, volume_bytes):
    got = linededup.dedup_lines(odd, min_docs=min_docs, volume_bytes=volume_bytes).collect()
    assert sorted([(r["text"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in got], key=str) == brute([r["text"] for r in odd.collect()], min_docs)


def test_empty(none):
    assert linededup.dedup_lines(none).collect() == []


@pytest.mark.parametrize("n", [1, 2, 5, 100, 3000])
def test_hash_is_minimal_and_perfect(n):
    rnd = np.random.default_rng(n)
    h = rnd.integers(-(2**63), 2**63 - 1, (n, 2))
    row = linededup.build_shard(pd.DataFrame({"h1": h[:, 0], "h2": h[:, 1], "n": np.arange(n) + 1, "shard": 0})).iloc[0]
    volume = linededup.Volume([row], 0)
    assert len(volume.prints) == n
    assert volume.count(h[:, 0].view(np.uint64), h[:, 1].view(np.uint64)).tolist() == list(range(1, n + 1))
    other = rnd.integers(-(2**63), 2**63 - 1, (1000, 2)).view(np.uint64)
    assert not volume.count(other[:, 0], other[:, 1]).any()


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 16)
    texts = [f"line {i % 200}\nown {i}\nline {(7 * i) % 200}" for i in range(600)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    for volume_bytes in (64 << 20, 700):
        got = linededup.dedup_lines(docs, min_docs=3, volume_bytes=volume_bytes).collect()
        assert sorted([(r["text"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in got], key=str) == brute(texts, 3)


def test_hot_shards_and_repeated_texts(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_LINES", 50)
    texts = [f"of all\nown {i % 150}\nline {i % 20}" for i in range(600)] + [None, "", "\n", "of all", "OF ALL \n"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    got = linededup.dedup_lines(docs, min_docs=5, volume_bytes=0).collect()
    assert sorted([(r["text"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in got], key=str) == brute(texts, 5)


@pytest.mark.parametrize("volume_bytes", [64 << 20, 0])
def test_clashing_columns(spark, volume_bytes):
    docs = spark.createDataFrame([(i, "a\nb" if i < 12 else f"c {i}", i, i, str(i), str(i), str(i)) for i in range(20)], "doc_id long, text string, n_chars int, n_lines long, kept_text string, row string, key string")
    got = linededup.without_shared_lines(docs, volume_bytes=volume_bytes)
    assert got.dtypes == docs.dtypes
    assert sorted(map(tuple, got.collect())) == [(i, t := "" if i < 12 else f"c {i}", len(t), i, str(i), str(i), str(i)) for i in range(20)]
    assert linededup.dedup_lines(docs, volume_bytes=volume_bytes).columns == ["doc_id", "text", "n_chars", "row", "key", "kept_text", "n_lines", "n_dropped"]


def test_counts_are_consulted(spark):
    docs = spark.createDataFrame([(f"line {i % 7}\nown {i}",) for i in range(20)], "text string")
    index, bits = linededup.line_index(docs)
    assert linededup.Volume(index.collect(), bits).n.sum() == 7
    assert sum(r["n_dropped"] for r in linededup.dedup_lines(docs, min_docs=3).collect()) == 18
