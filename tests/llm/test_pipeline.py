import re

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from assaylake.llm import bpe, common

from .conftest import docs_frame
from .test_linededup import brute as line_brute
from .test_minhash import brute as near_brute
from .test_toxicity import corpus

COLUMNS = ["doc_id", "text", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs, labels = corpus(600)
    base = docs[0][1]
    docs += [(2000 + i, f"shared line of all\n{docs[i][1]}", "b") for i in range(12)] + [(3000, base, "c"), (3001, None, None), (3002, "", "c")]
    frame = docs_frame(spark, docs)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "mixing", "byte-level BPE"]
    steps = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        steps.append(common.materialize(f(spark, steps[-1], str(tmp_path)), f"step-{k}"))
        if k < 4:
            assert steps[-1].dtypes == frame.dtypes, name
    rows = [[r.asDict() for r in s.collect()] for s in steps]
    kept = {r["doc_id"] for r in rows[1]}
    toxic = {i for i, _, t in labels if t}
    assert len(toxic & kept) <= 0.05 * len(toxic) and len(kept - toxic) >= 0.97 * (len(docs) - len(toxic) - 3)
    want = {t: k for t, k, _, _ in line_brute([r["text"] for r in rows[1]], 10)}
    before = {r["doc_id"]: r["text"] for r in rows[1]}
    assert all(r["text"] == want[before[r["doc_id"]]] and r["n_chars"] == len(r["text"]) for r in rows[2]) and len(rows[2]) == len(rows[1])
    near = near_brute([(r["doc_id"], r["text"]) for r in rows[2]], 5, 80)
    assert {r["doc_id"] for r in rows[3]} == {i for i, (_, c) in near.items() if c == i}
    words = lambda rs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rs)
    assert 1.4 * words(rows[3]) < words(rows[4]) <= 1.5 * words(rows[3])
    vocabulary = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(vocabulary)}, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in rows[4]}
    assert len(rows[5]) == len(rows[4]) and all(r["n_tokens"] == len(encoding.encode_ordinary(texts[r["doc_id"]] or "")) for r in rows[5])


NAMES = "n_lines n_dropped kept_text score predicted weight number tie pass copies virtual_finish row key".split()


def test_odd_rows_and_names(spark, odd, none, tmp_path):
    """Null and repeated ids, no rows, and columns named like the stages' own; the same results however rows are dealt."""
    more = lambda f: f.drop("kept").select("*", *[F.lit(k).cast("long").alias(n) for k, n in enumerate(NAMES)])
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(14)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = []
    for parts in (1, 3, 8):
        docs = more(odd).repartition(parts)
        for name, stage in corpus_pipeline.STAGES[:4]:
            before, docs = docs, common.materialize(stage(spark, docs, str(tmp_path)), "odd-stage")
            assert docs.dtypes == before.dtypes, name
            assert all(r[n] == k for r in docs.collect() for k, n in enumerate(NAMES)), name
        found.append(sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None))
        nulls = [r for r in docs.collect() if r["doc_id"] is None]
        assert all(r["text"] == "one two three four" for r in nulls) and len(nulls) <= 2
    assert found[0] == found[1] == found[2]
    empty = more(none)
    for _, stage in corpus_pipeline.STAGES:
        empty = common.materialize(stage(spark, empty, str(tmp_path)), "empty-stage")
        assert empty.collect() == []
