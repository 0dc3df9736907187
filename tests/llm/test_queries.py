"""Every opN_ query over the smallest given tables: against its SQL, or against the library or a plain reading."""

import html
import re
from pathlib import Path

import duckdb
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
import tokenizers

from assaylake.llm import bpe, entry

from .test_minhash import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def plain(r):
    return sorted((tuple(str(x) for x in r_) for r_ in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    want = con.sql(SQL[name]).select(*[f'"{c}"' for c in got.columns])
    assert plain(got.collect()) == plain(want.fetchall())


def test_op2(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op2_minhash"](spark, SF).collect()}
    want = brute([(r["doc_id"], r["text"]) for r in table("documents")], 3, 85)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_op4_and_op7(spark):
    vocabulary = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    one = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(vocabulary)}, special_tokens={})
    two = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in table("documents")}
    assert {r["doc_id"]: r["n_tokens"] for r in QUERIES["op4_bpe"](spark, SF).collect()} == {i: len(one.encode_ordinary(t)) for i, t in texts.items()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op7_token_counts"](spark, SF).collect()}
    counts = {i: len(two.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert got == {i: (len(t.encode()), counts[i], counts[i] > 512) for i, t in texts.items()}


def test_op6(spark):
    """Against the contract, and the stored form read page by page."""
    import hashlib
    import zlib

    got = {r["doc_id"]: r for r in QUERIES["op6_ogg"](spark, SF).collect()}
    by_text = {}
    for r in table("documents"):
        raw = (r["text"] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        x = got[r["doc_id"]]
        assert x["n_bytes"] == len(raw) and x["payload_bytes"] == len(payload) and x["payload_sha256"] == hashlib.sha256(payload).hexdigest() and x["tail_crc32"] == zlib.crc32(payload[-64:])
        assert x["media_bytes"] > len(payload) and len(x["media_sha256"]) == 64
        by_text.setdefault(raw, set()).add((x["media_sha256"], x["media_bytes"], x["feature"]))
    assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v))[0] for v in by_text.values()}) == len(by_text)


def test_op9(spark):
    """Against a plain scorer over the fitted model: every entry at every word, no automaton."""
    import math
    import zlib

    from assaylake.llm import toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    a, b, c = model.coefficients
    want = {}
    for r in table("documents"):
        folded = toxicity.fold(r["text"])
        words, total = ["", *folded.split(), ""], 0.0
        for before, word, after in zip(words, words[1:], words[2:]):
            if (before, word) not in model.phrases and (word, after) not in model.phrases:
                total += sum(w for term, w in model.terms.items() if word.startswith(term))
        z = a + b * math.log1p(total) + c * math.log1p(100 * total / max(len(folded), 1))
        want[r["doc_id"]] = (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0, 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
    got = {r["doc_id"]: r for r in QUERIES["op9_toxicity"](spark, SF).collect()}
    assert set(got) == set(want) and any(s >= 0.5 for _, s in want.values())
    for i, (held, score) in want.items():
        assert got[i]["held_out"] == held and abs(got[i]["score"] - score) < 1e-9 and got[i]["predicted"] == int(score >= 0.5)


def article(page):
    """The generated pages have one article each: its text, read by plain expressions."""
    inner = re.search(r"<article[^>]*>(.*?)(?:</article>|$)", page or "", re.S)
    inner = re.sub(r"<!--.*?-->|<(script|style|form|aside|nav)\b.*?</\1>", "", inner[1], flags=re.S) if inner else ""
    inner = re.sub(r"</?(p|h\d|br|ul|li|div|section|table|tr|td)\b[^>]*>", " ", inner)
    return " ".join(html.unescape(re.sub(r"</?[a-zA-Z][^>]*>", "", inner)).split())


def test_op10(spark):
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in QUERIES["op10_main_text"](spark, SF).collect()}
    assert got == {r["page_id"]: (t := article(r["html"]), len(t)) for r in table("pages")}


def test_op11(spark):
    from .test_simhash import brute as components, plain as fingerprint

    rows = [(r["doc_id"], r["text"]) for r in table("documents")]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op11_simhash"](spark, SF).collect()}
    want = components(rows)
    assert got == {i: (f"{fingerprint(t):016x}", want[i]) for i, t in rows}


def test_op12(spark):
    import numpy as np

    rows = [(r["vec_id"], r["embedding"]) for r in table("embeddings")]
    rows = [(i, [float(c) for c in v]) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all()]
    x = np.floor(64 * np.array([v for _, v in rows])) + 1_000_000
    mean = x.mean(axis=0)
    cov = (x - mean).T @ (x - mean) / len(x)
    e, u = np.linalg.eigh(cov)
    want = ((x - mean) @ u[:, ::-1] / np.sqrt(e[::-1]))[:, :32]
    got = {(r["vec_id"], r["component"]): r for r in QUERIES["op12_whitening"](spark, SF).collect()}
    assert len(got) == len(rows) * 32
    for k, (i, _) in enumerate(rows):
        for c in range(32):
            r = got[i, c + 1]
            assert abs(abs(r["whitened"]) - abs(want[k, c])) < 1e-6 and r["n"] == len(rows) and abs(r["explained"] - e[::-1][c] / np.trace(cov)) < 1e-9 and r["identity_error"] < 1e-4
    sums = x.sum(axis=0)
    assert {i: got[i, 1]["deviation"] for i, _ in rows} == {i: int(((len(x) * v - sums) ** 2).sum()) for (i, _), v in zip(rows, x)}


def test_op13(spark):
    import hashlib

    import sentencepiece

    from .test_alignment import PATHS, plain as aligned

    one = tokenizers.Tokenizer.from_file(PATHS[0])
    one.encode_special_tokens = True
    rows = table("documents")
    want = aligned([r["text"] for r in rows], (one, sentencepiece.SentencePieceProcessor(model_file=PATHS[2])))
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_alignment"](spark, SF).collect()}
    assert got == {r["doc_id"]: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for r, w in zip(rows, want)}
