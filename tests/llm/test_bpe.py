import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from assaylake.llm import bpe

VOCABULARY = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(VOCABULARY)}, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(VOCABULARY, P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    e = test_any_text.encoder = getattr(test_any_text, "encoder", None) or bpe.Encoder(VOCABULARY, P.PATTERN)
    ids = e.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == REFERENCE.encode_ordinary(text)
    assert e.decode(ids) == text.encode()


def test_memory_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 50)
    rnd = random.Random(2)
    for _ in range(40):
        text = " ".join("".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 70))) for _ in range(30))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == REFERENCE.encode_ordinary(text)
        assert len(encoder.memory) <= 50 + 31


def test_frame(odd, none):
    out = bpe.encode(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    back = bpe.decode(out, P.path("byte_bpe_50k.tiktoken")).collect()
    assert len(back) == odd.count()
    for r in back:
        want = REFERENCE.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(want) and bytes(r["ids"]) == np.array(want, "<u4").tobytes() and bytes(r["decoded"]) == (r["text"] or "").encode()
    for r in bpe.encode(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, adds=("ids_sha256", "decoded_sha256")).collect():
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.encode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []
