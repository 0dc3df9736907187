import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assaylake.llm import tokencount

PATH = P.path("byte_bpe_50k.json")
REFERENCE = Tokenizer.from_file(PATH)
COUNTER = tokencount.PrefixCounter(*tokencount.read_tokenizer(PATH), P.PATTERN)


def tokens(text):
    return len(REFERENCE.encode(text, add_special_tokens=False).ids)


PIECES = st.sampled_from(["a", "the", " and", " ", "  ", "\n", "\t", "'", "'re", "'ll", "s", "12", "!", "é", "中", "😀", "<|endoftext|>", "<|end", "\x1c", "\x85", "　", "Z"])


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join) | st.text(max_size=40))
def test_every_prefix(text):
    assert COUNTER.counts(text).tolist() == [tokens(text[: i + 1]) for i in range(len(text))]


@pytest.mark.parametrize("text", ["a" * 3000, " " * 2000, "ab" * 1500, "中" * 500])
def test_long_pre_tokens(text):
    assert COUNTER.counts(text)[-1] == tokens(text)


def test_frame(odd, none):
    out = tokencount.count_tokens(odd, PATH, P.PATTERN, limit=5, prefixes=True)
    at = out.withColumn("at3", tokencount.tokens_at(F.col("prefix_tokens"), F.lit(3))).withColumn("within", tokencount.chars_within(F.col("prefix_tokens"), F.lit(5)))
    for r in at.collect():
        text = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), tokens(text))
        assert r["within"] == r["limit_chars"] and r["at3"] == tokens(text[:3])
        if text:
            assert tokens(text[: r["within"]]) <= 5 and (r["within"] == len(text) or tokens(text[: r["within"] + 1]) > 5)
    assert tokencount.count_tokens(none, PATH, P.PATTERN).collect() == []
