import bisect
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers

from assaylake.llm import alignment
from assaylake.llm.bpe import byte_characters

from .conftest import docs_frame

PATHS = P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    one = tokenizers.Tokenizer.from_file(PATHS[0])
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=PATHS[2])


def plain(texts, libraries):
    """Rows n_a, n_b, n_groups, n_links, n_best, count_sum, groups, by the libraries and all pairs of overlapping tokens."""
    one, two = libraries
    back = {c: b for b, c in enumerate(byte_characters())}
    made, counts = [], Counter()
    for t in texts:
        a, b = (one.encode(f" {t}", add_special_tokens=False).ids, two.encode(t)) if t else ([], [])
        bytes_a = [bytes(back[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(two.id_to_piece, b)]
        if not t or b"".join(bytes_a) != f" {t}".encode() or b"".join(bytes_b) != f" {t}".encode():
            made.append(([], [], [], []))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, bytes_a))).tolist(), np.cumsum(list(map(len, bytes_b))).tolist()
        groups, p, q = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_p, to_q = ends_a.index(end, p) + 1, ends_b.index(end, q) + 1
            groups.append(",".join(map(str, a[p:to_p])) + "|" + ",".join(map(str, b[q:to_q])))
            p, q = to_p, to_q
        links = []
        for i, end in enumerate(ends_a):
            j = bisect.bisect_right(ends_b, end - len(bytes_a[i]))
            while j < len(b) and ends_b[j] - len(bytes_b[j]) < end:
                links.append((a[i], b[j]))
                j += 1
        counts.update(set(links))
        made.append((a, b, groups, links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    return [(len(a), len(b), len(g), len(k), sum(counts[x] == most[x[0]] for x in k), sum(counts[x] for x in k), ";".join(g)) for a, b, g, k in made]


TEXTS = [
    "Hello world, tokenizers differ.", "hello  world\n\n  indented\tand é ö ﬁ 日本語 😀", None, "", " ", "   ", "\n", "<|endoftext|> is text, so is <s> and <0x41>", "U+2581 ▁ is a space to B", "a" * 5000, " " * 3000 + "x" + " " * 2500,
    "Hello world, tokenizers differ.", "antidisestablishmentarianism unbelievable 1234567890 3.14159 http://x.y/z?q=1&r=2", "x", " leading", "trailing ", "zero\x00byte \x7f ​﻿",
] + ["the same words again and again " * k for k in range(1, 6)]


@pytest.mark.parametrize("max_pairs", [alignment.MAX_PAIRS, 0])
def test_as_plain(spark, libraries, max_pairs):
    rows = docs_frame(spark, [(k, t, "s") for k, t in enumerate(TEXTS)] + [(None, "null id", "s"), (3, "x", "s")])
    out = alignment.align(rows, *PATHS, adds=("groups", "groups_sha256"), max_pairs=max_pairs)
    got = sorted(map(str, (tuple(r) for r in out.collect())))
    texts = [*TEXTS, "null id", "x"]
    ids = [*range(len(TEXTS)), None, 3]
    want = [(i, *w, hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for i, w in zip(ids, plain(texts, libraries))]
    assert got == sorted(map(str, want))


def test_small_memory_and_hash_collisions(libraries, monkeypatch):
    """Forgetting windows, and windows whose hashes are all equal, change nothing."""
    with open(PATHS[0], encoding="utf-8") as f, open(PATHS[2], "rb") as g:
        sides = alignment.ByteTokens(f.read(), P.PATTERN), alignment.PieceTokens(g.read())
    texts = [t or "" for t in TEXTS] * 2
    want = alignment.Aligner(*sides)(texts, True)
    monkeypatch.setattr(alignment, "MEMORY", 16)
    small = alignment.Aligner(*sides)
    for _ in range(3):
        assert small(texts, True) == want
    monkeypatch.setattr(alignment, "_sums", lambda x, start, end, power, back: np.zeros(len(start), np.uint64))
    assert alignment.Aligner(*sides)(texts, True) == want


def test_long_text_and_empty_table(spark, none, libraries):
    text = " ".join(f"word{k % 700} " + "é" * (k % 5) for k in range(30_000))
    got = alignment.align(docs_frame(spark, [(1, text, "s")]), *PATHS).first()
    assert tuple(got)[1:] == plain([text], libraries)[0]
    assert alignment.align(none, *PATHS).collect() == []
