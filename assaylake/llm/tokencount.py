"""Token counts by prefix dynamic programming: the exact number of tokens of every prefix of a text.

The last token of a prefix is the one vocabulary entry that ends it and is compatible with the last token before it: merging the two together
gives the two again. So counts of all prefixes of a pre-token follow from left to right, each from an earlier one, and those of a text by adding
up its pre-tokens. With the counts at hand, a truncation to a budget or the tokens of a cut at any character is a look-up; nothing is encoded again.

Counts are those of the tokenizers library for a byte-level BPE in its JSON format, without tokens added at the ends; the string of an added token
inside a text is that token, as is the library's default. A prefix that ends inside of such a string, inside a run of white space or inside a
contraction is counted as the library counts the prefix itself.

Defined results: null text is empty, with 0 tokens; an empty table gives no rows; other columns stay, those named like a result are replaced.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import byte_characters

LIMIT = 512
#: Pre-tokens that a task remembers, and the longest of them in characters.
MEMORY, MEMORY_CHARS = 250_000, 48


def read_tokenizer(path: str) -> tuple[list[bytes], list[tuple[bytes, bytes]], list[str]]:
    """Vocabulary, merges in order, and strings of added tokens of a byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {ord(c): b for b, c in enumerate(byte_characters())}
    added = [t["content"] for t in spec.get("added_tokens", [])]
    raw = lambda piece: bytes(back[ord(c)] for c in piece)
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    return [raw(p) for p in spec["model"]["vocab"] if p not in added], [(raw(a), raw(b)) for a, b in merges], added


class PrefixCounter:
    """counts(text)[i] is the number of tokens of text[: i + 1]."""

    def __init__(self, vocabulary: list[bytes], merges: list[tuple[bytes, bytes]], added: list[str], pattern: str):
        import ahocorasick
        import regex

        self.vocabulary, self.ranks, self.added = vocabulary, {m: i for i, m in enumerate(merges)}, added
        self.split, self.blanks, self.blank = regex.compile(pattern).findall, regex.compile(r"\s\s").search, regex.compile(r"\s+").fullmatch
        self.at_added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        # Finds the entries that end at a byte, longest first, over bytes as printable characters.
        self.characters = {b: ord(c) for b, c in enumerate(byte_characters())}
        self.entries = ahocorasick.Automaton()
        for i, token in enumerate(vocabulary):
            self.entries.add_word(token.decode("latin-1").translate(self.characters), (i, len(token)))
        self.entries.make_automaton()
        self.pairs: dict[int, bool] = {}
        # Counts of pre-tokens met lately, and before that.
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """BPE as defined: the pair of the lowest rank first, from the left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, last: int, entry: int) -> bool:
        """Whether entry follows last (-1: the start) in the tokens of their bytes."""
        if len(self.pairs) > 2 * MEMORY:
            self.pairs.clear()
        token = self.vocabulary[entry]
        fit = self.merge(token) == [token] if last < 0 else self.merge(self.vocabulary[last] + token) == [self.vocabulary[last], token]
        self.pairs[(last + 1) << 20 | entry] = fit
        return fit

    def prefixes(self, pieces: list[str]) -> list[np.ndarray]:
        """Counts at the characters of each pre-token; these are run through as one string, with a byte between two that no entry has."""
        data = [p.encode() for p in pieces]
        joined = "\n".join(d.decode("latin-1").translate(self.characters) for d in data)
        # State k is that before byte k: the count of the prefix and its last entry, not known yet, or the start of a pre-token.
        count, last = [0] * (len(joined) + 1), [-2] * (len(joined) + 1)
        at = 0
        for d in data:
            last[at] = -1
            at += len(d) + 1
        pairs, fits = self.pairs, self.fits
        for end, (entry, size) in self.entries.iter(joined):
            end += 1
            if last[end] == -2:
                start = end - size
                before = last[start]
                fit = pairs.get((before + 1) << 20 | entry)
                if fit or fit is None and before != -2 and fits(before, entry):
                    last[end], count[end] = entry, count[start] + 1
        raw = np.frombuffer(b"\n".join(data) + b"\n", "u1")
        counts = np.asarray(count[1:], "<u4")
        # A character ends where the next byte starts one.
        counts = counts[((raw[1:] & 0xC0) != 0x80)] if len(counts) else counts
        out, at = [], 0
        for p in pieces:
            own = counts[at : at + len(p)]
            at += len(p) + 1
            if p[0] == "'" and len(p) == 3 and self.split(p[:2]) != [p[:2]]:  # a contraction that is cut falls apart
                own = np.array([own[0], 2, own[2]], "<u4")
            out.append(own)
        return out

    def counts(self, text: str) -> np.ndarray:
        if self.at_added is None or not any(a in text for a in self.added):
            return self._plain(text)
        out, at, base = [], 0, 0
        for m in self.at_added.finditer(text):
            inside = self._plain(text[at : m.end() - 1])
            before = int(inside[m.start() - at - 1]) if m.start() > at else 0
            out += [inside + np.uint32(base), np.array([base + before + 1], "<u4")]
            at, base = m.end(), base + before + 1
        return np.concatenate([*out, self._plain(text[at:]) + np.uint32(base)])

    def _plain(self, text: str) -> np.ndarray:
        parts = self.split(text)
        if not parts:
            return np.zeros(0, "<u4")
        memory = self.memory
        if fresh := set(parts).difference(memory):
            if len(memory) + len(fresh) > MEMORY:
                self.older, self.memory = memory, {}
                memory, fresh = self.memory, set(parts)
            older = self.older
            new = []
            for p in fresh:
                if p in older:
                    memory[p] = older[p]
                else:
                    new.append(p)
            memory.update(zip(new, (c.tobytes() for c in self.prefixes(new))) if new else ())
        flat = np.frombuffer(b"".join(map(memory.__getitem__, parts)), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes)
        upto = np.cumsum(flat[ends - 1], dtype="<u4")
        out = flat + np.repeat(upto - flat[ends - 1], sizes)
        if self.blanks(text):  # a prefix that ends one character after a run of blanks has that character in the run
            starts = ends - sizes
            for k in range(1, len(parts)):
                if parts[k][0].isspace() and self.blank(parts[k - 1]) and self.blank(parts[k][0]):
                    out[starts[k]] = (upto[k - 2] if k > 1 else 0) + self.prefixes([parts[k - 1] + parts[k][0]])[0][-1]
        for p in fresh:
            if len(p) > MEMORY_CHARS:
                memory.pop(p, None)
        return out


def count_tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text", limit: int = LIMIT, prefixes: bool = False) -> DataFrame:
    """docs with n_bytes, n_tokens and limit_chars, the characters of the longest prefix of at most limit tokens; with prefixes, also
    prefix_tokens, an array with the count of every prefix, 1 to all characters."""
    sent = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    def kernel():
        counter = PrefixCounter(*sent.value, pattern)

        def step(texts):
            counts = [counter.counts(t or "") for t in texts]
            within = [np.flatnonzero(c <= limit) for c in counts]
            out = {"n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": [int(c[-1]) if len(c) else 0 for c in counts], "limit_chars": [int(w[-1]) + 1 if len(w) else 0 for w in within]}
            return out | ({"prefix_tokens": [c.astype("i4") for c in counts]} if prefixes else {})

        return step

    return common.map_batches(docs, kernel, [text_col], "n_bytes long, n_tokens long, limit_chars long" + (", prefix_tokens array<int>" if prefixes else ""))


def tokens_at(prefix_tokens: Column, chars: Column) -> Column:
    """Tokens of the first chars characters."""
    return F.coalesce(F.get(prefix_tokens, F.least(chars.cast("int"), F.size(prefix_tokens)) - 1), F.lit(0))


def chars_within(prefix_tokens: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most budget tokens."""
    return F.coalesce(F.array_max(F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i + 1).otherwise(0))), F.lit(0))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "limit_chars")
