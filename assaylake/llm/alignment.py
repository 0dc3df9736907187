"""Cross-tokenizer alignment through whitespace-token anchors.

Texts are tokenised whole by both tokenizers. Byte offsets at which tokens of both end are shared ends; a shared end that is followed by a space-marked token on both sides
is an anchor. Anchors cut a text into windows, about a word each, whose alignment depends on the ids of their tokens only: it is worked out once for each
pair of id tuples and kept in a bounded memory of the task. An alignment is the groups between shared ends, and the links, which are all pairs of tokens whose bytes overlap.

A first pass writes each text's groups and its distinct linked id pairs, with how often they occur. A pair's count is the number of texts that have it: tasks add up what they read,
and only these sums are shuffled. The counts, with the mark of the largest of each A id, are looked up where the texts are: by broadcast while the counted pairs are
up to MAX_PAIRS, else by a join in two parts, as a few pairs occur in nearly every text.

A's byte-level BPE is run by tiktoken, from the vocabulary and merges of the JSON file, whose order must be that of the ids; texts with very long runs of white space go to the tokenizers library.

Defined results: null and empty texts, and those whose token bytes don't give a space and the text back, have no tokens: zeros and no groups; rows of a null or repeated id count as texts of their own;
an empty table gives no rows; other columns aren't returned.
"""

from __future__ import annotations

import gc
import hashlib
import json
from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from . import common
from .bpe import byte_characters

#: Windows that a task remembers, and the tokens of the longest of them.
MEMORY, MEMORY_TOKENS = 150_000, 32
#: Bytes of text that are aligned at once.
LOT = 1 << 20
#: Pairs of ids whose counts may be broadcast, 20 bytes each, and those that a task adds up before it gives them out.
MAX_PAIRS, PARTIAL = 4_000_000, 500_000
#: White space characters in a row up to which the pattern is matched by backtracking.
BLANKS = 2_000


class ByteTokens:
    """A: a byte-level BPE of a tokenizers JSON file; encode gives ids of plain text."""

    def __init__(self, spec: str, pattern: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.slow, spec = Tokenizer.from_str(spec), json.loads(spec)
        back, added = {c: b for b, c in enumerate(byte_characters())}, {t["content"] for t in spec.get("added_tokens", [])}
        self.pieces = {i: bytes(back[c] for c in p) for p, i in spec["model"]["vocab"].items() if p not in added}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][m] for m in merged]
        self.slow.encode_special_tokens = True
        ranked = order == sorted(set(order))
        self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={p: i for i, p in self.pieces.items()}, special_tokens={}) if ranked else None
        self.runs = regex.compile(rf"\s{{{BLANKS}}}").search

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.slow.encode_batch(texts, add_special_tokens=False)]
        return [self.slow.encode(t, add_special_tokens=False).ids if self.runs(t) else self.fast.encode_ordinary(t) for t in texts]


class PieceTokens:
    """B: a sentencepiece model, which puts a space ahead of the text itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        piece = self.model.id_to_piece
        self.pieces = {i: bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _sums(x: np.ndarray, start: np.ndarray, end: np.ndarray, power: np.ndarray, back: np.ndarray) -> np.ndarray:
    """For each window a polynomial in its ids, modulo 2 ** 64."""
    total = np.r_[np.uint64(0), np.cumsum((x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * power[: len(x)], dtype=np.uint64)]
    return (total[end] - total[start]) * back[start]


def distinct(a: np.ndarray, from_a: np.ndarray, to_a: np.ndarray, b: np.ndarray, from_b: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of distinct windows, and for each window which of these it is. Windows of one hash are compared by their ids; should two differ, every window is its own."""
    odd = 0xD6E8FEB86659FD93
    n = max(len(a), len(b)) + 1
    power, back = (np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64) for base in (odd, pow(odd, -1, 1 << 64)))
    ends = to_a - from_a, to_b - from_b
    h = _sums(a, from_a, to_a, power, back) * np.uint64(0xFF51AFD7ED558CCD) + _sums(b, from_b, to_b, power, back) + (ends[0] << 32 | ends[1]).astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    for x, start, size in ((a, from_a, ends[0]), (b, from_b, ends[1])):
        like = first[which]
        if not np.array_equal(size, size[like]) or not np.array_equal(x, x[np.repeat(start[like] - start, size) + np.arange(len(x))]):
            return np.arange(len(h)), np.arange(len(h))
    return first, which


def tuples(a: np.ndarray, from_a: np.ndarray, to_a: np.ndarray, b: np.ndarray, from_b: np.ndarray, to_b: np.ndarray) -> list[bytes]:
    """Each window's ids of a, -1 and its ids of b, as bytes of 32 bits."""
    size_a, size_b = to_a - from_a, to_b - from_b
    end = np.cumsum(size_a + 1 + size_b)
    start, out = end - size_a - 1 - size_b, np.full(end[-1] if len(end) else 0, -1, np.int32)
    for x, begin, size, at in ((a, from_a, size_a, start), (b, from_b, size_b, end - size_b)):
        steps = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(at, size) + steps] = x[np.repeat(begin, size) + steps]
    flat, cuts = out.tobytes(), (4 * end).tolist()
    return [flat[p:q] for p, q in zip([0, *cuts], cuts)]


class Aligner:
    """Aligns texts in lots; remembers windows by their ids."""

    def __init__(self, one, two):
        self.one, self.two = one, two
        table = lambda pieces: ([pieces.get(i, b"") for i in range(max(pieces) + 1)])
        self.bytes = table(one.pieces), table(two.pieces)
        self.sizes = [np.array(list(map(len, t)), np.int64) for t in self.bytes]
        self.spaced = [np.array([p.startswith(b" ") for p in t]) for t in self.bytes]
        self.flat = [(np.frombuffer(b"".join(t), np.uint8), np.cumsum(z) - z) for t, z in zip(self.bytes, self.sizes)]
        self.width = len(self.bytes[1])
        self.digits = list(map(str, range(max(map(len, self.bytes)))))
        self.forget()

    def forget(self) -> None:
        """Keeps the windows met most often, an eighth of the memory."""
        kept = sorted(self.known.values(), key=lambda n: -self.uses[n])[: MEMORY // 8] if hasattr(self, "known") else []
        old = self.known if kept else {}
        kept = {n: k for k, n in enumerate(kept)}
        keys = [key for key, n in sorted(((key, kept[n]) for key, n in old.items() if n in kept), key=lambda x: x[1])]
        self.known: dict[bytes, int] = {}
        self.names: list[str] = []
        self.groups, self.links, self.starts, self.codes, self.times = array("q"), array("q"), array("q", [0]), array("q"), array("q")
        self.uses = np.zeros(0, np.int64)
        if keys:
            self.learn(keys)
            self.known = {key: n for n, key in enumerate(keys)}

    def learn(self, keys: list[bytes]) -> None:
        """Aligns new windows, all at once: they are laid end to end, and both sides' windows have as many bytes."""
        flat = np.frombuffer(b"".join(keys), np.int32).astype(np.int64)
        whose, between = np.repeat(np.arange(len(keys)), np.fromiter(map(len, keys), np.int64, len(keys)) // 4), flat < 0
        behind = np.cumsum(between) > whose
        a, b, own = flat[~behind], flat[behind & ~between], whose[~behind]
        size_a, size_b = self.sizes[0][a], self.sizes[1][b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        start_a, start_b = end_a - size_a, end_b - size_b
        low = np.searchsorted(end_b, start_a, side="right")
        count = np.searchsorted(start_b, end_a, side="left") - low
        i = np.repeat(np.arange(len(a)), count)
        j = np.arange(len(i)) + np.repeat(low - (np.cumsum(count) - count), count)
        span = len(self.bytes[0]) * self.width
        codes, times = np.unique(own[i] * span + a[i] * self.width + b[j], return_counts=True)
        which, codes = np.divmod(codes, span)
        at = np.searchsorted(end_b, end_a)
        shared = np.flatnonzero(end_b[at] == end_a)
        groups, links, pairs = (np.bincount(x, minlength=len(keys)) for x in (own[shared], own[i], which))
        cut_a, cut_b, one, two = (shared + 1).tolist(), (at[shared] + 1).tolist(), list(map(self.digits.__getitem__, a.tolist())), list(map(self.digits.__getitem__, b.tolist()))
        named = [f"{one[p]}|{two[r]}" if q - p == 1 == t - r else f"{','.join(one[p:q])}|{','.join(two[r:t])}" for p, q, r, t in zip([0, *cut_a], cut_a, [0, *cut_b], cut_b)]
        to = np.cumsum(groups).tolist()
        self.names += [";".join(named[p:q]) for p, q in zip([0, *to], to)]
        for held, new in ((self.groups, groups), (self.links, links), (self.starts, self.starts[-1] + np.cumsum(pairs)), (self.codes, codes), (self.times, times)):
            held.frombytes(new.astype(np.int64).tobytes())

    def lossless(self, flat: list[np.ndarray], lengths: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
        """Whether the tokens of both sides give a text's bytes back, for each text."""
        good, size_of = np.ones(len(texts), bool), np.fromiter(map(len, texts), np.int64, len(texts))
        for ids, length, pieces, sizes in zip(flat, lengths, self.flat, self.sizes):
            own, size = np.repeat(np.arange(len(texts)), length), sizes[ids]
            good &= np.bincount(own, size, len(texts)).astype(np.int64) == size_of
            kept = good[own]
            ids, size = ids[kept], size[kept]
            made = pieces[0][np.repeat(pieces[1][ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            wrong = np.flatnonzero(made != np.frombuffer(b"".join(t for t, ok in zip(texts, good) if ok), np.uint8))
            good[np.searchsorted(np.cumsum(np.where(good, size_of, 0)), wrong, side="right")] = False
        return good

    def windows(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each window of two id sequences over the same bytes, and the position in a at which it ends."""
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        at = np.searchsorted(end_b, end_a)
        i = np.flatnonzero(end_b[at] == end_a)  # shared ends, by the last tokens of both sides
        j = at[i]
        anchor = self.spaced[0][a[np.minimum(i + 1, len(a) - 1)]] & self.spaced[1][b[np.minimum(j + 1, len(b) - 1)]]
        anchor[-1] = True
        i, j = i[anchor] + 1, j[anchor] + 1
        from_a, from_b = np.r_[0, i[:-1]], np.r_[0, j[:-1]]
        first, which = distinct(a, from_a, i, b, from_b, j)
        keys = tuples(a, from_a[first], i[first], b, from_b[first], j[first])
        if len(self.names) > MEMORY or len(self.codes) > 16 * MEMORY:
            self.forget()
        numbers = list(map(self.known.get, keys))
        if fresh := {key: None for key, number in zip(keys, numbers) if number is None}:
            at = len(self.names)
            self.learn(list(fresh))
            fresh = dict(zip(fresh, range(at, len(self.names))))
            numbers = [fresh[key] if number is None else number for key, number in zip(keys, numbers)]
            self.known |= {k: n for k, n in fresh.items() if len(k) <= 4 * MEMORY_TOKENS}
        numbers = np.array(numbers, np.int64)[which]
        self.uses.resize(len(self.names))
        self.uses += np.bincount(numbers, minlength=len(self.names))
        return numbers, i

    def __call__(self, texts: list[str | None], named: bool) -> dict[str, list]:
        """n_a, n_b, n_groups, n_links, groups (if named, else none), codes and times (bytes of 64 and 32 bits) of each text."""
        n = len(texts)
        out: dict[str, list] = {k: [0] * n for k in ("n_a", "n_b", "n_groups", "n_links")} | {"groups": [""] * n, "codes": [b""] * n, "times": [b""] * n}
        full = [k for k, t in enumerate(texts) if t]
        spaced = [" " + texts[k] for k in full]
        sides = self.one.encode(spaced), self.two.encode([texts[k] for k in full])
        lengths = [np.fromiter(map(len, side), np.int64, len(side)) for side in sides]
        flat = [np.array(list(chain.from_iterable(side)), np.int64) for side in sides]
        good = self.lossless(flat, lengths, [t.encode() for t in spaced])
        if not good.any():
            return out
        rows = np.array(full)[good]
        flat = [ids[np.repeat(good, length)] for ids, length in zip(flat, lengths)]
        n_a, n_b = (length[good].tolist() for length in lengths)
        # Texts begin with a space, so where one ends and the next begins is an anchor.
        numbers, ends = self.windows(*flat)
        own = np.searchsorted(np.cumsum(n_a), ends)  # the text of each window
        cuts = np.r_[0, np.flatnonzero(np.diff(own)) + 1, len(own)]
        counted = lambda values: np.add.reduceat(np.array(values, np.int64)[numbers], cuts[:-1]).tolist()
        for key, values in (("n_a", n_a), ("n_b", n_b), ("n_groups", counted(self.groups)), ("n_links", counted(self.links))):
            for k, v in zip(rows.tolist(), values):
                out[key][k] = v
        if named:
            names = list(map(self.names.__getitem__, numbers.tolist()))
            for k, low, high in zip(rows.tolist(), cuts.tolist(), cuts[1:].tolist()):
                out["groups"][k] = ";".join(names[low:high])
        # Distinct windows of each text, then the distinct pairs of these.
        keys, often = np.unique(own * len(self.names) + numbers, return_counts=True)
        own, window = np.divmod(keys, len(self.names))
        starts, codes, times = (np.array(x, np.int64) for x in (self.starts, self.codes, self.times))
        size = starts[window + 1] - starts[window]
        at = np.repeat(starts[window] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        own, codes, times = np.repeat(own, size), codes[at], times[at] * np.repeat(often, size)
        span = len(self.bytes[0]) * self.width
        order = np.argsort(own * span + codes, kind="stable")
        own, codes, times = own[order], codes[order], times[order]
        first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (codes[1:] != codes[:-1])])
        own, codes, times = own[first], codes[first], np.add.reduceat(times, first).astype(np.uint32)
        for k, low, high in zip(rows.tolist(), np.searchsorted(own, np.arange(len(rows))).tolist(), np.searchsorted(own, np.arange(len(rows)), side="right").tolist()):
            out["codes"][k], out["times"][k] = codes[low:high].tobytes(), times[low:high].tobytes()
        return out


#: What align can add besides counts.
GROUPS: dict[str, Callable[[str], str]] = {"groups": lambda g: g, "groups_sha256": lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""}


def _counts(table: DataFrame) -> DataFrame:
    """(code, count): how many rows have each code; codes are bytes of 64 bits each, once in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        give = lambda: pa.RecordBatch.from_arrays([pa.array(have), pa.array(n)], names=["code", "n"])
        for batch in batches:
            for part in common.slices(batch):
                codes, once = np.unique(np.frombuffer(b"".join(part.column(0).to_pylist()), np.int64), return_counts=True)
                have, where = np.unique(np.r_[have, codes], return_inverse=True)
                n = np.bincount(where, np.r_[n, once], len(have)).astype(np.int64)
                if len(have) > PARTIAL:
                    yield give()
                    have, n = have[:0], n[:0]
        yield give()

    return table.select("codes").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("count"))


def _looked_up(table: DataFrame, counts: DataFrame) -> DataFrame:
    """table with n_best and count_sum, by a broadcast of counts (code, count, best)."""
    known = counts.toPandas()
    known = known.iloc[np.argsort(known["code"].to_numpy(), kind="stable")]
    sent = table.sparkSession.sparkContext.broadcast((known["code"].to_numpy(np.int64), known["count"].to_numpy(np.int64), known["best"].to_numpy(bool)))

    def kernel():
        code, count, best = sent.value

        def step(codes, times):
            sizes = np.array([len(c) // 8 for c in codes])
            own = np.repeat(np.arange(len(codes)), sizes)
            at, often = np.searchsorted(code, np.frombuffer(b"".join(codes), np.int64)), np.frombuffer(b"".join(times), np.uint32).astype(np.int64)
            summed = np.zeros((2, len(codes)), np.int64)
            np.add.at(summed[0], own, often * best[at])
            np.add.at(summed[1], own, often * count[at])
            return {"n_best": summed[0].tolist(), "count_sum": summed[1].tolist()}

        return step

    return common.map_batches(table, kernel, ["codes", "times"], "n_best long, count_sum long").drop("codes", "times")


def _joined(table: DataFrame, counts: DataFrame, links: int) -> DataFrame:
    """As _looked_up, by joins: codes meet their counts one by one, and texts are put together again by row."""

    def kernel():
        def step(rows, codes, times):
            sizes = [len(c) // 8 for c in codes]
            return {"_row": np.repeat(np.array(rows, np.int64), sizes), "code": np.frombuffer(b"".join(codes), np.int64), "times": np.frombuffer(b"".join(times), np.uint32).astype(np.int64)}

        return step

    cells = common.map_batches(table, kernel, ["_row", "codes", "times"], "_row long, code long, times long", keep=False)
    met = common.skew_join(cells, counts, ["code"], "count", links)
    summed = met.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = table.drop("codes", "times").join(summed, "_row", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def align(docs: DataFrame, byte_json: str, pattern: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", adds: Sequence[str] = ("groups",), max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum) and what `adds` names of GROUPS. The tokenizers' files are read at the driver and sent, some MB."""
    with open(byte_json, encoding="utf-8") as one, open(piece_model, "rb") as two:
        files = one.read(), two.read()
    width, sent = len(PieceTokens(files[1]).pieces), docs.sparkSession.sparkContext.broadcast(files)

    def kernel():
        aligner = Aligner(ByteTokens(sent.value[0], pattern), PieceTokens(sent.value[1]))

        def step(texts):
            gc.disable()  # a lot makes many short-lived objects, none of them in a cycle
            try:
                made = aligner(texts, bool(adds))
            finally:
                gc.enable()
            groups = made.pop("groups")
            return made | {name: list(map(GROUPS[name], groups)) for name in adds}

        return step

    kinds = ", ".join(["n_a long, n_b long, n_groups long, n_links long, codes binary, times binary", *(f"{a} string" for a in adds)])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = common.map_batches(rows, kernel, ["text"], kinds, most=LOT).drop("text").withColumn("_row", F.monotonically_increasing_id())
    table = common.materialize(table, "aligned")
    counts = common.materialize(_counts(table), "pair-counts")
    # An A id has a row for each B id at most.
    most = F.max("count").over(W.partitionBy(F.floor(F.col("code") / width)))
    counts = common.materialize(counts.withColumn("best", F.col("count") == most), "pair-best")
    if counts.limit(max_pairs + 1).count() <= max_pairs:
        out = _looked_up(table, counts)
    else:
        out = _joined(table, counts, counts.agg(F.sum("count")).first()[0])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", *adds)


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"), adds=("groups_sha256",))
