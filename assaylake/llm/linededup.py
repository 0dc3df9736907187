"""Line dedup: a sharded minimal perfect hash over the repeated lines; documents probe its arrays instead of joining lines.

A line's key is the line without [\\x20\\x09-\\x0D] at its ends and with A-Z lower-cased; 128 bits of hash stand for it. Counting needs one
aggregation over (hash, documents), combined ahead of the shuffle. Lines found in several documents are dealt by the first bits of their
hash to shards of about SHARD_KEYS lines. Each shard gets a minimal perfect hash (displacements by bucket) that gives the slot of a line in two
arrays: 64-bit fingerprints and counts. A line that isn't in the index is found in one document only, so the index answers for every line.

Documents probe these arrays where they are, without a shuffle, while the index has at most volume_bytes and can be broadcast. Beyond that the hashes of their lines go to the shards,
hot shards in several shares, and what is found comes back by a hash of the text; only texts that lose lines move, once.

Defined results: null or empty text is one empty line; empty keys are never dropped; each row counts as a document of its own, so
repeated rows count; a text all of whose lines go becomes empty; an empty table gives no rows; other columns stay, whatever their names, those named like a result are replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .exact_dedup import among, without

MIN_DOCS = 10
#: Lines of a shard, and displacements that are tried at a time.
SHARD_KEYS, TRIALS = 2048, 64
#: Bytes of an index that is broadcast, and lines that meet a shard in one group beyond that.
VOLUME_BYTES, SHARD_LINES = 64 << 20, 200_000
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def line_keys(text: str | None) -> list[bytes]:
    return [line.strip(BLANK) for line in (text or "").encode().lower().split(b"\n")]


def line_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h1, h2, n): documents in which each non-empty key is found."""

    def kernel():
        def step(texts):
            seen: Counter = Counter()
            for text in texts:
                seen.update({xxhash.xxh3_128_digest(k) for k in line_keys(text) if k})
            halves = np.frombuffer(b"".join(seen), ">i8").reshape(-1, 2)
            return {"h1": halves[:, 0].astype("i8"), "h2": halves[:, 1].astype("i8"), "n": np.fromiter(seen.values(), "i8", len(seen))}

        return step

    return common.map_batches(docs.select(text_col), kernel, [text_col], "h1 long, h2 long, n long", keep=False).groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def _slot(h2: np.ndarray, displacement: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Slot of each key in 0..n-1 under its bucket's displacement."""
    x = (h2 ^ (displacement.astype(np.uint64) * _M1)) * _M2
    return ((x ^ (x >> np.uint64(32))) * _M1 >> np.uint64(32)) % n.astype(np.uint64)


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Displacements for the keys of one shard: buckets of several keys look for free slots, largest first; those of one key take what is left."""
    n, buckets = len(pdf), len(pdf) // 4 + 1
    h1, h2 = pdf["h1"].to_numpy().view(np.uint64), pdf["h2"].to_numpy().view(np.uint64)
    bucket = (h1 % np.uint64(buckets)).astype(int)
    members: dict[int, list[int]] = {}
    for i, b in enumerate(bucket):
        members.setdefault(int(b), []).append(i)
    displacement, taken, place = np.zeros(buckets, "<i4"), np.zeros(n, bool), np.zeros(n, int)
    for b in sorted(members, key=lambda b: -len(members[b])):
        own = members[b]
        if len(own) == 1:
            break
        for start in range(1, 1 << 30, TRIALS):  # many displacements at a time; the first with free slots, all different, is taken
            slots = _slot(h2[own][None, :], np.arange(start, start + TRIALS)[:, None], np.array(n)).astype(int)
            in_order = np.sort(slots, axis=1)
            good = np.flatnonzero(~taken[slots].any(axis=1) & (in_order[:, 1:] != in_order[:, :-1]).all(axis=1))
            if len(good):
                break
        displacement[b], taken[slots[good[0]]], place[own] = start + good[0], True, slots[good[0]]
    free = iter(np.flatnonzero(~taken))
    for b, own in members.items():
        if len(own) == 1:
            place[own[0]] = slot = int(next(free))
            displacement[b] = -slot - 1
    prints, counts = np.empty(n, "<u8"), np.empty(n, "<u4")
    prints[place], counts[place] = h2, np.minimum(pdf["n"].to_numpy(), 2**32 - 1)
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n": [n], "displacement": [displacement.tobytes()], "prints": [prints.tobytes()], "counts": [counts.tobytes()]})


def line_index(docs: DataFrame, text_col: str = "text", least: int = 2) -> tuple[DataFrame, int]:
    """The index of lines found in at least `least` documents as a table (shard, n, displacement, prints, counts), and the number of its shard bits."""
    lines = common.materialize(line_counts(docs, text_col).filter(F.col("n") >= least), "line-counts")
    bits = max(0, (lines.count() // SHARD_KEYS).bit_length())
    shard = F.shiftrightunsigned("h1", 64 - bits).cast("int") if bits else F.lit(0)
    built = lines.withColumn("shard", shard).groupBy("shard").applyInPandas(build_shard, "shard int, n int, displacement binary, prints binary, counts binary")
    return common.materialize(built, "line-index"), bits


class Volume:
    """Some shards of the index, flattened, for probing by whole arrays."""

    def __init__(self, rows: list, bits: int):
        self.bits, self.size = bits, 1 << bits
        self.n, self.buckets, self.slot0, self.bucket0 = (np.zeros(self.size, np.int64) for _ in range(4))
        for r in rows:
            self.n[r["shard"]], self.buckets[r["shard"]] = r["n"], r["n"] // 4 + 1
        at = [r["shard"] for r in rows]
        self.slot0[at] = np.cumsum([0, *self.n[at]])[:-1]
        self.bucket0[at] = np.cumsum([0, *self.buckets[at]])[:-1]
        self.displacement = np.frombuffer(b"".join(r["displacement"] for r in rows), "<i4")
        self.prints = np.frombuffer(b"".join(r["prints"] for r in rows), "<u8")
        self.counts = np.frombuffer(b"".join(r["counts"] for r in rows), "<u4")

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Documents of each line, 0 for lines that this volume doesn't have."""
        out = np.zeros(len(h1), np.int64)
        shard = (h1 >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h1), np.int64)
        here = np.flatnonzero(self.n[shard] > 0)
        if not len(here):
            return out
        shard, h1, h2 = shard[here], h1[here], h2[here]
        moved = self.displacement[self.bucket0[shard] + (h1 % self.buckets[shard].astype(np.uint64)).astype(np.int64)].astype(np.int64)
        slot = np.where(moved < 0, -moved - 1, _slot(h2, np.maximum(moved, 0), self.n[shard]).astype(np.int64)) + self.slot0[shard]
        out[here] = np.where(self.prints[slot] == h2, self.counts[slot], 0)
        return out


def _hashes(keys: list[bytes]) -> np.ndarray:
    """Rows h1, h2."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)


def _cut(text: str | None, drop: np.ndarray) -> tuple[str, int, int]:
    """The text without the lines to drop, its lines, and how many go."""
    parts, n = (text or "").split("\n"), int(drop.sum())
    return "\n".join(x for x, y in zip(parts, drop.tolist()) if not y) if n else text or "", len(parts), n


def _rows(cut: list[tuple[str, int, int]]) -> dict[str, list]:
    return {"kept_text": [c[0] for c in cut], "n_lines": [c[1] for c in cut], "n_dropped": [c[2] for c in cut]}


RESULTS = "kept_text string, n_lines long, n_dropped long"


def _probed(rows: DataFrame, index: DataFrame, bits: int, min_docs: int) -> DataFrame:
    """Every document probes the index, which is broadcast."""
    volume = rows.sparkSession.sparkContext.broadcast((index.collect(), bits))

    def kernel():
        probe = Volume(*volume.value)

        def step(texts):
            keys = [line_keys(t) for t in texts]
            flat = [k for ks in keys for k in ks]
            halves = _hashes(flat)
            found = np.maximum(probe.count(halves[:, 0], halves[:, 1]), 1)
            drop = (found >= min_docs) & np.fromiter(map(bool, flat), bool, len(flat))
            ends = np.cumsum([len(k) for k in keys])
            return _rows([_cut(t, drop[e - len(k) : e]) for t, k, e in zip(texts, keys, ends)])

        return step

    return common.map_batches(rows, kernel, ["text"], RESULTS)


def _sent(rows: DataFrame, index: DataFrame, bits: int, min_docs: int) -> DataFrame:
    """Lines go to the shards of the index."""
    rows = rows.withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))

    def lines():
        def step(keys, texts):
            sets = [{k for k in line_keys(t) if k} for t in texts]
            halves = _hashes([k for s in sets for k in s]).view(np.int64)
            return {"key": [k for k, s in zip(keys, sets) for _ in s], "h1": halves[:, 0], "h2": halves[:, 1]}

        return step

    shard = F.shiftrightunsigned("h1", 64 - bits).cast("int") if bits else F.lit(0)
    sent = common.materialize(common.map_batches(rows.select("key", "text"), lines, ["key", "text"], "key binary, h1 long, h2 long", keep=False).distinct().withColumn("shard", shard), "line-sent")
    shares = common.materialize(sent.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_LINES).alias("shares")), "line-shares")
    dealt = common.lookup(sent, shares, ["shard"], "inner").withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares"))).drop("shares")
    copies = shares.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    copies = index.join(copies.toDF("shard", "share"), "shard")

    def probe(own: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        if not len(arrays) or not len(own):
            return own[["key", "h1", "h2"]].iloc[:0]
        row = arrays.iloc[0].to_dict() | {"shard": 0}
        found = Volume([row], 0).count(own["h1"].to_numpy().view(np.uint64), own["h2"].to_numpy().view(np.uint64))
        return own.loc[found >= min_docs, ["key", "h1", "h2"]]

    hits = dealt.groupBy("shard", "share").cogroup(copies.groupBy("shard", "share")).applyInPandas(probe, "key binary, h1 long, h2 long")
    # A text has no more hits than lines.
    found = common.materialize(hits.groupBy("key").agg(F.collect_list("h1").alias("h1s"), F.collect_list("h2").alias("h2s")), "line-hits")

    def cut():
        def step(texts, h1s, h2s):
            out = []
            for text, a, b in zip(texts, h1s, h2s):
                gone = set(zip(a or (), b or ()))
                keys = line_keys(text)
                halves = _hashes(keys).view(np.int64).tolist() if gone else ()
                out.append(_cut(text, np.array([bool(k) and tuple(h) in gone for k, h in zip(keys, halves)] if gone else [False] * len(keys), bool)))
            return _rows(out)

        return step

    lost = among(rows, found, "key").join(found, "key", "left")
    whole = without(rows, found, "key").withColumns({"h1s": F.lit(None).cast("array<bigint>"), "h2s": F.lit(None).cast("array<bigint>")})
    # Rows that only seem to be among the found ones have no partner; they are in `without` already.
    every = lost.filter("h1s is not null").unionByName(whole).drop("key")
    return common.map_batches(every, cut, ["text", "h1s", "h2s"], RESULTS).drop("h1s", "h2s")


def _dedup(docs: DataFrame, text_col: str, min_docs: int, volume_bytes: int) -> DataFrame:
    """(row, text, kept_text, n_lines, n_dropped)"""
    index, bits = line_index(docs, text_col, min(2, min_docs))
    size = index.agg(F.sum(F.length("displacement") + F.length("prints") + F.length("counts"))).first()[0] or 0
    rows = common.packed(docs, text_col).withColumnRenamed(text_col, "text")
    return (_probed if size <= volume_bytes else _sent)(rows, index, bits, min_docs)


def dedup_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, volume_bytes: int = VOLUME_BYTES) -> DataFrame:
    """docs with kept_text, n_lines (before dropping) and n_dropped; lines of keys found in at least min_docs documents are dropped."""
    out = _dedup(docs, text_col, min_docs, volume_bytes)
    return out.select(*common.unpacked(out, [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")], **{text_col: "text"}), "kept_text", "n_lines", "n_dropped")


def without_shared_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, volume_bytes: int = VOLUME_BYTES) -> DataFrame:
    """docs whose text has lost its lines of keys found in at least min_docs documents; n_chars, if docs has it, is the new length."""
    out = _dedup(docs, text_col, min_docs, volume_bytes).withColumn("chars", F.length("kept_text"))
    columns = common.unpacked(out, docs.columns, **{text_col: "kept_text"} | ({"n_chars": "chars"} if "n_chars" in docs.columns else {}))
    return out.select(*[c.cast(docs.schema[n].dataType).alias(n) if n == "n_chars" else c for n, c in zip(docs.columns, columns)])


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM split),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM common)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""
