"""SimHash near-dedup by a Gray-order hierarchical index.

A fingerprint has a bit for each position in which more than half of the text's shingle hashes, repeats counted, have theirs set. Equal fingerprints are one class.
Classes are sorted by the Gray rank of their fingerprint, the place at which a Gray code visits it, so that neighbours in this order share long masked bit patterns.
Consecutive classes are leaves of a block, blocks of FAN make a node, nodes of FAN a larger one, up to one root. A node holds the bits in which all its
fingerprints agree. A pair of nodes differs in at least the bits of their common mask that differ; going down, only bits that the masks of the parents left open are looked at and
added to what was found above (accumulated differences), and a pair beyond LIMIT takes all pairs below it away. Spark joins carry pairs of nodes down to pairs of
blocks; the same descent in a task carries these down to pairs of fingerprints. Of a pair of blocks only links that join something are given
out (a spanning forest), so a dense group costs no more rows than it has members.

How it grows: blocks have BLOCKS-th parts of all classes, within LEAST and MOST. A pair of blocks is met only if their patterns differ in up to LIMIT
bits: of 2 ** d blocks of spread fingerprints each meets about the sum of C(d, 0..LIMIT), not all. No side is broadcast but by Spark's own size check.

Defined results: null text is empty; a text without words has fingerprint zero and links like any other; with fewer words than a shingle its words are
one; rows of a null id take no part and have a null component; rows that repeat an id have its smallest component; an empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, graph

WORDS, LIMIT, SEED = 3, 3, 42
#: Blocks that classes are dealt to, within these numbers of classes for each block.
BLOCKS, LEAST, MOST = 64, 256, 1 << 16
#: Children of a node between blocks and root, and of a node inside of a block.
FAN, INNER = 16, 4
#: Pairs of nodes that a task expands at once.
CHUNK = 1 << 14


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits, the lowest first."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    flat, k = b" ".join(parts), min(words, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(parts) - k + 1].tolist()
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    h = np.fromiter((digest(flat[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64, n)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place at which a Gray code visits x: each bit is the parity of x's bits from there up."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def visited(rank: Column) -> Column:
    """The fingerprint of a Gray rank."""
    return rank.bitwiseXOR(F.shiftrightunsigned(rank, 1))


def fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fingerprint as a signed long, place): place is the Gray rank, moved so that signed order is its order."""

    def kernel():
        def step(texts):
            x = np.array([fingerprint(t, words) for t in texts], np.uint64)
            return {"fingerprint": x.view(np.int64), "place": (gray_rank(x) ^ np.uint64(1 << 63)).view(np.int64)}

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_batches(rows, kernel, ["text"], "fingerprint long, place long").drop("text")


def _levels(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """From leaves to root: for each node the bits that all below have, and those that any has."""
    levels = [(x, x)]
    while len(levels[-1][0]) > 1:
        at = np.arange(0, len(levels[-1][0]), INNER)
        levels.append((np.bitwise_and.reduceat(levels[-1][0], at), np.bitwise_or.reduceat(levels[-1][1], at)))
    return levels


def near(x: np.ndarray, y: np.ndarray, limit: int = LIMIT, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of fingerprints, both arrays in Gray order, that differ in up to limit bits; same: x is y, and a pair is given once."""
    one, two = _levels(x), _levels(y)
    top = max(len(one), len(two)) - 1
    one, two = (t + [t[-1]] * (top + 1 - len(t)) for t in (one, two))
    child = np.arange(INNER)
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint8), np.zeros(1, np.uint64))]
    if not top:
        stack = [(1, *stack[0][1:])]
        one, two = one * 2, two * 2
    while stack:
        k, i, j, differ, known = stack.pop()
        if not k:
            if same:
                i, j = i[i != j], j[i != j]
            yield i, j
            continue
        k -= 1
        shape = (len(i), INNER, INNER)
        i = np.broadcast_to((i[:, None] * INNER + child)[:, :, None], shape).ravel()
        j = np.broadcast_to((j[:, None] * INNER + child)[:, None, :], shape).ravel()
        ok = (i < len(one[k][0])) & (j < len(two[k][0]))
        if same:
            ok &= i <= j
        i, j, above = i[ok], j[ok], np.flatnonzero(ok) // INNER**2
        (a, b), (c, d) = (one[k][0][i], one[k][1][i]), (two[k][0][j], two[k][1][j])
        shared, known = ~(a ^ b) & ~(c ^ d), known[above]
        differ = differ[above] + np.bitwise_count((a ^ c) & shared & ~known)
        ok = differ <= limit
        i, j, differ, known = i[ok], j[ok], differ[ok], (known | shared)[ok]
        stack += [(k, i[at : at + CHUNK], j[at : at + CHUNK], differ[at : at + CHUNK], known[at : at + CHUNK]) for at in range(0, len(i), CHUNK)]


def spanning(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of the links that join trees of root, the label of each node, which is changed."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, low, high = i[apart], j[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        if not len(i):
            return
        high, first = np.unique(high, return_index=True)
        root[high] = low[first]
        yield i[first], j[first]
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _links(pairs: DataFrame, limit: int) -> DataFrame:
    """(a, b) fingerprints' places of rows (same, x, y), where x and y are a block's places in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip = np.uint64(1 << 63)

        def block(column, k):
            places = column[k].values.to_numpy(zero_copy_only=False)
            rank = places.view(np.uint64) ^ flip
            return places, rank ^ (rank >> np.uint64(1))

        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column(0)[k].as_py()
                (p, x), (q, y) = block(batch.column(1), k), block(batch.column(2), k)
                root, shift = np.arange(len(x) if same else len(x) + len(y)), 0 if same else len(x)
                for i, j in near(x, y, limit, same):
                    for a, b in spanning(root, i, j + shift):
                        yield pa.RecordBatch.from_arrays([pa.array(p[a]), pa.array(q[b - shift])], names=["a", "b"])

    return pairs.select("same", "x", "y").mapInArrow(run, "a long, b long")


def block_pairs(blocks: DataFrame, count: int, limit: int) -> DataFrame:
    """(a, b), a <= b: pairs of blocks (block, every, any) that may hold a link; every and any are the bits that all and any of a block's fingerprints have."""
    levels = [blocks.select(F.col("block").alias("id"), "every", "any")]
    while count > 1:
        count = -(-count // FAN)
        up = levels[-1].groupBy(F.floor(F.col("id") / FAN).alias("id")).agg(F.bit_and("every").alias("every"), F.bit_or("any").alias("any"))
        levels.append(common.materialize(up, "gray-nodes"))
    zero = F.lit(0).cast("long")
    pairs = levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).alias("differ"), zero.alias("known"))
    for nodes in reversed(levels[:-1]):
        below = lambda s: nodes.select(F.floor(F.col("id") / FAN).alias(s), F.col("id").alias(f"{s}_id"), F.col("every").alias(f"{s}_every"), F.col("any").alias(f"{s}_any"))  # noqa: B023, E731
        met = pairs.join(below("a"), "a").join(below("b"), "b").filter("a_id <= b_id")
        agree = lambda s: F.bitwise_not(F.col(f"{s}_every").bitwiseXOR(F.col(f"{s}_any")))
        met = met.withColumn("shared", agree("a").bitwiseAND(agree("b")))
        fresh = F.col("shared").bitwiseAND(F.bitwise_not("known"))
        met = met.withColumn("differ", F.col("differ") + F.bit_count(F.col("a_every").bitwiseXOR(F.col("b_every")).bitwiseAND(fresh)))
        pairs = met.filter(F.col("differ") <= limit).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "differ", F.col("known").bitwiseOR(F.col("shared")).alias("known"))
    return pairs.select("a", "b")


def simhash_groups(docs: DataFrame, words: int = WORDS, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, fingerprint, component): the signed 64-bit fingerprint, and the smallest id that links reach."""
    rows = common.materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    known = rows.filter("doc_id is not null")
    classes = known.groupBy("place").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    classes = common.numbered(classes, ["place"], "gray-order")
    count, total = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = max(least, min(MOST, -(-count // BLOCKS)))
    fingerprint_of = visited(F.col("place").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    blocks = classes.select(F.floor(F.col("_rank") / size).alias("block"), "place", fingerprint_of.alias("f")).groupBy("block")
    blocks = common.materialize(blocks.agg(F.bit_and("f").alias("every"), F.bit_or("f").alias("any"), F.array_sort(F.collect_list("place")).alias("places")), "gray-blocks")
    pairs = common.materialize(block_pairs(blocks, -(-count // size), limit), "gray-pairs")
    side = lambda s, name: blocks.select(F.col("block").alias(s), F.col("places").alias(name))
    met = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select((F.col("a") == F.col("b")).alias("same"), "x", "y")
    found = common.materialize(_links(met, limit), "gray-links")
    name = lambda s: classes.select(F.col("place").alias(s), F.col("id").alias(f"{s}_id"))
    ids = found.join(name("a"), "a").join(name("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    # A repeated id may be the smallest of two classes: it is one node then.
    reached = graph.components(ids)
    groups = classes.select("place", "id", "n").join(reached, F.col("id") == F.col("node"), "left")
    groups = common.materialize(groups.select("place", F.coalesce("component", "id").alias("component"), "n"), "gray-groups")
    out = common.skew_join(known, groups, ["place"], "n", total).select("doc_id", "fingerprint", "component")
    return out.unionByName(rows.filter("doc_id is null").select("doc_id", "fingerprint", F.lit(None).cast("long").alias("component")))


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
