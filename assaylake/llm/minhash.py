"""MinHash near-dedup by an LSH forest.

A document is the set of its word shingles. Documents of equal sets become one class, known by its smallest id. Each class has a MinHash signature and
a row in each of TREES sorted orders, by a sequence of signature labels of its own. Range-sorted, rows that share a long prefix are neighbours,
in any number of tasks, a region of copies too.

Two rounds find links. First the next neighbours in the first FIRST_TREES orders, if they share START labels; what the full sets confirm joins
classes to components. Then, in all orders, every two classes of a region that aren't in one component yet. A region is what shares START labels; if
its pairs across components are more than CROWD for each row, it is crowded: a row meets those of the CROWD next ones that share as many of its DEPTH labels as similar
classes do on average, which links most of what can be linked, and all members go through an exact similarity join (see exact_pairs), which finds what these pairs lack.
So a group of thousands of near copies costs a few pairs a member, linked with each other or not, and no member is left out by a cap.
Where a range border cuts a region its parts are put together: few rows outside its main component are compared with every row of the region (see across_borders);
if they are more, its members go through the exact join, too.

Every pair is confirmed on full sets, of 64-bit shingle hashes; the chance of two shingles of one pair being equal in these is below 1e-10. To this end classes
have homes of HOME members that are neighbours in the first order. A pair is checked at the home of its smaller id, where each set arrives once, however many
pairs need it; a home whose pairs need many other sets is dealt to parts, so that no group is large. A pair of similarity s is met in an order of START labels with probability s ** START: at 0.85 and 32 orders it is missed with less than 1e-12, at 0.80 with 6e-11.

Defined results: null text is empty; a document without words has an empty set, is linked with nothing and is kept; with fewer words than
a shingle its words are one shingle; rows of a null id take no part, are kept and have a null component; ids should be unique, rows that repeat one have its
component; an empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph
from .exact_dedup import among, without

WORDS, PERCENT = 5, 80
HASHES, TREES, FIRST_TREES, START, DEPTH = 128, 32, 4, 3, 16
#: Pairs across components for each row of a region, above which it is crowded.
CROWD = 4
#: Rows outside the largest component that a region has at most if it isn't crowded.
FEW = 2 * CROWD
#: Kinds of rows that a scan gives.
PAIRS, SPLIT, PART = 0, 1, 2
#: Counts of the sketch of shingles, the shift that gives a shingle's, and classes that meet at a shingle in one block.
SLOTS, SLOT_SHIFT, BLOCK = 1 << 20, np.uint64(44), 2000
#: Classes of a home, and other classes that are confirmed with a home's in one group at most. Groups of a quarter are aimed at, as they are dealt by hash and by an estimate.
HOME, GROUP = 128, 1024
_RANDOM = np.random.default_rng(20)
_A = _RANDOM.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32)
#: Signature positions of each order: the first START are no other order's.
ORDERS = np.array([np.r_[t * START : t * START + START, _RANDOM.permutation(np.r_[0 : t * START, t * START + START : HASHES])[: DEPTH - START]] for t in range(TREES)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, words: int):
        self.words = words

    def __call__(self, text: str | None) -> np.ndarray:
        parts = (text or "").encode().lower().split()
        if not parts:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
        k = min(self.words, len(h))
        x = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            x = _mix((x + np.uint64(0x9E3779B97F4A7C15)) ^ h[i : len(h) - k + 1 + i])
        x = np.sort(x)
        return x[np.r_[True, x[1:] != x[:-1]]]


def signature(shingles: np.ndarray) -> bytes:
    """HASHES labels of 16 bits, big-endian, of each hash function's least value over the shingles. Functions have 32 bits, which processors multiply several at a time."""
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    for at in range(0, len(x), 1024):
        np.minimum(least, (x[at : at + 1024] * _A + _B).min(axis=0), out=least)
    # The least values of large sets are small numbers: all their bits are mixed into the label.
    return ((least * np.uint32(0x9E3779B1) ^ least >> np.uint32(15)) >> np.uint32(16)).astype(">u2").tobytes()


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, set_hash, sig) of rows that have an id; set_hash and sig are null for empty sets."""

    def kernel():
        shingler = Shingler(words)

        def step(texts):
            sets = [shingler(t) for t in texts]
            return {
                "n_shingles": [len(s) for s in sets],
                "set_hash": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "sig": [signature(s) if len(s) else None for s in sets],
            }

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_batches(rows, kernel, ["text"], "n_shingles long, set_hash binary, sig binary").drop("text")


def forest(classes: DataFrame, trees: int) -> DataFrame:
    """A row (tree, labels, id, size, component, home) for each class and order, range-sorted."""

    def kernel():
        def step(ids, sizes, parts, homes, sigs):
            table = np.frombuffer(b"".join(sigs), ">u2").reshape(-1, HASHES)
            width = 2 * DEPTH
            out: dict[str, list] = {"tree": [], "labels": [], "id": [], "size": [], "component": [], "home": []}
            for t in range(trees):
                flat = table[:, ORDERS[t]].tobytes()
                out["tree"] += [t] * len(ids)
                out["labels"] += [flat[i : i + width] for i in range(0, len(flat), width)]
                out["id"] += ids
                out["size"] += sizes
                out["component"] += parts
                out["home"] += homes
            return out

        return step

    kind = "tree int, labels binary, id long, size long, component long, home long"
    rows = common.map_batches(classes, kernel, ["id", "size", "component", "home", "sig"], kind, keep=False)
    return rows.repartitionByRange("tree", "labels", "id").sortWithinPartitions("tree", "labels", "id")


def homes(classes: DataFrame) -> DataFrame:
    """(id, home): HOME neighbours in the first order have a home together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.arange(at, at + batch.num_rows) // HOME)], names=["id", "home"])
            at += batch.num_rows

    return forest(classes, 1).mapInArrow(run, "id long, home long")


def _like(sizes_a: np.ndarray, sizes_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return 100 * np.minimum(sizes_a, sizes_b) >= percent * np.maximum(sizes_a, sizes_b)


def _shared(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many labels rows share."""
    return (labels.view(np.uint16)[i] == labels.view(np.uint16)[j]).sum(axis=1)


def _crowded(component: np.ndarray) -> bool:
    """Whether a region of these rows has more pairs across components than are taken."""
    n, counts = len(component), np.unique(component, return_counts=True)[1].astype(np.int64)
    return (n * n - int((counts**2).sum())) // 2 > CROWD * n


def _region(labels: np.ndarray, component: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs across components within a region, whose rows are sorted by their labels: all of them, or those of each row and the CROWD next ones if it is crowded."""
    _, which, counts = np.unique(component, return_inverse=True, return_counts=True)
    if len(counts) == 1:
        return
    if _crowded(component):
        for lag in range(1, CROWD + 1):
            i = np.flatnonzero(which[lag:] != which[:-lag])
            yield i, i + lag
        return
    # Rows of the largest component meet all others, and these each other; so only rows that give pairs are walked.
    top = counts.argmax()
    main, rest = np.flatnonzero(which == top), np.flatnonzero(which != top)
    for k, i in enumerate(rest):
        later = rest[k + 1 :]
        j = np.r_[main, later[which[later] != which[i]]]
        yield np.minimum(i, j), np.maximum(i, j)


def _pack(rows: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Distinct rows home, a, b as homes and the packed pairs of each."""
    rows = np.unique(rows, axis=0)
    cuts = np.flatnonzero(np.diff(rows[:, 0])) + 1
    return rows[np.r_[0, cuts], 0], [part.tobytes() for part in np.split(np.ascontiguousarray(rows[:, 1:]), cuts)]


def _part(rows: tuple[np.ndarray, ...]) -> dict[str, object]:
    """What a task holds of a region that may go on in another: its largest component, and the rows outside of it if they are few; all rows if these are."""
    tree, labels, ids, sizes, component, home = rows
    values, counts = np.unique(component, return_counts=True)
    top, n = values[counts.argmax()], counts.max()
    kept = np.ones(len(ids), bool) if n <= FEW else component != top
    packed = np.stack([ids, sizes, component, home], axis=1)[kept].astype(np.int64).tobytes() if len(ids) - n <= FEW else None
    return {"tree": int(tree[0]), "region": labels[0, : 2 * START].tobytes(), "top": int(top), "n": int(n), "packed": packed}


def scan(classes: DataFrame, percent: int, first: bool) -> DataFrame:
    """Rows of a kind: PAIRS (home, packed) are pairs (a, b), a < b, to be confirmed at the home of a, as binaries of 64-bit ids, a pair may be in several;
    SPLIT (packed) are the ids of regions not all of whose pairs were taken; PART are the parts of regions at either end of a task."""
    schema = pa.schema([("kind", pa.int32()), ("home", pa.int64()), ("packed", pa.binary()), ("tree", pa.int32()), ("region", pa.binary()), ("top", pa.int64()), ("n", pa.int64())])

    def made(**columns) -> pa.RecordBatch:
        size = len(columns["packed"])
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * size), f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        out: list[np.ndarray] = []
        split: list[np.ndarray] = []
        ended = False

        def inside(labels: np.ndarray, ids: np.ndarray, component: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Pairs of the region from low to high; of a crowded one the likely links, as the exact join takes its members."""
            if crowded := _crowded(component[low:high]):
                split.append(ids[low:high])
            for i, j in _region(labels[low:high], component[low:high], START):
                i, j = i + low, j + low
                if crowded:
                    likely = _shared(labels, i, j) >= START + (DEPTH - START) * percent // 100
                    i, j = i[likely], j[likely]
                yield i, j

        def pairs_of(rows: tuple[np.ndarray, ...]) -> Iterator[np.ndarray]:
            """Arrays of columns home, a, b."""
            tree, labels, ids, sizes, component, home = rows
            start = np.any(labels[1:, : 2 * START] != labels[:-1, : 2 * START], axis=1) | (tree[1:] != tree[:-1])
            if first:
                i = np.flatnonzero(~start)
                found = iter([(i, i + 1)])
            else:
                cuts = np.flatnonzero(start) + 1
                found = (pair for low, high in zip(np.r_[0, cuts], np.r_[cuts, len(ids)]) if high - low > 1 for pair in inside(labels, ids, component, low, high))
            for i, j in found:
                ok = _like(sizes[i], sizes[j], percent) & (ids[i] != ids[j])
                if ok.any():
                    i, j = i[ok], j[ok]
                    less = ids[i] < ids[j]
                    yield np.stack([np.where(less, home[i], home[j]), np.where(less, ids[i], ids[j]), np.where(less, ids[j], ids[i])], axis=1)

        def flush(force: bool):
            if out and (force or sum(map(len, out)) > 50_000):
                at, packed = _pack(np.concatenate(out))
                out.clear()
                yield made(kind=[PAIRS] * len(at), home=at, packed=packed)
            if split and (force or sum(map(len, split)) > 50_000):
                packed = [np.unique(np.concatenate(split)).astype(np.int64).tobytes()]
                split.clear()
                yield made(kind=[SPLIT], packed=packed)

        def visit(rows):
            for pair in pairs_of(rows):
                out.append(pair)
                yield from flush(False)
            yield from flush(False)

        def end(rows):
            if not first:
                yield made(kind=[PART], **{k: [v] for k, v in _part(rows).items()})

        for batch in batches:
            if not batch.num_rows:
                continue
            labels = np.frombuffer(b"".join(batch.column("labels").to_pylist()), np.uint8).reshape(-1, 2 * DEPTH)
            rows = (batch.column("tree").to_numpy(), labels, *(batch.column(c).to_numpy() for c in ("id", "size", "component", "home")))
            same = lambda tree, labels, k: ~np.any(labels[:, : 2 * START] != labels[k, : 2 * START], axis=1) & (tree == tree[k])
            # The last region may go on in the next batch.
            if held and held[-1][0][-1] == rows[0][-1] and not np.any(held[-1][1][-1, : 2 * START] != labels[-1, : 2 * START]):
                held.append(rows)
                continue
            rows = tuple(np.concatenate(x) for x in zip(*held, rows))
            other = np.flatnonzero(~same(rows[0], rows[1], -1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                if not ended:
                    ended = True
                    after = np.flatnonzero(~same(rows[0], rows[1], 0))
                    yield from end(tuple(x[: int(after[0])] for x in rows))
                yield from visit(tuple(x[:cut] for x in rows))
            held = [tuple(x[cut:] for x in rows)]
        if held:
            rows = tuple(np.concatenate(x) for x in zip(*held))
            yield from end(rows)
            yield from visit(rows)
        yield from flush(True)

    return forest(classes, FIRST_TREES if first else TREES).mapInArrow(run, "kind int, home long, packed binary, tree int, region binary, top long, n long")


def across_borders(classes: DataFrame, percent: int, found: DataFrame) -> DataFrame:
    """Rows of kinds PAIRS and SPLIT for the regions that range borders cut. The driver gets at most two parts of 2 * FEW rows for each task.

    Rows outside of the region's largest component are compared with all rows, at the homes of the latter; if they aren't few, the region counts as split.
    """
    parts: dict[tuple[int, bytes], list] = {}
    every = F.collect_list(F.struct("top", "n", "packed"))
    for r in found.filter(F.col("kind") == PART).groupBy("tree", "region").agg(every.alias("parts")).filter("size(parts) > 1").collect():
        parts[r["tree"], bytes(r["region"])] = r["parts"]
    few: dict[int, dict[int, np.ndarray | None]] = {}
    for (tree, region), held in parts.items():
        sums = Counter()
        for p in held:
            sums[p["top"]] += p["n"]
        top = max(sums, key=lambda c: (sums[c], -c))
        whole = all(p["packed"] is not None and (p["top"] == top or p["n"] <= FEW) for p in held)
        rows = np.concatenate([np.frombuffer(p["packed"], np.int64).reshape(-1, 4) for p in held]) if whole else None
        rows = rows[rows[:, 2] != top] if whole else None
        if rows is None or len(rows):
            few.setdefault(tree, {})[int.from_bytes(region, "big")] = rows if whole and len(rows) <= FEW else None
    sent = classes.sparkSession.sparkContext.broadcast(few)

    def kernel():
        few = sent.value
        places = np.uint64(65536) ** np.arange(START - 1, -1, -1, dtype=np.uint64)

        def step(ids, sizes, parts, homes, sigs):
            table = np.frombuffer(b"".join(sigs), ">u2").reshape(-1, HASHES)
            ids, sizes, parts, homes = (np.array(x, np.int64) for x in (ids, sizes, parts, homes))
            pairs, split = [], []
            for tree, regions in few.items():
                codes = (table[:, ORDERS[tree][:START]].astype(np.uint64) * places).sum(axis=1)
                inside = np.flatnonzero(np.isin(codes, np.array(list(regions), np.uint64)))
                for code in np.unique(codes[inside]):
                    at, rows = inside[codes[inside] == code], regions[int(code)]
                    if rows is None:
                        split.append(ids[at])
                        continue
                    i, j = np.repeat(at, len(rows)), np.tile(np.arange(len(rows)), len(at))
                    ok = (parts[i] != rows[j, 2]) & (ids[i] != rows[j, 0]) & _like(sizes[i], rows[j, 1], percent)
                    i, other = i[ok], rows[j[ok], 0]
                    pairs.append(np.stack([homes[i], np.minimum(ids[i], other), np.maximum(ids[i], other)], axis=1))
            pairs = np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int64)
            at, packed = _pack(pairs) if len(pairs) else ([], [])
            more = [np.unique(np.concatenate(split)).tobytes()] if split else []
            return {"kind": [PAIRS] * len(at) + [SPLIT] * len(more), "home": [*map(int, at)] + [None] * len(more), "packed": packed + more}

        return step

    kind = "kind int, home long, packed binary"
    return common.map_batches(classes if few else classes.limit(0), kernel, ["id", "size", "component", "home", "sig"], kind, keep=False)


def by_home(found: DataFrame, name: str) -> DataFrame:
    """(home, part, packed): the pairs of each home, those of a home with many others dealt to parts by their larger id, the other. So a group has the sets of its home and GROUP others at most,
    and a home's own sets go to one group for some GROUP / 4 others, however many pairs they have with them."""
    rows = found.filter(F.col("kind") == PAIRS).select("home", "packed")
    many = rows.groupBy("home").agg(F.sum(F.length("packed")).alias("bytes")).filter(F.col("bytes") > 16 * GROUP).select("home")
    counted = max(1, GROUP // 64)

    def others():
        def step(homes, packed):
            ids = [np.unique(np.frombuffer(p, np.int64)[1::2]) for p in packed]
            ids = [x[_mix(x.astype(np.uint64)) % np.uint64(counted) == 0] for x in ids]
            return {"at": np.repeat(np.array(homes, np.int64), [len(x) for x in ids]), "other": np.concatenate([np.zeros(0, np.int64), *ids])}

        return step

    # The number of a home's others is estimated from one of so many, by hash.
    some = common.map_batches(common.lookup(rows, common.materialize(many, f"{name}-many"), ["home"], "left_semi"), others, ["home", "packed"], "at long, other long", keep=False)
    full = some.groupBy(F.col("at").alias("home")).agg(F.ceil(F.count_distinct("other") * (4 * counted) / GROUP).alias("parts")).filter("parts > 1")
    full = common.materialize(full, f"{name}-full")
    told = common.lookup(rows, full, ["home"])

    def deal():
        def step(homes, packed, parts):
            out: dict[str, list] = {"at": [], "part": [], "pairs": []}
            for home, p, n in zip(homes, packed, parts):
                pairs = np.frombuffer(p, np.int64).reshape(-1, 2)
                part = (_mix(pairs[:, 1].astype(np.uint64)) % np.uint64(n)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    out["at"].append(home)
                    out["part"].append(int(part[own[0]]))
                    out["pairs"].append(pairs[own].tobytes())
            return out

        return step

    dealt = common.map_batches(told.filter("parts is not null"), deal, ["home", "packed", "parts"], "at long, part long, pairs binary", keep=False).select(F.col("at").alias("home"), "part", F.col("pairs").alias("packed"))
    whole = told.filter("parts is null").select("home", F.lit(0).cast("long").alias("part"), "packed")
    return common.materialize(whole.unionByName(dealt).groupBy("home", "part").agg(F.collect_list("packed").alias("packed")), name)


def second_round(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(home, packed) of all orders, and the ids of classes left to the exact join."""
    found = common.materialize(scan(classes, percent, first=False), "minhash-found")
    cut = common.materialize(across_borders(classes, percent, found), "minhash-cut")
    found = found.select("kind", "home", "packed").unionByName(cut)
    ids = lambda: lambda packed: {"id": np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(p, np.int64) for p in packed)])}
    split = common.map_batches(found.filter(F.col("kind") == SPLIT).select("packed"), ids, ["packed"], "id long", keep=False).distinct()
    return by_home(found, "minhash-pairs"), common.materialize(split, "minhash-split")


def _ordered(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By how many classes have them, as the sketch has it, the rarest first."""
    return shingles[np.lexsort((shingles, counts[shingles >> SLOT_SHIFT]))]


def least_common(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that sets of these sizes share at least if they are similar enough."""
    return -(-percent * (a + b) // (100 + percent))


def exact_pairs(docs: DataFrame, classes: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(home, packed) of all pairs of the classes (id, component, home), across components, that can be similar enough.

    Sets that share c shingles share one of the first size - c + 1 of each, in any order of all shingles. So classes meet at the rarest shingles, by an order that
    a sketch of SLOTS counts gives, and only where the rest of both sets is long enough. A shingle with more than BLOCK classes is dealt to blocks, and these meet in twos;
    those of its largest component don't meet each other.
    """
    rows = among(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), classes.select(F.col("id").alias("doc_id")), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(words), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(counts, (shingler(text.as_py()) >> SLOT_SHIFT).astype(np.int64), 1)
        pieces = counts.reshape(-1, 4096)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["at", "counts"])

    def add(pieces: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": pieces["at"].iloc[:1], "counts": [sum(np.frombuffer(p, np.int64) for p in pieces["counts"]).tobytes()]})

    counted = rows.mapInArrow(count, "at int, counts binary").groupBy("at").applyInPandas(add, "at int, counts binary").orderBy("at").collect()
    sketch = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in counted)])
    sent = docs.sparkSession.sparkContext.broadcast(np.minimum(sketch, np.iinfo(np.int32).max).astype(np.int32))

    def prefixes():
        shingler, counts = Shingler(words), sent.value

        def step(ids, components, homes, texts):
            out = [(i, c, h, len(s), _ordered(s, counts)[: len(s) - -(-percent * len(s) // 100) + 1]) for i, c, h, t in zip(ids, components, homes, texts) if len(s := shingler(t))]
            lengths = [len(o[4]) for o in out]
            token = np.concatenate([np.zeros(0, np.uint64), *(o[4] for o in out)])
            shared = counts[token >> SLOT_SHIFT] > 1
            columns = {n: np.repeat(np.array([o[k] for o in out], np.int64), lengths) for k, n in enumerate(("id", "component", "home", "size"))}
            columns |= {"token": token.view(np.int64), "place": np.concatenate([np.zeros(0, np.int64), *map(np.arange, lengths)])}
            return {k: v[shared] for k, v in columns.items()}

        return step

    # The filter lets a few others pass: only the classes themselves are read for prefixes.
    members = rows.join(classes.select(F.col("id").alias("doc_id"), "component", "home"), "doc_id")
    kind = "token long, id long, size long, place long, component long, home long"
    found = common.materialize(common.map_batches(members, prefixes, ["doc_id", "component", "home", "text"], kind, keep=False), "minhash-prefixes")
    parts = found.groupBy("token", "component").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("n"), F.max_by("component", F.struct("n", "component")).alias("top"), F.max("n").alias("top_n"))
    # At most 1 / BLOCK of the rows.
    hot = common.materialize(parts.filter(F.col("n") > BLOCK).select("token", "top", F.ceil(F.col("top_n") / BLOCK).alias("tops"), F.ceil((F.col("n") - F.col("top_n")) / BLOCK).alias("others")), "minhash-hot")
    dealt = common.lookup(found, hot, ["token"])
    at = F.xxhash64("id")
    is_top = F.col("component") == F.col("top")
    block = F.when(F.col("tops").isNull(), F.lit(0)).when(is_top, F.pmod(at, F.col("tops"))).otherwise(F.col("tops") + F.pmod(at, F.col("others")))
    dealt = dealt.withColumn("block", block.cast("long"))
    upto = lambda low, n: F.when(n > 0, F.sequence(low, low + n - 1)).otherwise(F.array().cast("array<bigint>"))
    meets = F.when(F.col("tops").isNull(), F.array(F.lit(0).cast("long"))).when(is_top, upto(F.col("tops"), F.col("others"))).otherwise(upto(F.lit(0).cast("long"), F.col("tops") + F.col("others")))
    dealt = dealt.withColumn("other", F.explode(meets)).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    columns = ["token", "low", "high", "block", "id", "size", "place", "component", "home"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        out: list[np.ndarray] = []

        def pairs(x: np.ndarray) -> Iterator[np.ndarray]:
            cuts = np.flatnonzero(np.any(x[1:, :3] != x[:-1, :3], axis=1)) + 1
            ends = np.repeat(np.r_[cuts, len(x)], np.diff(np.r_[0, cuts, len(x)]))
            i, lag = np.arange(len(x)), 1
            while len(i := i[i + lag < ends[i]]):
                a, b = x[i], x[i + lag]
                lag += 1
                most = least_common(a[:, 5], b[:, 5], percent)
                ok = (a[:, 7] != b[:, 7]) & ((a[:, 1] == a[:, 2]) | (a[:, 3] != b[:, 3])) & (a[:, 4] != b[:, 4])
                ok &= (a[:, 5] - a[:, 6] >= most) & (b[:, 5] - b[:, 6] >= most) & _like(a[:, 5], b[:, 5], percent)
                if ok.any():
                    a, b = a[ok], b[ok]
                    less = a[:, 4] < b[:, 4]
                    yield np.stack([np.where(less, a[:, 8], b[:, 8]), np.minimum(a[:, 4], b[:, 4]), np.maximum(a[:, 4], b[:, 4])], axis=1)

        def flush(force: bool):
            if out and (force or sum(map(len, out)) > 50_000):
                at, packed = _pack(np.concatenate(out))
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array([PAIRS] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(packed, pa.binary())], names=["kind", "home", "packed"])

        def visit(x):
            for found in pairs(x):
                out.append(found)
                yield from flush(False)

        for batch in batches:
            if batch.num_rows:
                waiting.append(np.stack([batch.column(c).to_numpy() for c in columns], axis=1))
            if sum(map(len, waiting)) > 50_000:
                x = np.concatenate(waiting)
                # The last shingle may go on in the next batch.
                other = np.flatnonzero(np.any(x[:, :3] != x[-1, :3], axis=1))
                cut = int(other[-1]) + 1 if len(other) else 0
                yield from visit(x[:cut]) if cut else ()
                waiting = [x[cut:]]
        if waiting:
            yield from visit(np.concatenate(waiting))
        yield from flush(True)

    key = ["token", "low", "high"]
    met = dealt.select(*columns).repartition(*key).sortWithinPartitions(*key).mapInArrow(meet, "kind int, home long, packed binary")
    return by_home(common.materialize(met, "minhash-met"), "minhash-exact")


def unpack(packed: list[bytes]) -> np.ndarray:
    """The distinct pairs, as rows a, b."""
    return np.unique(np.frombuffer(b"".join(packed), np.int64).reshape(-1, 2), axis=0)


def confirm(docs: DataFrame, pairs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The candidates (a, b) whose full sets are similar enough. Texts of other documents, told by a bit filter of bounded size, aren't moved."""

    def visit():
        def step(homes, parts, packed):
            ids = [np.unique(unpack(p)) for p in packed]
            times = [len(i) for i in ids]
            return {"at": np.repeat(np.array(homes, np.int64), times), "group": np.repeat(np.array(parts, np.int64), times), "doc_id": np.concatenate([np.zeros(0, np.int64), *ids])}

        return step

    there = common.materialize(common.map_batches(pairs, visit, ["home", "part", "packed"], "at long, group long, doc_id long", keep=False), "minhash-visits")
    needed = common.materialize(there.select("doc_id").distinct(), "minhash-needed")
    rows = among(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), needed, "doc_id")

    def shingle():
        shingler = Shingler(words)
        return lambda texts: {"set": [shingler(t).tobytes() for t in texts]}

    sets = common.map_batches(rows, shingle, ["text"], "set binary").drop("text")
    visits = there.join(sets, "doc_id")

    def compare(visitors: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        known = {i: np.frombuffer(x, np.uint64) for i, x in zip(visitors["doc_id"], visitors["set"])}
        links = []
        for a, b in unpack(list(wanted["packed"].iloc[0])) if len(wanted) else ():
            x, y = known.get(a), known.get(b)
            if x is not None and y is not None:
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    links.append((a, b))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return visits.groupBy("at", "group").cogroup(pairs.groupBy("home", "part")).applyInPandas(compare, "a long, b long")


def near_dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_shingles, component_id (smallest id reachable), kept (id = component_id), class_size (rows of equal sets)."""
    sigs = common.materialize(signatures(docs, words, id_col, text_col), "minhash-signatures")
    usable = sigs.filter("set_hash is not null and doc_id is not null")
    # Rows of a class have equal signatures and sizes: any will do.
    classes = usable.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.any_value("sig").alias("sig"), F.any_value("n_shingles").alias("size"), F.count("*").alias("class_size"))
    classes = common.materialize(classes, "minhash-classes")
    alone = classes.select("id", "size", F.col("id").alias("component"), F.lit(0).cast("long").alias("home"), "sig")
    alone = alone.drop("home").join(common.materialize(homes(alone), "minhash-homes"), "id")
    pairs = by_home(common.materialize(scan(alone, percent, first=True), "minhash-found"), "minhash-pairs")
    links = common.materialize(confirm(docs, pairs, words, percent, id_col, text_col), "minhash-links")
    parts = common.materialize(graph.components(links), "minhash-components")
    of = lambda parts: alone.drop("component").join(parts, F.col("id") == F.col("node"), "left").select("id", "size", F.coalesce("component", "id").alias("component"), "home", "sig")
    pairs, split = second_round(of(parts), percent)
    links = confirm(docs, pairs, words, percent, id_col, text_col)
    parts = graph.components(parts.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(links))
    if not split.isEmpty():
        parts = common.materialize(parts, "minhash-components")
        pairs = exact_pairs(docs, common.materialize(of(parts).drop("sig").join(split, "id", "left_semi"), "minhash-crowd"), words, percent, id_col, text_col)
        links = confirm(docs, pairs, words, percent, id_col, text_col)
        parts = graph.components(parts.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(links))
    named = classes.select("set_hash", "id", "class_size").join(parts, F.col("id") == F.col("node"), "left")
    named = common.materialize(named.select("set_hash", F.coalesce("component", "id").alias("component_id"), "class_size"), "minhash-named")
    rows = usable.select("doc_id", "n_shingles", "set_hash")
    out = common.skew_join(rows, named, ["set_hash"], "class_size", sigs.count()).select("doc_id", "n_shingles", "component_id", "class_size")
    rest = sigs.filter("set_hash is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size"))
    return out.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "n_shingles", "component_id", "kept", "class_size")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the ids that near_dedup doesn't keep; rows of a null id stay. Texts that stay move only if a filter can't tell them apart."""
    dropped = common.materialize(near_dedup(docs, words, percent, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias(id_col)), "minhash-dropped")
    return without(docs, dropped, id_col)


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)
