"""Nearest-neighbour scoring.

A bank of up to BANK_VALUES numbers, counted, is broadcast and searched where the queries are, so no query moves. It is cut into clusters around pivots: by the triangle inequality on
angles no vector of a cluster is nearer to a query than the pivot's angle less the cluster's radius, so clusters that can't hold a nearer one are left out. The result is exact.

A larger bank is met in blocks. Queries and banks are dealt by hash to blocks of a bounded number of vectors within their category; every query block meets every bank block of its category,
one matrix product each, and the least distances are combined. SHARE query blocks meet a bank block in one place, so a category is spread over as many tasks as it has such
shares and bank blocks, and no task holds more than two blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Vectors of a block, and query blocks that meet a bank block in one place.
BLOCK, SHARE = 1024, 8
#: Numbers of a bank that is broadcast, 8 bytes each, and what an angle may be off by.
BANK_VALUES, SLACK = 1 << 22, 1e-6
#: References of an artifact, which are broadcast.
MAX_REFERENCES = 4096


def _blocks(rows: DataFrame, by: str, key: str, vector: str, size: int, prefix: str) -> DataFrame:
    """(by, <prefix>_block, <prefix>_keys, <prefix>_vectors): about size rows in each block, which are numbered from 0."""
    n = rows.groupBy(by).agg(F.ceil(F.count("*") / size).alias("_blocks"))
    dealt = rows.join(n, by).withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")))
    packed = dealt.groupBy(by, "_block").agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vector).alias("v"))).alias("p"))
    return packed.select(by, F.col("_block").alias(f"{prefix}_block"), F.transform("p", lambda x: x["k"]).alias(f"{prefix}_keys"), F.flatten(F.transform("p", lambda x: F.transform(x["v"], lambda y: y.cast("double")))).alias(f"{prefix}_vectors"))


def unit_rows(flat: np.ndarray, count: int) -> np.ndarray:
    """Rows at unit length; no rows, ragged rows, non-finite values and zero norms are errors."""
    if not count or not len(flat) or len(flat) % count:
        raise ValueError("feature matrix is empty or ragged")
    rows = flat.reshape(count, -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    if not np.isfinite(rows).all() or (norms <= 1e-12).any():
        raise ValueError("feature matrix has non-finite values or a zero norm")
    return rows / norms


class Clusters:
    """The vectors of one category's bank around pivots. products: how many pairs of vectors were multiplied so far."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray):
        order = np.argsort(keys, kind="stable")
        keys, units = keys[order], unit_rows(vectors.reshape(-1), len(keys))[order]
        self.pivots = units[np.unique(np.linspace(0, len(units) - 1, max(1, int(len(units) ** 0.5))).astype(int))]
        angles = np.arccos(np.clip(units @ self.pivots.T, -1.0, 1.0))
        own = angles.argmin(axis=1)
        used = np.unique(own)
        self.pivots, self.products = self.pivots[used], 0
        self.keys, self.units = [keys[own == c] for c in used], [units[own == c] for c in used]
        self.radius = np.array([angles[own == c, c].max() for c in used])

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance, key) for each of the queries, rows of unit length; the smallest key among equals."""
        angles = np.arccos(np.clip(queries @ self.pivots.T, -1.0, 1.0))
        self.products += angles.size
        distance, key = np.full(len(queries), np.inf), np.empty(len(queries), self.keys[0].dtype)
        bound = angles - self.radius - SLACK
        first = angles.argmin(axis=1)

        def visit(rows: np.ndarray, c: int) -> None:
            d = np.clip(1.0 - queries[rows] @ self.units[c].T, 0.0, 2.0)
            self.products += d.size
            at = d.argmin(axis=1)
            least, least_key = d[np.arange(len(rows)), at], self.keys[c][at]
            better = (least < distance[rows]) | (least == distance[rows]) & (least_key < key[rows])
            distance[rows[better]], key[rows[better]] = least[better], least_key[better]

        for c in np.unique(first):
            visit(np.flatnonzero(first == c), c)
        for c in np.argsort(bound.min(axis=0)):
            rows = np.flatnonzero((first != c) & (bound[:, c] <= np.arccos(np.clip(1.0 - distance, -1.0, 1.0))))
            if len(rows):
                visit(rows, c)
        return distance, key


def _nearest_here(queries: DataFrame, bank: DataFrame, by: str, key: str, vector: str) -> DataFrame:
    held = bank.select(by, F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v")).toArrow()
    groups: dict[object, list[int]] = {}
    for i, name in enumerate(held.column(by).to_pylist()):
        groups.setdefault(name, []).append(i)
    rows = {name: held.take(pa.array(at)) for name, at in groups.items()}
    sent = bank.sparkSession.sparkContext.broadcast({name: (r.column("k").to_numpy(), r.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)) for name, r in rows.items()})
    kinds = queries.schema[by].dataType.simpleString(), queries.schema[key].dataType.simpleString(), bank.schema[key].dataType.simpleString()
    out_kind = to_arrow_type(bank.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[object, Clusters] = {}
        for batch in batches:
            for name in batch.column(0).unique().to_pylist():
                if name not in sent.value:
                    continue
                if name not in known:
                    keys, flat = sent.value[name]
                    known[name] = Clusters(keys, flat)
                own = batch.filter(pa.compute.equal(batch.column(0), name))
                distance, found = known[name].nearest(unit_rows(own.column(2).flatten().to_numpy(zero_copy_only=False).astype(float), own.num_rows))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(distance), pa.array(found, out_kind)], names=[by, key, "distance", "nearest"])

    return queries.select(by, key, vector).mapInArrow(run, f"`{by}` {kinds[0]}, `{key}` {kinds[1]}, distance double, nearest {kinds[2]}")


def nearest(queries: DataFrame, bank: DataFrame, by: str, key: str, vector: str, block: int = BLOCK, values: int = BANK_VALUES) -> DataFrame:
    """(by, key, distance, nearest): cosine distance to the nearest bank vector of the category and its key, the smallest among equals.

    Keys are numbers. Categories without a bank, null ones too, give no rows. values: numbers of a bank that may be broadcast.
    """
    if block < 1:
        raise ValueError("block must be positive")
    if (bank.agg(F.sum(F.size(vector))).first()[0] or 0) <= values:
        return _nearest_here(queries, bank, by, key, vector)
    kind, bank_kind = queries.schema[key].dataType.simpleString(), bank.schema[key].dataType.simpleString()
    q, b = _blocks(queries, by, key, vector, block, "q"), _blocks(bank, by, key, vector, block, "b")
    shares = queries.groupBy(by).agg(F.ceil(F.ceil(F.count("*") / block) / SHARE).alias("_shares"))
    blocks = bank.groupBy(by).agg(F.ceil(F.count("*") / block).alias("_blocks"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = q.withColumn("_share", F.floor(F.col("q_block") / SHARE)).join(blocks, by).withColumn("_at", upto("_blocks")).drop("_blocks", "q_block")
    b = b.join(shares, by).withColumn("_share", upto("_shares")).withColumnRenamed("b_block", "_at").drop("_shares")
    pairs = q.join(b, [by, "_share", "_at"]).drop("_share", "_at")
    group = queries.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                q_keys, b_keys = (at[f"{s}_keys"][i].values.to_numpy(zero_copy_only=False) for s in "qb")
                q, b = (unit_rows(at[f"{s}_vectors"][i].values.to_numpy(), len(k)) for s, k in (("q", q_keys), ("b", b_keys)))
                order = np.argsort(b_keys, kind="stable")
                distances = np.clip(1.0 - q @ b[order].T, 0.0, 2.0)
                least = distances.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at[by][i].as_py()] * len(q_keys), type=batch.schema.field(by).type), pa.array(q_keys), pa.array(distances[np.arange(len(q_keys)), least]), pa.array(b_keys[order][least])],
                    names=[by, key, "distance", "nearest"],
                )

    met = pairs.mapInArrow(run, f"`{by}` {group}, `{key}` {kind}, distance double, nearest {bank_kind}")
    best = met.groupBy(by, key).agg(F.min(F.struct("distance", "nearest")).alias("m"))
    return best.select(by, key, "m.distance", "m.nearest")


def patch_rows(cases: DataFrame, by: str, case: str, patches: str) -> DataFrame:
    """(by, case, patch, key, vector) of an array of patch vectors; key is case * patches + index."""
    rows = cases.select(by, case, F.size(patches).alias("_n"), F.posexplode(patches).alias("patch", "vector"))
    return rows.select(by, case, "patch", (F.col(case) * F.col("_n") + F.col("patch")).alias("key"), "vector")


def patch_scores(queries: DataFrame, bank: DataFrame, by: str, case: str, top_k: int, block: int = BLOCK) -> DataFrame:
    """(by, case, score, max_patch_distance, mean_patch_distance) of rows as patch_rows gives them; score is the mean of the top_k largest distances."""
    if top_k < 1:
        raise ValueError("top_k must be positive")
    near = nearest(queries, bank, by, "key", "vector", block).join(queries.select("key", case, "patch").withColumnRenamed(by, by), "key")
    grids = near.groupBy(by, case).agg(F.sort_array(F.collect_list("distance"), asc=False).alias("d"))  # a case has a fixed number of patches
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    checked = F.when(F.size("d") < top_k, F.raise_error(F.lit("TOP_K_INVALID"))).otherwise(total(F.slice("d", 1, top_k)) / top_k)
    return grids.select(by, case, checked.alias("score"), F.get("d", F.lit(0)).alias("max_patch_distance"), (total(F.col("d")) / F.size("d")).alias("mean_patch_distance"))


def distances_to_references(rows: DataFrame, references: DataFrame, case: str, vector: str, reference: str) -> DataFrame:
    """(case, nearest_id, nearest_distance, mean, most) of cosine distances to all references, at most MAX_REFERENCES vectors that are broadcast; the smallest id among equals."""
    known = references.select(reference, vector).orderBy(reference).limit(MAX_REFERENCES + 1).collect()
    if len(known) > MAX_REFERENCES:
        raise ValueError(f"an artifact has at most {MAX_REFERENCES} references")
    ids = [r[0] for r in known]
    sent = rows.sparkSession.sparkContext.broadcast((ids, unit_rows(np.array([r[1] for r in known], float).ravel(), len(known)) if known else None))
    kinds = rows.schema[case].dataType.simpleString(), references.schema[reference].dataType.simpleString()
    arrow = to_arrow_type(references.schema[reference].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bank = sent.value
        for batch in batches:
            if not batch.num_rows or bank is None:
                continue
            column = batch.column(1)
            distances = np.clip(1.0 - unit_rows(column.flatten().to_numpy(zero_copy_only=False).astype(float), batch.num_rows) @ bank.T, 0.0, 2.0)
            least = distances.argmin(axis=1)
            found = [pa.array([ids[i] for i in least], type=arrow), pa.array(distances.min(axis=1)), pa.array(distances.mean(axis=1)), pa.array(distances.max(axis=1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=[case, "nearest_id", "nearest_distance", "mean", "most"])

    return rows.select(case, vector).mapInArrow(run, f"`{case}` {kinds[0]}, nearest_id {kinds[1]}, nearest_distance double, mean double, most double")


def summarised(found: DataFrame, case: str, nearest_only: bool = False) -> DataFrame:
    """(case, nearest_id, nearest_distance, global_distance, uncertainty) of what distances_to_references gives."""
    spread = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("most") - F.col("nearest_distance")))
    return found.select(case, "nearest_id", "nearest_distance", (F.col("nearest_distance") if nearest_only else F.col("mean")).alias("global_distance"), spread.alias("uncertainty"))


def mean_vectors(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, mean): element-wise mean, by position so that it is combined ahead of the shuffle; unequal dimensions are an error."""
    cells = rows.select(by, F.size(vector).alias("n"), F.posexplode(vector).alias("i", "x"))
    means = cells.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.min("n").alias("low"), F.max("n").alias("high"))
    out = means.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"), F.min("low").alias("low"), F.max("high").alias("high"))
    return out.select(by, F.when(F.col("low") != F.col("high"), F.raise_error(F.lit("EMBEDDING_DIMENSION_MISMATCH"))).otherwise(F.transform("v", lambda s: s["x"])).alias("mean"))
