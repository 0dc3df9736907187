"""Partitioning cases into roles, excluding history, and proofs of coverage and disjointness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import hash_rank, running_totals

#: Variants of a frozen list.
MAX_VARIANTS = 1000


def roles_by_share(cases: DataFrame, by: Sequence[str], rank_hex: str, ties: Sequence[str], shares: Mapping[str, int], of: int = 10) -> DataFrame:
    """cases with role: consecutive shares of each group in hash order, in parts of `of`."""
    n = cases.groupBy(*by).agg(F.count("*").alias("_n"))
    ranked = hash_rank(cases, by, rank_hex, ties).join(n, list(by))
    role = F.lit(None).cast("string")
    for name, upto in reversed(list(zip(shares, accumulate(shares.values())))):
        role = F.when(F.col("rank") * of < F.col("_n") * upto, name).otherwise(role)
    return ranked.withColumn("role", role).drop("_n")


def roles_by_rank(cases: DataFrame, by: Sequence[str], rank_hex: str, ties: Sequence[str], counts: Mapping[str, int]) -> DataFrame:
    """cases with role: the first counts of each group in hash order, in turn; the rest have none."""
    role = F.lit(None).cast("string")
    for name, upto in reversed(list(zip(counts, accumulate(counts.values())))):
        role = F.when(F.col("rank") < upto, name).otherwise(role)
    return hash_rank(cases, by, rank_hex, ties).withColumn("role", role)


def allocate_by_quota(groups: DataFrame, quotas: DataFrame, by: str, rank_hex: str, group_id: str) -> DataFrame:
    """groups with partition: each takes the partition whose range of ranks holds it.

    quotas has one row for each by and partition: (by, partition, position, quota). Groups beyond all quotas have a null partition, which
    unmet_quotas reports.
    """
    upto = F.expr("aggregate(filter(all, x -> x.position <= q.position), 0L, (s, x) -> s + x.quota)")
    ranges = quotas.groupBy(by).agg(F.collect_list(F.struct("position", "partition", "quota")).alias("all"))
    ranges = ranges.select(by, "all", F.explode("all").alias("q")).select(by, F.col("q.partition").alias("partition"), upto.alias("_end"), (upto - F.col("q.quota")).alias("_start"))
    ranked = hash_rank(groups, [by], rank_hex, [group_id])
    # A few ranges for each category: their number is that of partitions, so this doesn't fan out.
    spans = ranges.groupBy(by).agg(F.collect_list(F.struct("_start", "_end", "partition")).alias("_spans"))
    held = F.expr("filter(_spans, s -> rank >= s._start AND rank < s._end)")
    return ranked.join(spans, by, "left").withColumn("partition", F.get(held, F.lit(0))["partition"]).drop("_spans")


def unmet_quotas(allocated: DataFrame, quotas: DataFrame, by: str) -> DataFrame:
    """(by, groups, quota) of categories whose quotas don't consume every group exactly; no rows if all do."""
    have = allocated.groupBy(by).agg(F.count("*").alias("groups"))
    want = quotas.groupBy(by).agg(F.sum("quota").alias("quota"))
    both = have.join(want, by, "full_outer").select(by, F.coalesce("groups", F.lit(0)).alias("groups"), F.coalesce("quota", F.lit(0)).alias("quota"))
    return both.filter("groups <> quota")


def touched_groups(rows: DataFrame, ledger: DataFrame, group: str, digest: str) -> DataFrame:
    """Groups (group) of which any member's digest is in the ledger."""
    return rows.select(group, digest).join(ledger.select(digest), digest, "left_semi").select(group).distinct()


def exclude_history(rows: DataFrame, ledger: DataFrame, group: str, digest: str) -> DataFrame:
    """rows without whole groups of which any member's digest is in the ledger."""
    return rows.join(touched_groups(rows, ledger, group, digest), group, "left_anti")


def history_counts(rows: DataFrame, ledger: DataFrame, group: str, digest: str) -> DataFrame:
    """One row: matched sources, excluded groups, eligible sources."""
    rows = rows.select(group, digest)
    matched = rows.join(ledger.select(digest), digest, "left_semi")
    eligible = rows.select(group).join(touched_groups(rows, ledger, group, digest), group, "left_anti")
    sides = matched.agg(F.count("*").alias("matched_sources"), F.count_distinct(group).alias("excluded_groups")), eligible.agg(F.count("*").alias("eligible_sources"))
    one = [s.withColumn("_k", F.lit(1)) for s in sides]
    return one[0].join(one[1], "_k").drop("_k")


def overlap(allowed: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(key, value) of allowed rows that the exclusion set has under any of the keys: such a row is an error, not a skip."""
    out = None
    for k in keys:
        hits = allowed.join(excluded.select(k).filter(F.col(k).isNotNull()).distinct(), k, "left_semi").select(F.lit(k).alias("key"), F.col(k).cast("string").alias("value"))
        out = hits if out is None else out.unionByName(hits)
    return out


def shared_groups(rows: DataFrame, group: str, role: str) -> DataFrame:
    """Groups that have more than one role; none if roles are disjoint."""
    return rows.groupBy(group).agg(F.count_distinct(role).alias("roles")).filter("roles > 1")


def coverage(parents: DataFrame, variants: DataFrame, observed: DataFrame, parent: str, variant: str) -> DataFrame:
    """(parent, variant, problem): pairs that are MISSING, UNEXPECTED or DUPLICATE against every parent with every variant.

    variants is a frozen list of at most MAX_VARIANTS values, by which parents are multiplied; more are an error.
    """
    frozen = [r[0] for r in variants.select(variant).distinct().orderBy(variant).limit(MAX_VARIANTS + 1).collect()]
    if len(frozen) > MAX_VARIANTS:
        raise ValueError(f"more than {MAX_VARIANTS} variants")
    kind = variants.schema[variant].dataType
    expected = parents.select(parent).distinct().select(parent, F.explode(F.array(*[F.lit(v).cast(kind) for v in frozen])).alias(variant))
    seen = observed.groupBy(parent, variant).agg(F.count("*").alias("n"))
    both = expected.withColumn("e", F.lit(True)).join(seen, [parent, variant], "full_outer")
    problem = F.when(F.col("n").isNull(), "MISSING").when(F.col("e").isNull(), "UNEXPECTED").when(F.col("n") > 1, "DUPLICATE")
    return both.select(parent, variant, problem.alias("problem")).filter("problem is not null")


def drop_known(rows: DataFrame, ledger: DataFrame, digest: str) -> DataFrame:
    """rows whose digest isn't in the ledger; a row goes by itself, its group stays. Null digests are in no ledger."""
    return rows.join(ledger.select(digest).distinct(), digest, "left_anti")


def remaining_violations(rows: DataFrame, ledger: DataFrame, expected: DataFrame, by: str, digest: str) -> DataFrame:
    """(by, remaining, expected) of categories in which drop_known leaves another number of rows than expected (by, expected)."""
    left = drop_known(rows, ledger, digest).groupBy(by).agg(F.count("*").alias("remaining"))
    both = left.join(expected.select(by, "expected"), by, "full_outer").select(by, F.coalesce("remaining", F.lit(0)).alias("remaining"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return both.filter("remaining <> expected")


def union_of_sources(sources: Sequence[DataFrame], column: str) -> DataFrame:
    """(column): each value that any of the sources has, once; nulls left out."""
    out = None
    for s in sources:
        own = s.select(column).filter(F.col(column).isNotNull())
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def with_children(originals: DataFrame, children: DataFrame) -> DataFrame:
    """Originals and their derived cases in one table; columns that only one side has are null in the other."""
    return originals.unionByName(children, allowMissingColumns=True)


def set_differences(stated: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, problem): MISSING from stated, or UNKNOWN to expected; none if both are the same set."""
    both = stated.select(*keys).distinct().withColumn("_s", F.lit(True)).join(expected.select(*keys).distinct().withColumn("_e", F.lit(True)), list(keys), "full_outer")
    return both.filter("_s is null or _e is null").select(*keys, F.when(F.col("_s").isNull(), "MISSING").otherwise("UNKNOWN").alias("problem"))


def development_inputs(raw: DataFrame, derived: DataFrame, policy: str, case: str = "case_id", parent: str = "parent_case_id") -> DataFrame:
    """Prototype inputs: raw FIT cases, and with the policy RAW_FIT_PLUS_R3 also derived cases of those parents. Tuning cases are raw under either policy."""
    if policy not in ("RAW_FIT_ONLY", "RAW_FIT_PLUS_R3"):
        raise ValueError(f"unknown policy {policy}")
    fit = raw.filter("role = 'FIT'")
    if policy == "RAW_FIT_ONLY":
        return fit
    return with_children(fit, derived.join(fit.select(F.col(case).alias(parent)), parent, "left_semi"))


def count_faults(inputs: DataFrame, by: Sequence[str], expected: Mapping[str, tuple[str, int]]) -> DataFrame:
    """(by, input, found, expected) of groups that don't have exactly as many inputs of a kind; expected: name -> (SQL of the kind, number)."""
    counted = inputs.groupBy(*by).agg(F.array(*[F.struct(F.lit(n).alias("input"), F.count_if(F.expr(w)).alias("found"), F.lit(k).cast("long").alias("expected")) for n, (w, k) in expected.items()]).alias("_counts"))
    return counted.select(*by, F.inline("_counts")).filter("found <> expected")


def membership(parents: DataFrame, variants: int, case: str) -> DataFrame:
    """(case, variant_id): every parent itself (variant 0) and each of its variants 1..variants."""
    return parents.select(case).distinct().withColumn("variant_id", F.explode(F.sequence(F.lit(0), F.lit(variants))))


def classified(records: DataFrame, history: DataFrame, confirmation: DataFrame, group: str) -> DataFrame:
    """records with class: HISTORICAL if their group is in history, CONFIRMATION if in confirmation, CONFLICT if in both, else RESERVE."""
    flag = lambda rows, name: rows.select(group).filter(F.col(group).isNotNull()).distinct().withColumn(name, F.lit(True))
    told = records.join(flag(history, "_h"), group, "left").join(flag(confirmation, "_c"), group, "left")
    kind = F.when(F.col("_h") & F.col("_c"), "CONFLICT").when(F.col("_h"), "HISTORICAL").when(F.col("_c"), "CONFIRMATION").otherwise("RESERVE")
    return told.withColumn("class", kind).drop("_h", "_c")


def quarantined(rows: DataFrame, pins: DataFrame, columns: Sequence[str], pin: str) -> DataFrame:
    """rows of which any of these digests is pinned by an incident, actual or declared; pins are an incident's few, broadcast behind Spark's own size check."""
    known = pins.select(F.col(pin).alias("_pin")).filter("_pin is not null").distinct()
    keyed = rows.withColumn("_d", F.explode(F.array_distinct(F.array(*columns))))
    return keyed.join(known, F.col("_d") == F.col("_pin"), "left_semi").drop("_d").distinct()


def evidence(cases: DataFrame, by: Sequence[str], case: str, digest: str, members: Sequence[str]) -> DataFrame:
    """One row for each group: cases, distinct ids and digests, and for each of members (roles, kinds: few values) the sorted set and its size."""
    sets = [F.array_sort(F.collect_set(m)).alias(m) for m in members]
    out = cases.groupBy(*by).agg(F.count("*").alias("cases"), F.count_distinct(case).alias("distinct_cases"), F.count_distinct(digest).alias("distinct_sources"), *sets)
    return out.withColumns({f"n_{m}": F.size(m) for m in members})


def ordered_digest(records: DataFrame, by: Sequence[str], order: Sequence[str], record: Column, block: int = 4096) -> DataFrame:
    """(by, records, digest): SHA-256 over the digests of blocks of `block` records in order, each that of its records joined by newlines; so no task has more than a block.

    order must be unique within a group.
    """
    ranked = running_totals(records.withColumns({"_one": F.lit(1).cast("long"), "_record": record}), by, order, ["_one"])
    blocks = ranked.groupBy(*by, F.floor(F.col("_one_before") / block).alias("_b")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("_one_before", "_record"))).alias("r"))
    blocks = blocks.select(*by, "_b", "n", F.sha2(F.array_join(F.transform("r", lambda x: x["_record"]), "\n"), 256).alias("d"))
    whole = blocks.groupBy(*by).agg(F.sum("n").alias("records"), F.array_sort(F.collect_list(F.struct("_b", "d"))).alias("r"))
    return whole.select(*by, "records", F.sha2(F.array_join(F.transform("r", lambda x: x["d"]), "\n"), 256).alias("digest"))


def strict_join(left: DataFrame, right: DataFrame, key: str, same: Sequence[str]) -> DataFrame:
    """1:1 join whose sides must have the same keys, each once, and equal columns `same`: else the query fails with the first difference."""
    a = left.select(F.struct(*left.columns).alias("a"), F.col(key).alias("_k")).groupBy("_k").agg(F.count("*").alias("na"), F.first("a").alias("a"))
    b = right.select(F.struct(*right.columns).alias("b"), F.col(key).alias("_k")).groupBy("_k").agg(F.count("*").alias("nb"), F.first("b").alias("b"))
    both = a.join(b, "_k", "full_outer")
    fault = F.when(F.col("na").isNull() | F.col("nb").isNull(), F.concat(F.lit("CASE_SET_DIFFERS "), F.col("_k").cast("string"))).when((F.col("na") > 1) | (F.col("nb") > 1), F.concat(F.lit("CASE_TWICE "), F.col("_k").cast("string")))
    for c in same:
        fault = F.coalesce(fault, F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.concat(F.lit(f"{c} DIFFERS "), F.col("_k").cast("string"))))
    return both.withColumn("_ok", F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.lit(True))).filter("_ok").select("a", "b")


def unique_violations(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(key, value, n) of values that more than one row has, each key on its own."""
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("c")).select("c.key", "c.value")
    return cells.groupBy("key", "value").agg(F.count("*").alias("n")).filter("n > 1")
