"""Rules over documents as data, compiled into one plan.

A document is what shares a value of `document`; its parts are collections: tables with a row for each record, of which `header` may be one with a row for each document.
Rules name collections and SQL expressions over their columns. violations() turns all of them into entries (document, rule, key, side, value): each record of a collection gives the
entries of every rule it takes part in, in one scan of that table; one shuffle by (document, rule, key) brings together what has to be compared, counted ahead of it.
So a rule over a document of any number of records needs no task to hold the document, and any number of rules costs one scan for each table.

Faults are (document, rule, path, problem, n): path is collection[key] where the rule is broken, n the number of records involved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.digests import canonical

DOCUMENT = "document"
#: Problems that a rule can find.
BROKEN, REPEATED, UNORDERED, MISSING, UNKNOWN, DIFFERS, COUNT = "BROKEN", "REPEATED", "UNORDERED", "MISSING", "UNKNOWN", "DIFFERS", "COUNT"


@dataclass(frozen=True)
class Rule:
    """name: of the rule; where: SQL over the records that it is about, all by default."""

    name: str

    def entries(self) -> Iterator[tuple[str, Column]]:
        """(collection, entry or array of entries) of each side."""
        raise NotImplementedError

    def problem(self) -> Column:
        """Null if the group of a key is sound."""
        raise NotImplementedError


def _entry(key: str | Column, side: int, value: str | Column | None = None, weight: str = "1", where: str | Column = "true") -> Column:
    """Null where `where` isn't true."""
    expr = lambda e: F.expr(e) if isinstance(e, str) else e
    fields = F.coalesce(expr(key).cast("string"), F.lit("null")).alias("key"), F.lit(side).alias("side"), (F.lit(None) if value is None else expr(value)).cast("string").alias("value"), F.expr(weight).cast("long").alias("weight")
    return F.when(expr(where), F.struct(*fields))


def _same(columns: Sequence[str]) -> Column:
    """One text for several values; nulls are told from texts."""
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.expr(c).cast("string")), F.lit("-")) for c in columns])


@dataclass(frozen=True)
class Check(Rule):
    """Each record's `holds` must be true; null isn't."""

    on: str
    key: str
    holds: str
    where: str = "true"

    def entries(self):
        yield self.on, _entry(self.key, 0, where=F.expr(self.where) & ~F.coalesce(F.expr(self.holds), F.lit(False)))

    def problem(self):
        return F.lit(BROKEN)


@dataclass(frozen=True)
class Unique(Rule):
    """No two records of a document have the same key; nulls aren't compared."""

    on: str
    key: str
    where: str = "true"

    def entries(self):
        yield self.on, _entry(self.key, 0, where=F.expr(self.where) & F.expr(self.key).isNotNull())

    def problem(self):
        return F.when(F.col("n0") > 1, REPEATED)


@dataclass(frozen=True)
class Constant(Rule):
    """Records of the same key agree in `same`."""

    on: str
    key: str
    same: tuple[str, ...]
    where: str = "true"

    def entries(self):
        yield self.on, _entry(self.key, 0, _same(self.same), where=self.where)

    def problem(self):
        return F.when(F.col("low0") != F.col("high0"), DIFFERS)


@dataclass(frozen=True)
class Ascending(Rule):
    """Values (compared as text) grow with `position`, a whole number that counts up by one."""

    on: str
    position: str
    value: str

    def entries(self):
        yield self.on, F.array(_entry(self.position, 0, self.value), _entry(f"{self.position} + 1", 1, self.value))

    def problem(self):
        return F.when(F.col("low0") <= F.col("high1"), UNORDERED)


def _sided(side: int):
    return lambda x: _entry(x, side)


@dataclass(frozen=True)
class SameSet(Rule):
    """Both sides have the same keys: MISSING if only the right has one, UNKNOWN if only the left. Each side is (collection, key, where); a key may be an array of keys."""

    left: tuple[str, str, str]
    right: tuple[str, str, str]
    arrays: tuple[bool, bool] = (False, False)

    def entries(self):
        for side, ((on, key, where), many) in enumerate(zip((self.left, self.right), self.arrays)):
            if many:
                yield on, F.when(F.expr(where), F.transform(F.expr(key), _sided(side)))
            else:
                yield on, _entry(key, side, where=where)

    def problem(self):
        return F.when(F.col("n0") == 0, MISSING).when(F.col("n1") == 0, UNKNOWN)


@dataclass(frozen=True)
class Disjoint(Rule):
    """No key is on both sides."""

    left: tuple[str, str, str]
    right: tuple[str, str, str]

    def entries(self):
        for side, (on, key, where) in enumerate((self.left, self.right)):
            yield on, _entry(key, side, where=where)

    def problem(self):
        return F.when((F.col("n0") > 0) & (F.col("n1") > 0), REPEATED)


@dataclass(frozen=True)
class Belongs(Rule):
    """Each child's key is a parent's, and the child's `same` values are the parent's; told for each key of which a child fails."""

    child: tuple[str, str, str]
    parent: tuple[str, str, str]
    same: tuple[tuple[str, str], ...] = ()

    def entries(self):
        for side, (on, key, where) in enumerate((self.child, self.parent)):
            yield on, _entry(key, side, _same([pair[side] for pair in self.same]), where=where)

    def problem(self):
        wrong = (F.col("low0") != F.col("low1")) | (F.col("high0") != F.col("high1"))
        return F.when(F.col("n0") > 0, F.when(F.col("n1") == 0, UNKNOWN).when(wrong, DIFFERS))


@dataclass(frozen=True)
class Covers(Rule):
    """Each parent has each of the frozen variants once: MISSING, REPEATED, or UNKNOWN if either isn't known."""

    parent: tuple[str, str, str]
    child: tuple[str, str, str]
    variant: str
    variants: tuple[str, ...]

    def entries(self):
        on, key, where = self.parent
        pairs = [_entry(F.concat_ws("#", F.expr(key).cast("string"), F.lit(v)), 1, where=where) for v in self.variants]
        yield on, F.array(*pairs)
        on, key, where = self.child
        yield on, _entry(F.concat_ws("#", F.expr(key).cast("string"), F.expr(self.variant).cast("string")), 0, where=where)

    def problem(self):
        return F.when(F.col("n1") == 0, UNKNOWN).when(F.col("n0") == 0, MISSING).when(F.col("n0") > 1, REPEATED)


@dataclass(frozen=True)
class Total(Rule):
    """The whole number that `header` (collection, key, stated) gives for a key is the sum of `weight` (1: the number) over the records of `of` (collection, key, where) with that key."""

    header: tuple[str, str, str]
    of: tuple[str, str, str]
    weight: str = "1"

    def entries(self):
        on, key, stated = self.header
        yield on, _entry(key, 0, F.expr(stated).cast("long"))
        on, key, where = self.of
        yield on, _entry(key, 1, weight=self.weight, where=where)

    def problem(self):
        return F.when(F.col("low0").isNull() | (F.col("low0") != F.col("sum1").cast("string")), COUNT)


@dataclass(frozen=True)
class Digest(Rule):
    """The stated SHA-256 is that of the canonical JSON list of records; `digests` is a collection (document, name, digest) as listed_digests() gives it."""

    header: tuple[str, str]
    digests: str
    list_name: str

    def entries(self):
        on, stated = self.header
        yield on, _entry(F.lit(self.list_name), 0, stated)
        yield self.digests, _entry(F.lit(self.list_name), 1, "digest", where=F.col("name") == self.list_name)

    def problem(self):
        empty = F.lit(hashlib.sha256(b"[]").hexdigest())
        return F.when(F.col("n0") > 0, F.when(F.col("low0").isNull() | (F.col("low0") != F.coalesce("low1", empty)), DIFFERS))


def _numbered(number: int):
    return lambda e: F.struct(F.lit(number).alias("rule"), e["key"].alias("key"), e["side"].alias("side"), e["value"].alias("value"), e["weight"].alias("weight"))


def violations(collections: Mapping[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """(document, rule, path, problem, n) of what breaks a rule; each collection has a column `document`. Rules have unique names."""
    if len({r.name for r in rules}) != len(rules):
        raise ValueError("rules must have unique names")
    given: dict[str, list[Column]] = {}
    kind = "array<struct<rule:int,key:string,side:int,value:string,weight:bigint>>"
    for number, rule in enumerate(rules):
        for on, made in rule.entries():
            if on not in collections:
                raise KeyError(f"{rule.name}: no collection {on}")
            tagged = _numbered(number)
            many = isinstance(collections[on].select(made.alias("e")).schema["e"].dataType, ArrayType)
            entry = F.transform(F.filter(made, lambda e: e.isNotNull()), tagged) if many else F.array_compact(F.array(F.when(made.isNotNull(), tagged(made))))
            given.setdefault(on, []).append(F.coalesce(entry, F.array().cast(kind)).cast(kind))
    rows = None
    for on, columns in given.items():
        own = collections[on].select(DOCUMENT, F.explode(F.flatten(F.array(*columns))).alias("e")).select(DOCUMENT, "e.*")
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        raise ValueError("no rules")
    side = lambda s, c: F.when(F.col("side") == s, F.col(c))
    met = rows.groupBy(DOCUMENT, "rule", "key").agg(
        *[F.count(side(s, "side")).alias(f"n{s}") for s in (0, 1)], *[f(side(s, "value")).alias(f"{n}{s}") for s in (0, 1) for n, f in (("low", F.min), ("high", F.max))],
        *[F.coalesce(F.sum(side(s, "weight")), F.lit(0).cast("long")).alias(f"sum{s}") for s in (0, 1)],
    )
    problem, where = F.lit(None).cast("string"), F.lit(None).cast("string")
    for number, rule in enumerate(rules):
        problem = F.when(F.col("rule") == number, rule.problem()).otherwise(problem)
        where = F.when(F.col("rule") == number, F.concat(F.lit(f"{next(rule.entries())[0]}["), F.col("key"), F.lit("]"))).otherwise(where)
    names = F.element_at(F.array(*[F.lit(r.name) for r in rules]), F.col("rule") + 1)
    found = met.withColumn("problem", problem).filter("problem is not null")
    return found.select(DOCUMENT, names.alias("rule"), where.alias("path"), "problem", (F.col("n0") + F.col("n1")).alias("n"))


def listed_digests(records: DataFrame, order: str, fields: Mapping[str, str], lists: Mapping[str, str], ensure_ascii: bool = True) -> DataFrame:
    """(document, name, digest): SHA-256 of the canonical JSON list of records, as Python prints it, in the order of a column that is unique within a document.

    fields: JSON name -> column; lists: name -> SQL of the records in that list. A digest is sequential, so a document is read by one task, record by record as they are
    sorted; it is never held whole. Lists without records have no row.
    """
    keys, names = list(fields), list(lists)
    chosen = records.select(DOCUMENT, F.col(order).alias("_order"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(fields.values())], *[F.coalesce(F.expr(w), F.lit(False)).alias(f"w{i}") for i, w in enumerate(lists.values())])
    placed = chosen.filter(" OR ".join(f"w{i}" for i in range(len(names)))).repartition(DOCUMENT).sortWithinPartitions(DOCUMENT, "_order")
    kind = records.schema[DOCUMENT].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashes, schema = None, {}, None

        def done():
            closed = {names[k]: h for k, h in hashes.items()}
            for h in closed.values():
                h.update(b"]")
            return pa.RecordBatch.from_arrays([pa.array([now] * len(closed), schema.field(0).type), pa.array(list(closed), pa.string()), pa.array([h.hexdigest() for h in closed.values()], pa.string())], names=[DOCUMENT, "name", "digest"])

        for batch in batches:
            schema = batch.schema
            for row in batch.to_pylist():
                if hashes and row[DOCUMENT] != now:
                    yield done()
                    hashes = {}
                now = row[DOCUMENT]
                text = None
                for k in range(len(names)):
                    if row[f"w{k}"]:
                        text = text or canonical({key: row[f"f{i}"] for i, key in enumerate(keys)}, ensure_ascii).encode()
                        if k in hashes:
                            hashes[k].update(b",")
                        else:
                            hashes[k] = hashlib.sha256(b"[")
                        hashes[k].update(text)
        if hashes:
            yield done()

    return placed.mapInArrow(run, f"{DOCUMENT} {kind}, name string, digest string")
