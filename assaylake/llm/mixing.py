"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone.

Every document, in an order shuffled by a hash of its id, gets a virtual finish time: the tokens of its source up to and with it,
divided by the weight of the source. A second pass over a source goes on from its first. Documents are served by virtual finish time until
the total budget is used; a source that has been served `most` times in full has nothing left, and its excess goes to the rest by weight.

No running sum has a source, or all sources, in one task: rows are range-sorted, tasks are summed, and rows are summed within a task. The global order
is known by range sums; the range in which the budget ends is sorted again until few rows are left, and only these are summed in order. Targets are found by
filling: sources whose cap is below the level leave it to the rest, until none is.

Defined results: null text has size 0; a null source is a source of its own, last in order; rows of size 0 are taken 0 times;
a null id is ordered as the smallest; rows that repeat an id are rows of their own, in order of size and a hash of the text, so that reruns agree (rows alike in
these are exchangeable); an empty table gives no rows. Other columns are neither read nor returned by mix, and kept by mixed_documents, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Budget in halves of all tokens: 3 is 150 %.
BUDGET_HALVES = 3
#: Times that a source may be served in full.
MOST = 2
#: Ranges of virtual finish time, and rows of the range in which the budget ends that may be summed in one task.
RANGES, EDGE_ROWS = 8192, 1_000_000


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_halves: int = BUDGET_HALVES, most: int = MOST) -> DataFrame:
    """One row for each source (src, weight, source_size, target): targets share the budget by weight and stop at most times the source."""
    rows = common.numbered(sized.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), ["src"], "mix-names")
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))).drop("_rank")
    rows = common.materialize(rows.withColumns({"cap": F.lit(float(most)) * F.col("source_size"), "ratio": F.lit(float(most)) * F.col("source_size") / F.col("weight")}), "mix-weights")
    budget = (rows.agg(F.sum("source_size")).first()[0] or 0) * (budget_halves / 2.0)
    level, full = None, -1
    while True:
        is_full = F.lit(False) if level is None else F.col("ratio") < F.lit(level)
        now = rows.agg(F.count_if(is_full).alias("full"), F.sum(F.when(is_full, F.col("cap")).otherwise(0.0)).alias("caps"), F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))).alias("weights")).first()
        if not now["weights"] or now["full"] == full:
            break
        level, full = (budget - now["caps"]) / now["weights"], now["full"]
    share = F.col("cap") if not now["weights"] else F.lit(level) * F.col("weight")
    return rows.select("src", "weight", "source_size", "docs", F.least("cap", share).alias("target"))


def _source(source: Column) -> Column:
    """Key of a source; null is a source of its own, last in order."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget_halves: int = BUDGET_HALVES, most: int = MOST) -> DataFrame:
    """For each row of docs: id, size, source_size, target, taken (tokens), copies (times served) and virtual_finish of its first pass."""
    return _mix(docs, id_col, text_col, source_col, weights, budget_halves, most).drop("src", "tie")


def _mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget_halves: int = BUDGET_HALVES, most: int = MOST) -> DataFrame:
    """As mix, with src, the key of the source, and tie, a hash of the text."""
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_col).alias("id"), common.words_count(F.col(text_col)).alias("size"),
        _source(F.col(source_col)).alias("src"), F.xxhash64(F.col(text_col)).alias("tie"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h"),
    )
    # Written ahead of the sort, which reads its input twice.
    sized = common.range_sorted(common.materialize(sized, "mix-sizes"), ["src", "h", "id", "size", "tie"], "mix-order")
    sources = common.materialize(plan(sized, weights, budget_halves, most), "mix-sources")
    # Two levels: sums of a source in each task that has rows of it, then rows within the task.
    upto = W.partitionBy("src").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    starts = sized.groupBy("src", "_task").agg(F.sum("size").alias("n")).select("src", "_task", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"))
    within = W.partitionBy("src", "_task").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    queued = common.lookup(sized.withColumn("cum", F.sum("size").over(within)), common.materialize(starts, "mix-starts"), ["src", "_task"], "inner").withColumn("cum", F.col("cum") + F.col("start"))
    queued = common.lookup(queued.drop("_task", "_at", "start"), sources, ["src"], "inner")
    queued = common.materialize(queued, "mix-queue")
    turn = lambda k: ((F.col("cum") + k * F.col("source_size")) / F.col("weight"))
    end = sources.agg(F.max(most * F.col("source_size") / F.col("weight")).alias("end"), F.sum("source_size").alias("all")).first()
    kept = ["id", "src", "tie", "size", "source_size", "target"]
    if not end["all"]:
        return queued.select(*kept, F.lit(0).cast("long").alias("taken"), F.lit(0).alias("copies"), F.lit(0.0).alias("virtual_finish"))
    # At most RANGES sums: the range in which the budget ends, and what is served before it.
    turns = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), turn(k).alias("finish")) for k in range(most)]))
    served = queued.filter("size > 0").select("src", "h", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "cum", "size", turns.alias("turn")).select("*", "turn.finish").drop("turn")
    served = served.withColumn("slot", F.floor(F.col("finish") / F.lit(end["end"]) * RANGES).cast("int"))
    slots = served.groupBy("slot").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).withColumn("upto", F.sum("n").over(W.orderBy("slot")))
    over = lambda upto: F.col(upto) * 2 > F.lit(budget_halves * end["all"])
    edge = slots.filter(over("upto")).orderBy("slot").select("slot", "rows", (F.col("upto") - F.col("n")).alias("before")).first()
    out = queued.withColumn("virtual_finish", turn(0))
    if edge is None:
        return out.select(*kept, (most * F.col("size")).alias("taken"), F.lit(most).alias("copies"), "virtual_finish")
    order = ["finish", "src", "h", "id", "cum"]
    cut = _cut(served.filter(F.col("slot") == edge["slot"]).select(*order, "size"), order, edge["rows"], edge["before"], over)
    kinds = ["double", "string", "string", "string", "long"]
    tuple_of = lambda columns: F.struct(*[c.cast(t).alias(n) for c, t, n in zip(columns, kinds, order)])
    rest = [F.col("src"), F.col("h"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("cum")]
    copies = sum((tuple_of([turn(k), *rest]) < tuple_of([F.lit(cut[n]) for n in order])).cast("int") for k in range(most))
    copies = F.when(F.col("size") > 0, copies).otherwise(0)
    return out.select(*kept, (copies * F.col("size")).alias("taken"), copies.alias("copies"), "virtual_finish")


def _cut(rows: DataFrame, order: list[str], count: int, before: int, over):
    """The first of rows, by order, with which the sum of sizes is over the budget; before is the sum ahead of them."""
    while count > EDGE_ROWS:
        placed = common.range_sorted(rows, order, "mix-edge")
        tasks = placed.groupBy("_task").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).withColumn("upto", F.sum("n").over(W.orderBy("_task")) + F.lit(before))
        edge = tasks.filter(over("upto")).orderBy("_task").select("_task", "rows", (F.col("upto") - F.col("n")).alias("before")).first()
        if edge["rows"] == count:  # one task took them all
            break
        rows, count, before = placed.filter(F.col("_task") == edge["_task"]).select(*order, "size"), edge["rows"], edge["before"]
    summed = rows.withColumn("sum", F.sum("size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) + F.lit(before))
    return summed.filter(over("sum")).orderBy(*order).select(*order).first()


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The training order: rows of docs, each as often as the mix takes it, range-sorted by virtual finish time.

    A row served twice appears twice; documents of no words aren't part of a mix. Repeated rows and those of a null id are rows of their own: rows of one id,
    source and text are alike to the mix, so its turns are dealt to them by number.
    """
    ident, source = options.get("id_col", "doc_id"), options.get("source_col", "source")
    text = options.get("text_col", "text")
    name = lambda c: F.when(F.col(c).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    alike = ["name", "src", "size", "tie"]
    marks = _mix(docs, **options).filter("size > 0").select(name("id").alias("name"), "src", "size", "tie", "copies", "virtual_finish")
    marks = common.materialize(marks.withColumn("rows", F.count("*").over(W.partitionBy(*alike))), "mix-marks")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(name(ident).alias("name"), _source(F.col(source)).alias("src"), common.words_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("tie"), F.struct(*columns).alias("row"))
    several = marks.filter("rows > 1")
    found = rows.join(marks.filter("rows = 1 and copies > 0").drop("rows"), alike)
    if not several.isEmpty():  # rows alike get numbers in the order of their contents; equal rows are exchangeable
        number = lambda *order: F.row_number().over(W.partitionBy(*alike).orderBy(*order))
        keys = common.materialize(several.select(*alike).distinct(), "mix-alike")
        same = common.lookup(rows, keys.withColumn("_", F.lit(True)), alike, "inner").drop("_").withColumn("number", number(F.xxhash64("row")))
        turns = several.withColumn("number", number("virtual_finish", "copies")).filter("copies > 0").drop("rows")
        found = found.unionByName(same.join(turns, [*alike, "number"]).drop("number"))
    found = found.withColumn("pass", F.explode(F.sequence(F.lit(1), "copies")))
    return found.repartitionByRange("pass", "virtual_finish").sortWithinPartitions("pass", "virtual_finish").select("row.*")


def op8_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, md5(CAST(doc_id AS VARCHAR)) AS h
  FROM documents),
sources AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY src),
weighted AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY src) - 1) % 3) + 1]::DOUBLE AS weight FROM sources),
capped AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio,
         CAST(sum(source_size) OVER () AS BIGINT) AS everything FROM weighted),
levels AS (
  SELECT *, (everything * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
shared AS (
  SELECT (SELECT level FROM levels WHERE ratio >= level ORDER BY ratio, src LIMIT 1) AS share),
targets AS (
  SELECT src, weight, source_size, everything, coalesce(least(cap, share * weight), cap) AS target FROM levels, shared),
queued AS (
  SELECT doc_id, size, src, h, CAST(sum(size) OVER (PARTITION BY src ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM sized),
served AS (
  SELECT q.*, t.source_size, t.target, t.everything, p.k, (q.cum + p.k * t.source_size)::DOUBLE / t.weight AS finish
  FROM queued q JOIN targets t USING (src), (VALUES (0), (1)) p(k)),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, src, h, CAST(doc_id AS VARCHAR), cum ROWS UNBOUNDED PRECEDING) AS upto FROM served WHERE size > 0)
SELECT s.doc_id, s.size, t.source_size, t.target,
       CAST(coalesce((SELECT sum(u.size) FROM summed u WHERE u.doc_id = s.doc_id AND u.upto * 2 <= 3 * u.everything), 0) AS BIGINT) AS taken
FROM sized s JOIN targets t USING (src)
"""
