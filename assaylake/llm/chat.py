"""Multi-party perspective rotation, in DataFrame functions alone: for every participant, the dialogue with that speaker as assistant.

Turns are gathered in parts of PART turns by their rank in the conversation, so that any conversation has bounded groups; each part is rendered for each
participant of the whole conversation, so one of very many roles is rendered as often. Ranks of conversations beyond a part come from a range sort, so no task holds one. Others are named users; system turns stay system
turns and aren't participants. mask_spans lists what a loss counts: the assistant's content with its end mark, as "start-end" in code points of text, 0-based, end exclusive.

Defined results: a null role is the speaker "unknown"; null text is empty; a null turn counts as -1; a null conv_id is one conversation of its own; rows that repeat in
conversation, turn, role and text are rendered once; equal turns are in order of role, then text; a mark within a text gets a blank ("<|im_end |>"), so that no turn can forge
another; a conversation of system turns alone gives no rows, and so does an empty table. Other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from . import common

#: Turns of a part, and parts of a block: participants meet the blocks of a conversation.
PART, BLOCK = 256, 64
SYSTEM = ("system", "developer")
OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>"


def _placed(turns: DataFrame, long: DataFrame, part_turns: int, limit: int | None = None) -> DataFrame:
    """turns with part: 0 in conversations within a part, else by rank."""
    told = common.spread_lookup(turns, long, "key", "n", turns.count(), "left", limit)
    short = told.filter("n is null").drop("n").withColumn("part", F.lit(0).cast("long"))
    sorted_ = common.range_sorted(told.filter("n is not null").drop("n"), ["key", "turn", "role", "text"], "chat-order")
    # Of each conversation and task: its first row there, and its rows in earlier tasks.
    runs = sorted_.groupBy("key", "_task").agg(F.min("_at").alias("first"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("key").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = common.materialize(runs.select("key", "_task", (F.col("first") - before).alias("base")), "chat-runs")
    ranked = common.lookup(sorted_, runs, ["key", "_task"], "inner").withColumn("part", F.floor((F.col("_at") - F.col("base")) / part_turns))
    return short.unionByName(ranked.select(short.columns))


def rotate(conversations: DataFrame, part_turns: int = PART) -> DataFrame:
    """Rows (conv_id, perspective, part, n_turns, text, mask_spans)."""
    safe = F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|(im_start|im_end)\|>", "<|$1 |>")
    turns = conversations.select(
        F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))).alias("key"), "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), safe.alias("text"),
    )
    turns = common.materialize(turns.distinct(), "chat-turns")
    long = common.materialize(turns.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > part_turns), "chat-long")
    people = turns.filter(~F.col("role").isin(*SYSTEM)).select("key", F.col("role").alias("perspective")).distinct()
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.coalesce("n", F.lit(1)) - 1) / (part_turns * BLOCK)))
    people = common.lookup(people, long, ["key"]).select("key", "perspective", F.explode(blocks).alias("block"))
    rows = _placed(turns, long, part_turns).withColumn("block", F.floor(F.col("part") / BLOCK)).repartition("key", "block")
    parts = rows.groupBy("key", "block", "part").agg(F.any_value("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    rows = parts.join(people, ["key", "block"])

    def render(t):
        name = F.regexp_replace(t["role"], "[^A-Za-z0-9_-]", "_")
        head = F.when(t["role"] == F.col("perspective"), F.lit("assistant")).when(t["role"].isin(*SYSTEM), F.lit("system")).otherwise(F.concat(F.lit("user name="), name))
        return F.struct(F.concat(F.lit(OPEN), head, F.lit(BREAK)).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), (t["role"] == F.col("perspective")).alias("own"))

    rows = rows.withColumn("segments", F.transform("turns", render))
    # Where each segment starts, by a running sum over the part's turns.
    length = lambda s: F.length(s["head"]) + F.length(s["body"]) + len(BREAK)
    starts = F.aggregate("segments", F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + length(s))))
    rows = rows.withColumn("starts", starts)
    span = lambda s, i: F.when(s["own"], F.concat_ws("-", F.get("starts", i) + F.length(s["head"]), F.get("starts", i) + F.length(s["head"]) + F.length(s["body"])))
    return rows.select(
        "conv_id", "perspective", F.col("part").cast("long").alias("part"), F.size("turns").cast("long").alias("n_turns"),
        F.concat(F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"])), BREAK), F.lit(BREAK)).alias("text"),
        F.array_join(F.filter(F.transform("segments", span), lambda x: x.isNotNull()), ",").alias("mask_spans"),
    )


def op3_chat_rotation(spark, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP3_SQL = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role,
         regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<|\1 |>', 'g') AS text FROM conversations),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) // 256 AS part FROM turns),
people AS (
  SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role NOT IN ('system', 'developer')),
segments AS (
  SELECT t.conv_id, perspective, part, turn, role, text, role = perspective AS own,
         '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role IN ('system', 'developer') THEN 'system'
           ELSE 'user name=' || regexp_replace(role, '[^A-Za-z0-9_-]', '_', 'g') END || chr(10) AS head,
         text || '<|im_end|>' AS body
  FROM ranked t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn, role, text
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS start FROM segments)
SELECT conv_id, perspective, part, count(*) AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY turn, role, text) AS text,
       coalesce(string_agg(start || '-' || (start + length(body)), ',' ORDER BY turn, role, text) FILTER (own), '') AS mask_spans
FROM placed GROUP BY conv_id, perspective, part
"""
