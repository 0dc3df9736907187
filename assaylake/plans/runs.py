"""Whole runs as queries: split, bank, raw thresholds fixed, then derived cases, pairs and reports; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import rank_hex
from ..functions.vectors import doubles, patches as patches_of
from ..operators import banks, cohort, deltas, metrics, scoring, selection
from ..operators.running import order_statistics
from ..sources.scratch import materialize
from .adapters import cases, scored, table
from .oracles import CASES, COSINE, FIT, P95, UPPER, scores, spaced

GATES = {"above_rate": 0.25, "p95_minus_threshold": 0.02, "maximum_minus_threshold": 0.05}
BANK_SIZES = (4, 8, 16)
FAMILIES, LEVELS = (1, 2), (1, 2)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to 6 digits as the SQL has it: the product with a million to the nearest whole number. Spark's own round goes by the decimal text, so ties at the seventh digit may differ."""
    return df.withColumns({c: F.round(F.col(c) * 1e6) / 1e6 for c in columns})


def derived(parents: DataFrame) -> DataFrame:
    """parents once for each family and level, as children: the vector plus a share of itself, moved by places that the family gives."""
    kinds = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(k).alias("level")) for f in FAMILIES for k in LEVELS]))
    rows = parents.withColumn("_k", kinds).select("*", "_k.*").drop("_k")
    v = doubles(F.col("embedding"))
    moved = F.transform(v, lambda x, i: x + F.col("level") * F.lit(0.2) * F.get(v, (i + 7 * F.col("family")) % F.size(v)))
    child = (F.col("case_id") * 100 + F.col("family") * 10 + F.col("level")).alias("child_id")
    return rows.select("category", F.col("case_id").alias("parent_case_id"), child, "family", "level", "role", moved.alias("embedding"))


def _scored_children(children: DataFrame, bank: DataFrame) -> DataFrame:
    near = scoring.nearest(children.withColumnRenamed("case_id", "_c") if "case_id" in children.columns else children, bank.withColumnRenamed("case_id", "child_id"), "category", "child_id", "embedding")
    return children.drop("embedding").join(near.select("child_id", F.round("distance", 6).alias("score")), "child_id")


def pairs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Raw scores with the threshold of their category, and derived cases with that of their parents, both materialized. Thresholds are fixed before any derived case is scored."""
    rows = cases(s, d)
    bank = rows.filter("role = 'FIT'")
    raw = scored(rows, bank)
    limits = materialize(metrics.thresholds(raw.filter("role = 'THRESHOLD_TUNING'")), "limits")
    raw = materialize(raw.filter("role = 'BLIND' AND kind = 'NOMINAL'").join(F.broadcast(limits), "category").withColumn("above", F.col("score") > F.col("threshold")), "raw")
    children = materialize(derived(rows.filter("role = 'BLIND' AND kind = 'NOMINAL'")), "children")
    found = _scored_children(children, bank).join(F.broadcast(limits), "category").withColumn("above", F.col("score") > F.col("threshold"))
    return raw, materialize(deltas.paired(found, raw, "parent_case_id", "case_id"), "pairs")


def stress_pairs(s: SparkSession, d: str) -> DataFrame:
    return rounded(pairs(s, d)[1].select("child_id", "parent_case_id", "category", "family", "level", "score", "parent_score", "delta", "above"), "delta")


def stress_report(s: SparkSession, d: str) -> DataFrame:
    raw, found = pairs(s, d)
    out = deltas.multi_grain(found, raw.select("category", "above"), "category", "family", "level")
    return rounded(out, "stimuli_rate", "raw_rate", "mean_delta", "min_delta", "max_delta").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("family", "level")})  # 0: all


def nuisance_audit(s: SparkSession, d: str) -> DataFrame:
    """Family 1 as capture controls, the others as stimuli: contrasts of each parent, summed up by category."""
    raw, found = pairs(s, d)
    is_control = F.col("family") == 1
    both = deltas.contrasts(raw.select("case_id", "score"), found.filter(is_control).select(F.col("parent_case_id").alias("case_id"), "score"), found.filter(~is_control).select(F.col("parent_case_id").alias("case_id"), "score"), "case_id")
    both = materialize(both.join(raw.select("case_id", "category"), "case_id").withColumn("contrast", F.round("contrast", 9)), "contrasts")
    return rounded(deltas.contrast_summary(both, ["category"]), "mean", "median", "minimum", "maximum", "positive_rate", "mean_control_delta", "mean_stimulus_delta")


def synthetic_confusion(s: SparkSession, d: str) -> DataFrame:
    """Derived cases as anomalies of their family, raw ones as nominals."""
    raw, found = pairs(s, d)
    rows = raw.select("category", F.lit(0).alias("family"), "above").unionByName(found.select("category", "family", "above"))
    return rounded(metrics.confusion_by_family(rows, "category", "family", F.col("family") > 0, F.col("above")), "precision", "recall", "f1")


def development_runs(s: SparkSession, d: str) -> DataFrame:
    """Both input policies: bank of raw FIT cases, with or without derived ones; thresholds from tuning; blind nominals against them."""
    rows = cases(s, d)
    raw = materialize(rows.withColumn("child_id", F.col("case_id") * 100).select("category", "case_id", "child_id", "role", "kind", doubles(F.col("embedding")).alias("embedding")), "raw-inputs")
    children = derived(raw.filter("role = 'FIT'").drop("child_id")).withColumn("kind", F.lit("NOMINAL"))
    inputs = None
    for policy in ("RAW_FIT_ONLY", "RAW_FIT_PLUS_R3"):
        own = cohort.development_inputs(raw, children, policy).select("category", "child_id", "embedding").withColumn("policy", F.lit(policy))
        inputs = own if inputs is None else inputs.unionByName(own)
    # A category of a policy is a category of its own.
    key = F.concat_ws("/", "policy", F.col("category").cast("string"))
    bank = materialize(inputs.withColumn("key", key), "development-banks")
    queries = raw.filter("role <> 'FIT'").withColumn("policy", F.explode(F.array(F.lit("RAW_FIT_ONLY"), F.lit("RAW_FIT_PLUS_R3")))).withColumn("key", key)
    near = scoring.nearest(queries, bank, "key", "child_id", "embedding").select("key", "child_id", F.round("distance", 6).alias("score"))
    found = materialize(queries.select("key", "policy", "category", "child_id", "role", "kind").join(near, ["key", "child_id"]), "development-scores")
    limits = metrics.thresholds(found.filter("role = 'THRESHOLD_TUNING'"), "key")
    out = metrics.against_thresholds(found.filter("role = 'BLIND' AND kind = 'NOMINAL'"), limits, ["policy", "category"], "key")
    out = out.join(bank.groupBy("policy", "category").agg(F.count("*").alias("prototypes")), ["policy", "category"])
    return rounded(out, "above_rate", "p95_minus_threshold", "maximum_minus_threshold")


#: Sizes of stratified banks, the largest distances that make a score, and inputs that each category must have.
PATCH_BANKS, TOP_K = (32, 64), 3
INPUTS = {"FIT": ("role = 'FIT' AND NOT is_augmentation", 20), "TUNING": ("role = 'THRESHOLD_TUNING'", 15), "DERIVED": ("is_augmentation", 80)}


def _development_inputs(s: SparkSession, d: str) -> DataFrame:
    """(policy, category, child_id, role, is_augmentation, embedding): raw FIT and tuning cases under both policies, derived FIT cases under the second."""
    rows = cases(s, d).filter("role <> 'BLIND'")
    raw = materialize(rows.select("category", "case_id", (F.col("case_id") * 100).alias("child_id"), "role", doubles(F.col("embedding")).alias("embedding")), "raw-inputs")
    children = derived(raw.filter("role = 'FIT'").drop("child_id"))
    out = raw.filter("role = 'THRESHOLD_TUNING'").select("category", "child_id", "role", F.lit(False).alias("is_augmentation"), "embedding", F.explode(F.array(F.lit("RAW_FIT_ONLY"), F.lit("RAW_FIT_PLUS_R3"))).alias("policy"))
    for policy in ("RAW_FIT_ONLY", "RAW_FIT_PLUS_R3"):
        own = cohort.development_inputs(raw, children, policy)
        out = out.unionByName(own.select("category", "child_id", "role", (F.col("child_id") % 100 > 0).alias("is_augmentation"), "embedding").withColumn("policy", F.lit(policy)))
    return materialize(out, "development-inputs")


def successor_development(s: SparkSession, d: str) -> DataFrame:
    """Candidates of both input policies and of every bank size over one table of patches: stratified banks, one search, thresholds from raw tuning cases."""
    rows = _development_inputs(s, d).withColumn("group", F.concat_ws("/", "policy", F.col("category").cast("string")))
    patches = materialize(scoring.patch_rows(rows.withColumn("patches", patches_of(F.col("embedding"), 4)), "group", "child_id", "patches").join(rows.select("group", "child_id", "role"), ["group", "child_id"]), "development-patches")
    fit = patches.filter("role = 'FIT'").withColumn("rank_hex", rank_hex(F.lit("patch"), F.col("child_id"), F.col("patch"), separator="|"))
    bank = banks.stratified_sizes(fit, ["group"], "child_id", "rank_hex", "patch", PATCH_BANKS)
    named = lambda r: F.concat_ws("#", "group", F.col("maximum").cast("string"))
    bank = materialize(bank.withColumn("bank", named(bank)).select("bank", "key", "vector"), "development-bank")
    queries = patches.filter("role = 'THRESHOLD_TUNING'").withColumn("maximum", F.explode(F.array(*[F.lit(m).cast("long") for m in PATCH_BANKS])))
    # A patch is asked of every bank of its category, four of them, and has a key for each.
    at = F.when(F.col("group").startswith("RAW_FIT_ONLY"), 0).otherwise(2) + F.when(F.col("maximum") == PATCH_BANKS[0], 0).otherwise(1)
    queries = materialize(queries.withColumn("bank", named(queries)).select("bank", "child_id", "patch", (F.col("key") * 4 + at).alias("key"), "vector"), "development-queries")
    found = scoring.patch_scores(queries, bank, "bank", "child_id", TOP_K)
    scores = materialize(found.select("bank", F.round("score", 6).alias("score")), "development-scores")
    told = order_statistics(scores, ["bank"], "score", {"median": "median", "p95": "p95"}).join(scores.groupBy("bank").agg(F.max("score").alias("threshold")), "bank")
    counts = rows.groupBy("group", "policy", "category").agg(F.count_if((F.col("role") == "FIT") & ~F.col("is_augmentation")).alias("fit_original"), F.count_if(F.col("is_augmentation")).alias("fit_augmented"), F.count_if(F.col("role") == "THRESHOLD_TUNING").alias("tuning"))
    sizes = bank.groupBy("bank").agg(F.count("*").alias("prototypes"))
    out = told.join(sizes, "bank").withColumns({"group": F.substring_index("bank", "#", 1), "maximum": F.substring_index("bank", "#", -1).cast("long")}).join(counts, "group")
    return rounded(out.select("policy", "category", "maximum", "fit_original", "fit_augmented", "tuning", "prototypes", "threshold", "median", "p95"), "median")


def development_counts(s: SparkSession, d: str) -> DataFrame:
    """Categories of either policy that don't have exactly the inputs they must have."""
    return cohort.count_faults(_development_inputs(s, d), ["policy", "category"], INPUTS)


def candidate_scores(s: SparkSession, d: str) -> DataFrame:
    """Scores against banks of every size in one pass, as candidates."""
    rows = cases(s, d)
    key = F.concat_ws("/", F.col("maximum").cast("string"), F.col("category").cast("string"))
    bank = banks.evenly_spaced_sizes(rows.filter("role = 'FIT'"), "category", "case_id", BANK_SIZES).withColumn("key", key)
    queries = rows.filter("role <> 'FIT'").withColumn("maximum", F.explode(F.array(*[F.lit(n).cast("long") for n in BANK_SIZES]))).withColumn("key", key)
    near = scoring.nearest(queries, bank, "key", "case_id", "embedding").select("key", "case_id", F.round("distance", 6).alias("score"))
    return materialize(queries.select("key", "category", "case_id", "role", "kind", F.format_string("bank-%02d", "maximum").alias("candidate_id")).join(near, ["key", "case_id"]), "candidate-scores")


def candidate_metrics(found: DataFrame) -> DataFrame:
    limits = metrics.thresholds(found.filter("role = 'THRESHOLD_TUNING'"), "key")
    out = metrics.against_thresholds(found.filter("role = 'BLIND' AND kind = 'NOMINAL'"), limits, ["candidate_id", "category"], "key")
    return materialize(rounded(out, "p95_minus_threshold", "maximum_minus_threshold"), "candidate-metrics")


def _chosen(own: DataFrame, objective) -> DataFrame:
    judged = materialize(selection.evaluate(own, GATES, objective), "judged")
    chosen = judged.join(F.broadcast(selection.choose(judged, objective)), F.lit(True))
    names = [n for n, _, _ in objective]
    out = chosen.select("candidate_id", "passed", F.array_join("reasons", ",").alias("reasons"), *names, "state", F.col("candidate_id").eqNullSafe(F.col("selected")).alias("selected"))
    return rounded(out, *names)


def gate_and_select(s: SparkSession, d: str) -> DataFrame:
    return _chosen(candidate_metrics(candidate_scores(s, d)), selection.FRESH)


def successor_selection(s: SparkSession, d: str) -> DataFrame:
    return _chosen(candidate_metrics(candidate_scores(s, d)), selection.SUCCESSOR)


def normal_selection(s: SparkSession, d: str) -> DataFrame:
    """Candidates by the nearest-rank P95 of tuning scores (as paired P95) and by thresholds."""
    found = candidate_scores(s, d).filter("role = 'THRESHOLD_TUNING'")
    own = metrics.against_thresholds(found, metrics.thresholds(found, "key"), ["candidate_id", "category"], "key").withColumnRenamed("p95", "paired_p95")
    return _chosen(own, selection.NORMAL)


def bound_lookup(s: SparkSession, d: str) -> DataFrame:
    """Selected candidate's metrics by its unique id."""
    own = candidate_metrics(candidate_scores(s, d))
    chosen = selection.choose(selection.evaluate(own, {}, selection.FRESH), selection.FRESH)
    return rounded(own.join(F.broadcast(chosen.select(F.col("selected").alias("candidate_id"))), "candidate_id").select("candidate_id", "category", "cases", "above_count", "above_rate", "threshold", "p95", "maximum"), "above_rate")


def pixel_localization(s: SparkSession, d: str) -> DataFrame:
    """Vectors as 8 x 8 patch grids of 2 x 2 pixels; a third of them have a mask of one or two boxes."""
    rows = table(s, d, "embeddings").select(F.col("label").alias("category"), F.col("vec_id").alias("case_id"), "embedding")
    patches = rows.select("category", "case_id", F.posexplode("embedding").alias("i", "x")).select("category", "case_id", F.floor(F.col("i") / 8).alias("row"), (F.col("i") % 8).cast("long").alias("col"), F.round(F.col("x").cast("double"), 3).alias("score"))
    k = F.col("case_id")
    box = lambda n, x, y, w, h: F.struct(F.lit(n).alias("region"), x.alias("bx"), y.alias("by"), F.lit(w).alias("bw"), F.lit(h).alias("bh"))
    boxes = rows.filter("case_id % 3 = 0").select("case_id", F.explode(F.array(box(1, k % 5, k % 7, 4, 3), box(2, k % 4 + 10, k % 3 + 11, 3, 2))).alias("b")).select("case_id", "b.*").filter("region = 1 OR case_id % 2 = 0")
    masked = boxes.select("case_id", "region", "bx", F.explode(F.sequence(F.col("by"), F.col("by") + F.col("bh") - 1)).alias("y"), "bw").select("case_id", "region", "y", F.explode(F.sequence(F.col("bx"), F.col("bx") + F.col("bw") - 1)).alias("x"))
    return rounded(metrics.pixel_localization(patches, masked, "category", "case_id", 2), "pixel_auroc", "aupro")


QUERIES = {f.__name__: f for f in (stress_pairs, stress_report, nuisance_audit, synthetic_confusion, development_runs, gate_and_select, successor_selection, normal_selection, bound_lookup, pixel_localization, successor_development, development_counts)}

_MOVED = "list_transform(range(1, 65), lambda i: v[i] + level * 0.2::DOUBLE * v[((i - 1 + 7 * family) % 64) + 1])"
_KINDS = "(VALUES (1, 1), (1, 2), (2, 1), (2, 2)) k(family, level)"
_INPUTS = f"""raw_ AS (SELECT category, case_id * 100 AS child_id, role, false AS is_augmentation, v FROM cases WHERE role <> 'BLIND'),
inputs AS (SELECT 'RAW_FIT_ONLY' AS policy, * FROM raw_ UNION ALL SELECT 'RAW_FIT_PLUS_R3', * FROM raw_
  UNION ALL SELECT 'RAW_FIT_PLUS_R3', category, case_id * 100 + family * 10 + level, role, true, {_MOVED} FROM cases, {_KINDS} WHERE role = 'FIT')"""
PAIRS = f"""WITH {CASES}, {FIT}, {scores('fit')},
limits AS (SELECT category, max(score) AS threshold FROM scores WHERE role = 'THRESHOLD_TUNING' GROUP BY 1),
raw AS (SELECT category, case_id, score, threshold, score > threshold AS above FROM scores JOIN limits USING (category) WHERE role = 'BLIND' AND kind = 'NOMINAL'),
children AS (SELECT category, case_id AS parent_case_id, case_id * 100 + family * 10 + level AS child_id, family, level, {_MOVED} AS w FROM cases, {_KINDS} WHERE role = 'BLIND' AND kind = 'NOMINAL'),
near AS (SELECT category, child_id, parent_case_id, family, level, round(min({COSINE.format(a="w", b="fit.v")}), 6) AS score FROM children JOIN fit USING (category) GROUP BY ALL),
pairs AS (SELECT n.*, r.score AS parent_score, n.score - r.score AS delta, n.score > r.threshold AS above FROM near n JOIN raw r ON n.parent_case_id = r.case_id)"""


def _candidates(role: str) -> str:
    sizes = ", ".join(f"{spaced('fit', 'case_id', n, f'b{n}')}, {scores(f'b{n}', f's{n}')}" for n in BANK_SIZES)
    union = " UNION ALL ".join(f"SELECT 'bank-{n:02d}' AS candidate_id, * FROM s{n}" for n in BANK_SIZES)
    x = P95.format(x="score")
    return f"""WITH {CASES}, {FIT}, {sizes}, every AS ({union}),
limits AS (SELECT candidate_id, category, max(score) AS threshold FROM every WHERE role = 'THRESHOLD_TUNING' GROUP BY 1, 2),
own AS (SELECT candidate_id, category, count(*) AS cases, count(*) FILTER (score > threshold) AS above_count, count(*) FILTER (score > threshold) / count(*) AS above_rate, max(threshold) AS threshold, {x} AS p95, max(score) AS maximum,
  round({x} - max(threshold), 6) AS p95_minus_threshold, round(max(score) - max(threshold), 6) AS maximum_minus_threshold FROM every JOIN limits USING (candidate_id, category) WHERE {role} GROUP BY 1, 2)"""


_GATED = "CASE WHEN {m} > {limit} THEN category || '.{m}' END"


def _selected(role: str, objective) -> str:
    gates = ", ".join(_GATED.format(m=m, limit=limit) for m, limit in GATES.items())
    source = {"paired_p95": "p95"}
    values = ", ".join(f"{how}({source.get(c, c)}) AS {n}" for n, how, c in objective)
    names = ", ".join(n for n, _, _ in objective)
    return f"""{_candidates(role)},
judged AS (SELECT candidate_id, array_to_string(flatten(list(list_filter([{gates}], lambda x: x IS NOT NULL) ORDER BY category)), ',') AS reasons, {values} FROM own GROUP BY 1),
winner AS (SELECT candidate_id AS w FROM judged WHERE reasons = '' ORDER BY {names}, candidate_id LIMIT 1)
SELECT candidate_id, reasons = '' AS passed, reasons, {", ".join(f"round({n}, 6) AS {n}" for n, _, _ in objective)},
       CASE WHEN EXISTS (SELECT 1 FROM winner) THEN 'RESEARCH_CONFIGURATION_LOCKED' ELSE 'NO_ELIGIBLE_CONFIGURATION' END AS state, candidate_id IS NOT DISTINCT FROM (SELECT w FROM winner) AS selected
FROM judged"""


_BLIND, _TUNING = "role = 'BLIND' AND kind = 'NOMINAL'", "role = 'THRESHOLD_TUNING'"
_X = P95.format(x="score")
ORACLES = {
    "stress_pairs": f"{PAIRS} SELECT child_id, parent_case_id, category, family, level, score, parent_score, round(delta, 6) AS delta, above FROM pairs",
    "stress_report": f"""{PAIRS}, raws AS (SELECT category, count(*) AS raw, count(*) FILTER (above) AS raw_above FROM raw GROUP BY 1)
SELECT category, coalesce(family, 0) AS family, coalesce(level, 0) AS level, count(*) AS stimuli, count(*) FILTER (above) AS stimuli_above, round(count(*) FILTER (above) / count(*), 6) AS stimuli_rate, max(raw) AS raw, max(raw_above) AS raw_above,
       round(max(raw_above) / max(raw), 6) AS raw_rate, round(avg(delta), 6) AS mean_delta, round(min(delta), 6) AS min_delta, round(max(delta), 6) AS max_delta,
       count(*) FILTER (delta > 0) AS positive, count(*) FILTER (delta = 0) AS zero
FROM pairs JOIN raws USING (category) GROUP BY GROUPING SETS ((category), (category, family), (category, level), (category, family, level))""",
    "nuisance_audit": f"""{PAIRS},
p AS (SELECT category, parent_case_id, avg(delta) FILTER (family = 1) AS c, avg(delta) FILTER (family <> 1) AS t FROM pairs GROUP BY 1, 2),
q AS (SELECT *, round(t - c, 9) AS x FROM p)
SELECT category, count(*) AS parents, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(min(x), 6) AS minimum, round(max(x), 6) AS maximum, count(*) FILTER (x > 0) AS positive, count(*) FILTER (x = 0) AS zero,
       count(*) FILTER (x < 0) AS negative, round(count(*) FILTER (x > 0) / count(*), 6) AS positive_rate, round(avg(c), 6) AS mean_control_delta, round(avg(t), 6) AS mean_stimulus_delta FROM q GROUP BY 1""",
    "synthetic_confusion": f"""{PAIRS},
n AS (SELECT category, count(*) FILTER (above) AS fp, count(*) FILTER (NOT above) AS tn FROM raw GROUP BY 1),
o AS (SELECT category, family, count(*) FILTER (above) AS tp, count(*) FILTER (NOT above) AS fn FROM pairs GROUP BY 1, 2),
pr AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM o JOIN n USING (category))
SELECT category, family, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM pr""",
    "development_runs": f"""WITH {CASES},
bank AS (SELECT 'RAW_FIT_ONLY' AS policy, category, v AS w FROM cases WHERE role = 'FIT' UNION ALL SELECT 'RAW_FIT_PLUS_R3', category, v FROM cases WHERE role = 'FIT'
  UNION ALL SELECT 'RAW_FIT_PLUS_R3', category, {_MOVED} FROM cases, {_KINDS} WHERE role = 'FIT'),
s AS (SELECT policy, c.category, case_id, role, kind, round(min({COSINE.format(a="c.v", b="w")}), 6) AS score FROM cases c JOIN bank b ON c.category = b.category WHERE role <> 'FIT' GROUP BY ALL),
limits AS (SELECT policy, category, max(score) AS threshold FROM s WHERE {_TUNING} GROUP BY 1, 2),
n AS (SELECT policy, category, count(*) AS prototypes FROM bank GROUP BY 1, 2)
SELECT policy, category, count(*) AS cases, count(*) FILTER (score > threshold) AS above_count, round(count(*) FILTER (score > threshold) / count(*), 6) AS above_rate, max(score) AS maximum, max(threshold) AS threshold, {_X} AS p95,
       round({_X} - max(threshold), 6) AS p95_minus_threshold, round(max(score) - max(threshold), 6) AS maximum_minus_threshold, max(prototypes) AS prototypes
FROM s JOIN limits USING (policy, category) JOIN n USING (policy, category) WHERE {_BLIND} GROUP BY 1, 2""",
    "gate_and_select": _selected(_BLIND, selection.FRESH),
    "successor_selection": _selected(_BLIND, selection.SUCCESSOR),
    "normal_selection": _selected(_TUNING, selection.NORMAL),
    "bound_lookup": f"""{_candidates(_BLIND)},
judged AS (SELECT candidate_id, max(above_rate) AS a, avg(above_rate) AS b, max(p95_minus_threshold) AS c, avg(p95_minus_threshold) AS d FROM own GROUP BY 1)
SELECT candidate_id, category, cases, above_count, round(above_rate, 6) AS above_rate, threshold, p95, maximum FROM own WHERE candidate_id = (SELECT candidate_id FROM judged ORDER BY a, b, c, d, candidate_id LIMIT 1)""",
    "successor_development": f"""WITH {CASES}, {_INPUTS},
patches AS (SELECT policy, category, child_id, role, p, child_id * 16 + p AS key, v[p * 4 + 1 : p * 4 + 4] AS v, sha256('patch|' || child_id || '|' || p) AS h FROM inputs, range(16) t(p)),
hashed AS (SELECT *, row_number() OVER (PARTITION BY policy, category, child_id ORDER BY h, p) AS r FROM patches WHERE role = 'FIT'),
placed AS (SELECT *, row_number() OVER (PARTITION BY policy, category ORDER BY r, child_id) AS position FROM hashed),
bank AS (SELECT * FROM placed, (VALUES {', '.join(f'({n})' for n in PATCH_BANKS)}) m(maximum) WHERE position <= maximum),
near AS (SELECT q.policy, q.category, maximum, q.child_id, q.p, min({COSINE.format(a="q.v", b="b.v")}) AS d FROM patches q JOIN bank b ON q.policy = b.policy AND q.category = b.category WHERE q.role = 'THRESHOLD_TUNING' GROUP BY ALL),
scored AS (SELECT policy, category, maximum, child_id, round(list_avg(list_reverse_sort(list(d))[1:{TOP_K}]), 6) AS score FROM near GROUP BY ALL),
told AS (SELECT policy, category, maximum, max(score) AS threshold, round(quantile_cont(score, 0.5), 6) AS median, list_sort(list(score))[greatest(CAST(ceil(count(*) * 0.95::DOUBLE) AS BIGINT), 1)] AS p95 FROM scored GROUP BY ALL),
n AS (SELECT policy, category, count(*) FILTER (role = 'FIT' AND NOT is_augmentation) AS fit_original, count(*) FILTER (is_augmentation) AS fit_augmented, count(*) FILTER (role = 'THRESHOLD_TUNING') AS tuning FROM inputs GROUP BY ALL),
b AS (SELECT policy, category, maximum, count(*) AS prototypes FROM bank GROUP BY ALL)
SELECT policy, category, CAST(maximum AS BIGINT) AS maximum, fit_original, fit_augmented, tuning, prototypes, threshold, median, p95 FROM told JOIN n USING (policy, category) JOIN b USING (policy, category, maximum)""",
    "development_counts": f"""WITH {CASES}, {_INPUTS},
k AS (SELECT policy, category, [{', '.join(f"{{'input': '{n}', 'found': count(*) FILTER ({w}), 'expected': CAST({k} AS BIGINT)}}" for n, (w, k) in INPUTS.items())}] AS all_ FROM inputs GROUP BY policy, category), n AS (SELECT policy, category, unnest(all_) AS c FROM k)
SELECT policy, category, c.input AS "input", c.found AS found, c.expected AS expected FROM n WHERE c.found <> c.expected""",
    "pixel_localization": """
WITH boxes AS (
  SELECT vec_id, 1 AS region, vec_id % 5 AS bx, vec_id % 7 AS y0, 4 AS bw, 3 AS bh FROM embeddings WHERE vec_id % 3 = 0
  UNION ALL SELECT vec_id, 2, vec_id % 4 + 10, vec_id % 3 + 11, 3, 2 FROM embeddings WHERE vec_id % 6 = 0),
pixels AS (
  SELECT e.label AS category, e.vec_id, px, py, round(e.embedding[(py // 2) * 8 + px // 2 + 1]::DOUBLE, 3) AS score, b.vec_id || '/' || b.region AS region
  FROM (SELECT label, vec_id, embedding, x.px, y.py FROM embeddings, range(16) x(px), range(16) y(py)) e
  LEFT JOIN boxes b ON b.vec_id = e.vec_id AND px >= bx AND px < bx + bw AND py >= y0 AND py < y0 + bh),
sizes AS (SELECT region, count(*) AS size FROM pixels WHERE region IS NOT NULL GROUP BY 1),
n AS (SELECT category, count(DISTINCT region) AS regions, count(DISTINCT vec_id) FILTER (region IS NOT NULL) AS mask_cases, count(*) FILTER (region IS NULL) AS normal, count(*) FILTER (region IS NOT NULL) AS positive FROM pixels GROUP BY 1),
e AS (SELECT category, score, count(*) FILTER (p.region IS NULL) AS fp, count(*) FILTER (p.region IS NOT NULL) AS tp, coalesce(sum(1.0::DOUBLE / size), 0) AS pro FROM pixels p LEFT JOIN sizes s ON p.region = s.region GROUP BY 1, 2),
u AS (SELECT category, sum(tp * (coalesce(below, 0) + fp / 2.0)) / max(normal) / max(positive) AS auroc FROM (SELECT *, sum(fp) OVER (PARTITION BY category ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM e) JOIN n USING (category) GROUP BY 1),
c AS (SELECT category, sum(fp) OVER w / normal AS x1, (sum(fp) OVER w - fp) / normal AS x0, sum(pro) OVER w / regions AS y1, (sum(pro) OVER w - pro) / regions AS y0
  FROM e JOIN n USING (category) WINDOW w AS (PARTITION BY category ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, CASE WHEN x1 > x0 THEN least(1.0, (0.3 - x0) / (x1 - x0)) ELSE 0 END AS share FROM c WHERE x0 < 0.3),
a AS (SELECT category, sum((x1 - x0) * share * (y0 + y0 + share * (y1 - y0)) / 2) / 0.3 AS aupro FROM f GROUP BY 1)
SELECT category, mask_cases, regions, round(auroc, 6) AS pixel_auroc, round(aupro, 6) AS aupro FROM n JOIN u USING (category) JOIN a USING (category)""",
}
