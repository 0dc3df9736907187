"""Registered queries: every operator over whole tables, through the adapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import rank_hex
from ..functions.geometry import tiles_of
from ..operators import augment, banks, cohort, deltas, depth, metrics, observe, regions, running, scoring
from ..sources.scratch import materialize
from . import checks, documents, gridqueries, runs, scans, validators
from .adapters import cases, knn_scores, lines, patch_cases, scored, table
from .runs import rounded as _rounded

Query = Callable[[SparkSession, str], DataFrame]
RANGES = [("rotation", -4.0, 4.0), ("scale", -0.05, 0.05), ("exposure", -0.5, 0.5)]


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", "user_id", "event_type", "value")


def calibrated_thresholds(s: SparkSession, d: str) -> DataFrame:
    return metrics.thresholds(knn_scores(s, d).filter("role = 'THRESHOLD_TUNING'"))


def blind_metric_summary(s: SparkSession, d: str) -> DataFrame:
    rows = knn_scores(s, d)
    out = metrics.metric_summary(rows.filter("role = 'BLIND'"), metrics.thresholds(rows.filter("role = 'THRESHOLD_TUNING'")))
    return _rounded(out, "nominal_above_rate", "anomaly_above_rate", "auroc")


def normal_calibration_summary(s: SparkSession, d: str) -> DataFrame:
    tuning = knn_scores(s, d).filter("role = 'THRESHOLD_TUNING'").withColumn("source", F.when(F.col("case_id") % 2 == 0, "original").otherwise("augmented"))
    return metrics.calibration_summary(tuning, part="source")


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "lang", "n_chars").join(table(s, d, "labels").select("doc_id", "toxic"), "doc_id")


def image_auroc(s: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.auroc(_labelled(s, d), ["lang"], "n_chars", F.col("toxic") == 1), "auroc")


def binned_auroc(s: SparkSession, d: str) -> DataFrame:
    counts = _labelled(s, d).groupBy("lang", F.floor(F.col("n_chars") / 100).alias("bin")).agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") != 1).alias("neg"))
    return _rounded(metrics.auroc_from_counts(counts, ["lang"], "bin"), "auroc")


def confusion_by_family(s: SparkSession, d: str) -> DataFrame:
    """A twentieth of each category's events, the first by hash, calibrates its threshold; the rest is judged."""
    rows = _events(s, d).filter("value is not null").withColumn("category", F.col("user_id") % 5).withColumn("rank_hex", rank_hex(F.lit("calibration"), F.col("event_id"), separator="|"))
    rows = materialize(cohort.roles_by_share(rows, ["category"], "rank_hex", ["event_id"], {"CALIBRATION": 1, "JUDGED": 19}, of=20), "judged-events")
    limits = rows.filter("role = 'CALIBRATION'").groupBy("category").agg((F.max("value") / 4).alias("threshold"))
    joined = rows.filter("role = 'JUDGED'").join(limits, "category")
    out = metrics.confusion_by_family(joined, "category", "event_type", F.col("event_id") % 2 == 1, F.col("value") > F.col("threshold"))
    return _rounded(out, "precision", "recall", "f1")


def evenly_spaced_bank(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings").select(F.col("label").alias("category"), F.col("vec_id").alias("case_id"))
    return banks.evenly_spaced(rows, "category", "case_id", 16).select("category", "case_id", "position")


def stratified_bank(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings").select(F.col("label").alias("stratum"), F.col("vec_id").alias("case_id"))
    ranked = rows.withColumn("rank_hex", rank_hex(F.lit("stratum"), F.col("case_id"), separator="|"))
    return banks.stratified(ranked, "stratum", "rank_hex", "case_id", 64).select("stratum", "case_id", "position")


def patch_knn(s: SparkSession, d: str) -> DataFrame:
    rows = cases(s, d)
    bank = banks.evenly_spaced(patch_cases(rows.filter("role = 'FIT'")), "category", "key", 64)
    out = scoring.patch_scores(patch_cases(rows.filter("role <> 'FIT'")), bank, "category", "case_id", top_k=4)
    return _rounded(out, "score", "max_patch_distance", "mean_patch_distance")


def quota_allocation(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "customer").select(F.col("c_mktsegment").alias("category"), F.col("c_custkey").alias("group_id"))
    ranked = rows.withColumn("rank_hex", rank_hex(F.lit("quota"), F.col("category"), F.col("group_id"), separator="|"))
    tenths = [("FIT", 4), ("THRESHOLD_TUNING", 2), ("NORMAL_SELECTION", 1), ("NORMAL_CONFIRMATION", 1)]
    n = ranked.groupBy("category").agg(F.count("*").alias("n"))
    parts = [F.struct(F.lit(p).alias("partition"), F.lit(i).alias("position"), F.floor(F.col("n") * t / 10).alias("quota")) for i, (p, t) in enumerate(tenths)]
    used = sum((F.floor(F.col("n") * t / 10) for _, t in tenths), F.lit(0))
    parts.append(F.struct(F.lit("RESERVE_UNTOUCHED").alias("partition"), F.lit(len(tenths)).alias("position"), (F.col("n") - used).alias("quota")))
    quotas = n.select("category", F.explode(F.array(*parts)).alias("q")).select("category", "q.*")
    return cohort.allocate_by_quota(ranked, quotas, "category", "rank_hex", "group_id").select("category", "group_id", "rank", "partition")


def _history(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Order lines without their digest; their groups with digests, and the ledger's digests, as bytes, which are half as long as their text."""
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), "l_linenumber", "l_returnflag")
    keyed = rows.withColumn("digest", F.unhex(_line_digest()))
    return rows.drop("l_returnflag"), keyed.select("group_id", "digest"), keyed.filter("l_returnflag = 'R'").select("digest")


def _line_digest() -> Column:
    return rank_hex(F.col("group_id"), F.col("l_linenumber"), separator="|")


def history_group_anti_join(s: SparkSession, d: str) -> DataFrame:
    """Digests are told again for the lines that stay, as they are four times as long as what they are made of."""
    rows, keyed, ledger = _history(s, d)
    kept = rows.join(cohort.touched_groups(keyed, ledger, "group_id", "digest"), "group_id", "left_anti")
    return kept.select("group_id", "l_linenumber", _line_digest().alias("digest"))


def history_counts(s: SparkSession, d: str) -> DataFrame:
    return cohort.history_counts(*_history(s, d)[1:], "group_id", "digest")


def role_disjointness(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select(F.sha2("text", 256).alias("group_id"), (F.col("doc_id") % 3).alias("role"))
    return cohort.shared_groups(rows.filter("group_id is not null"), "group_id", "role")


def paired_delta_grouping_sets(s: SparkSession, d: str) -> DataFrame:
    out = deltas.delta_quantiles(lines(s, d), [["category"], ["category", "variant"]], ["category", "variant"])
    return _rounded(out, "p95", "max").withColumn("variant", F.coalesce("variant", F.lit(0)))  # 0: all variants


def delta_summary(s: SparkSession, d: str) -> DataFrame:
    return _rounded(deltas.delta_summary(materialize(lines(s, d), "lines"), ["category"]), "mean", "median", "minimum", "maximum", "positive_rate")


def stress_multi_grain(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "orders").select(F.col("o_orderpriority").alias("category"), (F.col("o_totalprice") > 200000).alias("above"))
    return _rounded(deltas.multi_grain(lines(s, d), raw, "category", "family", "level"), "stimuli_rate", "raw_rate", "mean_delta", "min_delta", "max_delta")


def nuisance_contrast(s: SparkSession, d: str) -> DataFrame:
    rows = _events(s, d).select("user_id", "event_type", F.col("value").alias("score"))
    parents = rows.groupBy("user_id").agg(F.avg("score").alias("score"))
    control = F.col("event_type") < "p"
    out = deltas.contrasts(parents, rows.filter(control), rows.filter(~control), "user_id")
    return _rounded(out, "parent_score", "control_delta", "stimulus_delta", "contrast")


def _reports(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = cases(s, d)
    bank = banks.evenly_spaced(rows.filter("role = 'FIT'"), "category", "case_id", 8)
    named = lambda x: x.withColumns({"defect": F.when(F.col("kind") == "ANOMALY", F.concat(F.lit("d"), (F.col("case_id") % 2).cast("string"))).otherwise("good"), "source_sha256": F.sha2(F.col("case_id").cast("string"), 256)})
    return deltas.compare_reports(named(scored(rows, rows.filter("role = 'FIT'"))), named(scored(rows, bank)))


def report_case_deltas(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_reports(s, d)[0], "baseline_score", "candidate_score", "delta")


def report_categories(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_reports(s, d)[1], "mean", "median", "baseline_auroc", "candidate_auroc", "auroc_delta", "baseline_threshold", "candidate_threshold", "threshold_delta")


def report_defects(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_reports(s, d)[2], "mean", "median")


def coverage_violations(s: SparkSession, d: str) -> DataFrame:
    rows = _events(s, d)
    seen = rows.select("user_id", "event_type")
    return cohort.coverage(rows.select("user_id"), rows.select("event_type"), seen, "user_id", "event_type")


def mean_references(s: SparkSession, d: str) -> DataFrame:
    means = scoring.mean_vectors(table(s, d, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("mean").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def nearest_reference(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings")
    golden = scoring.mean_vectors(rows, "label", "embedding").select(F.col("label").alias("reference_id"), F.col("mean").alias("embedding"))
    stages = [("DIGEST", F.col("case_id") % 11 != 0), ("ALIGNMENT", F.col("case_id") % 7 != 0)]
    out = observe.observe(rows.select(F.col("vec_id").alias("case_id"), "embedding"), golden, stages=stages).drop("embedding")
    return _rounded(out, "nearest_distance", "global_distance", "uncertainty").withColumns({"priority": regions.priority(F.col("nearest_distance"), 0.9, 0.7), "nearest_id": F.coalesce("nearest_id", F.lit(-1))})


def still_gate(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "part")
    why = observe.still_gate(F.col("p_retailprice"), 1200.0, F.col("p_size") / 50.0, 0.8, F.col("p_partkey") % 40, 8)
    return rows.select("p_partkey", F.array_join(why, ",").alias("reasons"), (F.size(why) == 0).alias("passed"))


def _boxes(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(s, d, "part").select("p_partkey", (k % 97).alias("image"), (k % 400).alias("x"), (k * 7 % 300).alias("y"), (F.col("p_size") * 4 + 20).cast("long").alias("width"), (F.col("p_size") % 9 * 30 + 20).cast("long").alias("height"))


def touching_regions(s: SparkSession, d: str) -> DataFrame:
    rows = _boxes(s, d)
    return regions.touching(rows.filter("p_partkey % 2 = 0"), rows.filter("p_partkey % 2 = 1"), "image").select("p_partkey", "image")


def roi_tiles(s: SparkSession, d: str) -> DataFrame:
    rows = _boxes(s, d).withColumn("regions", F.array(F.struct(*[(F.col(c) * 2).cast("double").alias(c) for c in ("x", "y", "width", "height")])))
    return rows.select("p_partkey", F.posexplode(tiles_of(F.col("regions"), F.lit(1280), F.lit(960))).alias("n", "t")).select("p_partkey", "n", "t.*")


def difference_regions(s: SparkSession, d: str) -> DataFrame:
    found = regions.components(table(s, d, "embeddings"), "vec_id", "embedding", 8, 0.1)
    return _rounded(regions.rank_regions(found, "vec_id", 3), "peak", "mean")


def densest_window(s: SparkSession, d: str) -> DataFrame:
    return depth.densest_window(_events(s, d), "event_type", "value", 2.5)


def affine_fits(s: SparkSession, d: str) -> DataFrame:
    """Totals against line prices of each clerk-sized group of customers."""
    rows = table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("image"), "l_quantity", "l_extendedprice")
    return _rounded(depth.affine_fits(rows, "image", "l_quantity", "l_extendedprice"), "slope", "intercept")


def content_duplicates(s: SparkSession, d: str) -> DataFrame:
    texts = table(s, d, "documents").select(F.lit("documents").alias("source"), F.sha2("text", 256).alias("digest"))
    pages = table(s, d, "pages").select(F.lit("pages").alias("source"), F.sha2("html", 256).alias("digest"))
    return texts.unionByName(pages).groupBy("source", "digest").agg(F.count("*").alias("n")).filter("n > 1")


def score_quantiles(s: SparkSession, d: str) -> DataFrame:
    wanted = {"p95": "p95", "upper_median": "upper_median", "median": "median", "q95": "q95"}
    return _rounded(running.order_statistics(_events(s, d), ["event_type"], "value", wanted), *wanted)


def aupro(s: SparkSession, d: str) -> DataFrame:
    region = F.when(F.col("user_id") % 3 == 0, F.col("user_id") % 7)
    pixels = _events(s, d).select(F.col("event_type").alias("category"), F.floor("value").alias("score"), region.alias("region"), F.lit(1).cast("long").alias("n"))
    return _rounded(metrics.aupro(pixels, "category", "score", "region"), "aupro")


def augmentation_plan(s: SparkSession, d: str) -> DataFrame:
    parents = table(s, d, "embeddings").select(F.col("vec_id").alias("case_id"), F.sha2(F.col("vec_id").cast("string"), 256).alias("source_sha256"))
    return augment.plan(parents, 3, "recipe").select("case_id", "variant_id", "child_case_id", "seed")


def augmentation_parameters(s: SparkSession, d: str) -> DataFrame:
    rows = augmentation_plan(s, d).withColumn("p", augment.sampled(F.col("seed"), RANGES))
    return rows.select("case_id", "variant_id", *[F.col("p")[n].alias(n) for n, _, _ in RANGES])


QUERIES: dict[str, Query] = {
    "global_knn_scores": knn_scores,
    **{
        f.__name__: f
        for f in (
            calibrated_thresholds, blind_metric_summary, normal_calibration_summary, image_auroc, binned_auroc, confusion_by_family, evenly_spaced_bank, stratified_bank, patch_knn,
            quota_allocation, history_group_anti_join, history_counts, role_disjointness, paired_delta_grouping_sets, delta_summary, stress_multi_grain, nuisance_contrast,
            report_case_deltas, report_categories, report_defects, coverage_violations, mean_references, nearest_reference, still_gate, touching_regions,
            roi_tiles, difference_regions, densest_window, affine_fits, content_duplicates, score_quantiles, aupro, augmentation_plan, augmentation_parameters,
        )
    },
    **runs.QUERIES,
    **checks.QUERIES,
    **validators.QUERIES,
    **documents.QUERIES,
    **gridqueries.QUERIES,
    **scans.QUERIES,
}
