"""Joins, checks and small operators as queries over the star-schema tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests, geometry, vectors
from ..operators import augment, cohort, depth, metrics, observe, regions, running, selection
from ..sources import manifest
from ..sources.scratch import materialize
from ..streaming import scores as streaming
from .adapters import cases, patch_cases, table
from .oracles import CASES, COSINE
from .runs import rounded


def _customers(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "customer").select(F.col("c_mktsegment").alias("category"), F.col("c_custkey").alias("group_id"))
    return rows.withColumn("rank_hex", digests.rank_hex(F.lit("quota"), F.col("category"), F.col("group_id"), separator="|"))


def _texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.length("text").alias("length"))


def _parts(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(s, d, "part").select("p_partkey", "p_size", "p_retailprice", (k % 97).alias("image"), (k % 400).alias("x"), (k * 7 % 300).alias("y"), (F.col("p_size") * 4 + 20).cast("long").alias("width"), (F.col("p_size") % 9 * 30 + 20).cast("long").alias("height"))


def roles_by_rank(s: SparkSession, d: str) -> DataFrame:
    counts = {"FIT": 6, "THRESHOLD_TUNING": 2, "NORMAL_SELECTION": 4, "NORMAL_CONFIRMATION": 20}
    return cohort.roles_by_rank(_customers(s, d), ["category"], "rank_hex", ["group_id"], counts).select("category", "group_id", "rank", "role")


def unmet_quotas(s: SparkSession, d: str) -> DataFrame:
    rows = _customers(s, d)
    quota = F.when(F.col("category") < "C", F.col("n")).otherwise(F.col("n") - 3)
    n = rows.groupBy("category").agg(F.count("*").alias("n")).select("category", F.lit("FIT").alias("partition"), F.lit(0).alias("position"), quota.alias("quota"))
    return cohort.unmet_quotas(rows, n, "category")


def seeded_top_violations(s: SparkSession, d: str) -> DataFrame:
    """An allowlist of 32 a category, stated as the 32 least ids, against the 32 first by hash."""
    rows = _customers(s, d)
    expected = running.hash_rank(rows, ["category"], "rank_hex", ["group_id"]).filter("rank < 32")
    stated = running.running_totals(rows.withColumn("one", F.lit(1).cast("long")), ["category"], "group_id", ["one"]).filter("one_before < 32")
    return cohort.set_differences(stated, expected, ["category", "group_id"])


def exclusion_overlap(s: SparkSession, d: str) -> DataFrame:
    rows = _texts(s, d)
    toxic = table(s, d, "labels").filter("toxic = 1").select("doc_id")
    excluded = rows.join(toxic, "doc_id", "left_semi")
    return cohort.overlap(rows.join(toxic, "doc_id", "left_anti"), excluded, ["digest", "length"]).groupBy("key", "value").agg(F.count("*").alias("n"))


def duplicate_keys(s: SparkSession, d: str) -> DataFrame:
    return cohort.unique_violations(_texts(s, d).filter("length is not null"), ["digest", "length"])


def query_set_ids(s: SparkSession, d: str) -> DataFrame:
    """Of conversation turns: ids, texts and roles that aren't unique, each on its own."""
    rows = table(s, d, "conversations").select("conv_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_sha256"))
    return cohort.unique_violations(rows, ["conv_id", "source_sha256"])


def known_rows_dropped(s: SparkSession, d: str) -> DataFrame:
    """Documents whose text the toxic ones have go by themselves; what stays of each source against what a source should have left."""
    rows = _texts(s, d)
    ledger = rows.join(table(s, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("digest")
    expected = rows.groupBy("source").agg(F.count("*").alias("expected"))
    return cohort.remaining_violations(rows.filter("source is not null"), ledger, expected.filter("source is not null"), "source", "digest")


def source_union(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "pages").select(F.sha2("html", 256).alias("digest"))
    bench = table(s, d, "benchmark").select(F.sha2("text", 256).alias("digest"))
    return cohort.union_of_sources([_texts(s, d), pages, bench], "digest").groupBy(F.substring("digest", 1, 1).alias("first")).agg(F.count("*").alias("n"))


def field_differences(s: SparkSession, d: str) -> DataFrame:
    return cohort.set_differences(table(s, d, "labels").select("doc_id"), table(s, d, "documents").select("doc_id"), ["doc_id"])


def case_evidence(s: SparkSession, d: str) -> DataFrame:
    rows = materialize(cases(s, d).withColumn("source_sha256", F.sha2(F.col("case_id").cast("string"), 256)), "evidence-cases")
    out = cohort.evidence(rows, ["category"], "case_id", "source_sha256", ["role", "kind"])
    record = F.concat_ws("|", F.col("case_id").cast("string"), "role", "source_sha256")
    digest = cohort.ordered_digest(rows, ["category"], ["case_id"], record, block=16)
    return out.join(digest, "category").select("category", "cases", "distinct_cases", "distinct_sources", F.array_join("role", ",").alias("roles"), F.array_join("kind", ",").alias("kinds"), "records", "digest")


def manifest_faults(s: SparkSession, d: str) -> DataFrame:
    rows = _texts(s, d)
    k = F.col("doc_id")
    found = rows.select(
        k.cast("string").alias("case_id"), F.when(k % 10 < 8, F.element_at(F.array(*map(F.lit, manifest.ROLES)), (k % 3 + 1).cast("int"))).otherwise("EXTRA").alias("role"), F.when(k % 4 == 0, "ANOMALY").otherwise("NOMINAL").alias("kind"),
        F.when(k % 7 == 0, F.col("digest")).otherwise(F.concat(F.lit("sha256:"), "digest")).alias("source_sha256"), F.when(k % 9 == 0, F.lit("../x.png")).otherwise(F.concat(F.lit("p/"), k.cast("string"))).alias("relative_path"),
        (k % 5 == 0).alias("is_augmentation"), F.when(k % 2 == 0, F.lit("p")).alias("parent_case_id"), F.lit(1).alias("variant_id"),
    )
    return manifest.manifest_faults(found)


def recorded_fixtures(s: SparkSession, d: str) -> DataFrame:
    rows = _texts(s, d)
    fixtures = rows.join(table(s, d, "labels").select("doc_id", "quality"), "doc_id").groupBy(F.col("digest").alias("raw_sha256")).agg(F.max("quality").cast("double").alias("distance"))
    return observe.fixture_lookup(rows.select("doc_id", F.col("digest").alias("raw_sha256")), fixtures, fallback=-1.0).select("doc_id", "distance")


def replayed_orders(s: SparkSession, d: str) -> DataFrame:
    """Order states as stated, by all of their lines, and by their last line."""
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("state"))
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.min("l_linestatus").alias("a"), F.max("l_linestatus").alias("b"), F.max(F.struct("l_linenumber", "l_linestatus"))["l_linestatus"].alias("last"))
    recorded = lines.select("case_id", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("P").alias("state"))
    return observe.replay_states(orders, recorded, lines.select("case_id", F.col("last").alias("state")))


def transform_bounds(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "part")
    k = F.col("p_partkey")
    ok = observe.transform_gate(F.col("p_size") / 25.0, k % 13 - 6.0, (k % 7) / 100.0, k % 31 * 1.0, {"scale": (0.5, 1.5), "rotation": (-5.0, 5.0), "shear": (0.0, 0.04), "shift": (0.0, 24.0)})
    return rows.select("p_partkey", ok.alias("within"), digests.is_close(F.col("p_size") / 3.0 * 3.0, F.col("p_size")).alias("close"), digests.safe_relative_path(F.col("p_name")).alias("safe_name"), F.col("p_partkey").eqNullSafe(F.pow(F.floor(F.sqrt(k.cast("double"))), 2).cast("long")).alias("square"))


def planar_geometry(s: SparkSession, d: str) -> DataFrame:
    rows = _parts(s, d)
    ray = [F.col("x") / 400.0, F.col("y") / 300.0, F.lit(1.0)]
    at = geometry.plane_intersection(ray, [F.lit(0.0), F.lit(0.6), F.lit(0.8)], [F.lit(0.0), F.lit(0.0), F.lit(10.0)], F.col("p_size") / -50.0)
    front = geometry.front_offset(ray, F.col("p_size") / 5.0, [F.lit(0.0), F.lit(0.0), F.lit(-1.0)], [F.lit(0.0), F.lit(0.0), F.lit(10.0)])
    wide = geometry.dimension_uncertainty(F.col("p_size") / 100.0, 2.0 * (F.col("width") + F.col("height")))
    corner = lambda dx, dy: F.struct((F.col("x") + dx * F.col("width")).cast("double").alias("x"), (F.col("y") + dy * F.col("height")).cast("double").alias("y"))
    quad = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
    moved = F.transform(F.array(*[F.get(quad, F.lit(i)) for i in (2, 1, 0, 3)]), lambda p: F.struct((p["x"] + 3.0).alias("x"), (p["y"] - 4.0).alias("y")))
    out = rows.select("p_partkey", *[c.alias(n) for n, c in zip(("hit_x", "hit_y", "hit_z"), at)], front.alias("front"), wide["length"].alias("length_u"), wide["area"].alias("area_u"), geometry.quad_residual(quad, moved).alias("residual"))
    return rounded(out, *out.columns[1:])


def patch_distances(s: SparkSession, d: str) -> DataFrame:
    """First patch against the last of each vector, after every seventh vector's is made zero; and the k largest mean."""
    rows = table(s, d, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    zero = F.when(F.col("vec_id") % 7 == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    a, b = F.transform(F.slice("v", 1, 4), lambda x: x * zero), F.slice("v", 61, 4)
    unit = F.transform(vectors.normalised(F.col("v")), lambda x: F.abs(x))
    return rounded(rows.select("vec_id", vectors.patch_cosine_distance(a, b).alias("distance"), vectors.top_k_mean(unit, 5).alias("top_mean")), "distance", "top_mean")


def score_faults(s: SparkSession, d: str) -> DataFrame:
    """Scores of patches, a third of them raised by half, outside of their parts."""
    rows = patch_cases(table(s, d, "embeddings").select(F.col("label").alias("category"), F.col("vec_id").alias("case_id"), "embedding"))
    per = rows.select("case_id", F.round(vectors.norm(F.col("vector")), 6).alias("n")).groupBy("case_id").agg(F.max("n").alias("max_patch_distance"), F.round(F.avg("n"), 6).alias("mean_patch_distance"))
    raised = F.col("max_patch_distance") * F.when(F.col("case_id") % 3 == 0, F.lit(1.5)).otherwise(F.lit(1.0))
    return rounded(metrics.inconsistent_scores(per.withColumn("score", raised), "case_id"), "score", "mean_patch_distance", "max_patch_distance")


def mask_overlap(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").filter("value is not null")
    counts = metrics.region_overlap_counts(F.col("value") > 50, F.col("user_id") % 3 == 0)
    out = rows.groupBy("event_type").agg(*[c.alias(n) for n, c in counts.items()])
    return rounded(out, *counts)


def summary_faults(s: SparkSession, d: str) -> DataFrame:
    """A stated summary of events, raised for some types, against what the events give."""
    rows = table(s, d, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("n"), F.round(F.max("value"), 6).alias("top"))
    rows = materialize(rows, "derived-summary")
    stated = rows.withColumn("n", F.col("n") + F.when(F.col("event_type") < "p", 1).otherwise(0)).filter("event_type <> 'view'")
    return selection.summaries_differ(stated, rows, ["event_type"], ["n", "top"])


def large_regions(s: SparkSession, d: str) -> DataFrame:
    rows = _parts(s, d).withColumn("area", F.col("width") * F.col("height"))
    return regions.keep_large(rows, "image", 256, 0.5).select("p_partkey", "image", "area")


def _ranked(s: SparkSession, d: str) -> DataFrame:
    rows = _parts(s, d)
    near = F.col("p_retailprice") % 10
    known = F.when(F.col("p_partkey") % 5 > 0, regions.priority(near, 7.0, 4.0))
    return rows.select("image", F.col("p_partkey").alias("label"), (F.col("width") * F.col("height")).alias("area"), F.round(near / 10, 6).alias("peak"), regions.priority_rank(known).alias("priority_rank"), F.when(known.isNotNull(), F.col("p_size") / 50.0).alias("crop_distance"), (F.col("p_size") % 2 == 0).alias("inner"))


def region_orders(s: SparkSession, d: str) -> DataFrame:
    """The first regions of each image in every order."""
    rows, out = _ranked(s, d), None
    for name, order, inside, prefix in (("evidence", "evidence", F.col("inner"), "R-"), ("verified", "verified", F.col("inner"), "R-"), ("legacy", "area", None, "R-"), ("boundary", "area", None, "B-")):
        own = regions.rank_regions(rows, "image", 4, inside, prefix, order).select(F.lit(name).alias("kind"), "image", "label", "rank", "region_id")
        out = own if out is None else out.unionByName(own)
    return out


def largest_masks(s: SparkSession, d: str) -> DataFrame:
    rows = _parts(s, d).select("image", F.col("p_size").alias("score"), (F.col("p_retailprice") + F.col("p_partkey") / 1000.0).alias("ratio"), "p_partkey")
    return rounded(regions.largest_mask(rows, "image"), "ratio")


def intruding_regions(s: SparkSession, d: str) -> DataFrame:
    rows = _parts(s, d)
    return regions.intruding(rows.filter("p_size < 10"), rows.filter("p_size > 40"), "image").select("p_partkey", "image")


def tile_pair_scores(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings").select(F.col("label").alias("image"), F.col("vec_id").alias("x"), (F.col("vec_id") % 11).alias("y"), F.lit(224).alias("side"), vectors.doubles(F.col("embedding")).alias("vector"))
    turned = rows.withColumn("vector", F.transform("vector", lambda v, i: v + F.get("vector", (i + 1) % 64)))
    return rounded(regions.tile_pairs(rows, turned, "image"), "score")


def mutual_parts(s: SparkSession, d: str) -> DataFrame:
    """Small against large parts of an image, by distance of their boxes."""
    rows = _parts(s, d)
    small, large = rows.filter("p_size <= 25").select("image", F.col("p_partkey").alias("a"), "x", "y"), rows.filter("p_size > 25").select("image", F.col("p_partkey").alias("b"), "x", "y")
    return regions.mutual_nearest_points(small, large, "image", "a", "b")


def overlap_means(s: SparkSession, d: str) -> DataFrame:
    """Vectors as 8 x 8 tiles of their label's canvas."""
    rows = table(s, d, "embeddings").select("label", (F.col("vec_id") % 21).alias("x"), (F.col("vec_id") % 17).alias("y"), F.lit(8).alias("side"), "embedding")
    return rounded(regions.overlap_mean(rows, "label", "embedding", "side").withColumns({c: F.col(c).cast("long") for c in ("px", "py")}), "value")


def dominant_layer(s: SparkSession, d: str) -> DataFrame:
    """The densest layer of event values, and whether its band is better than a prior of 0 to 60."""
    rows = table(s, d, "events").filter("value is not null").withColumn("v", F.round("value", 3))
    found = depth.dominant_layer(rows, "event_type", "v", 5.0, least=64, share=0.05)
    band = depth.posterior(F.col("offset"), F.col("spread"), F.lit(0.5))
    out = found.select("event_type", "center", "n", "spread", *[c.alias(n) for n, c in band.items()])
    return rounded(out.withColumn("improves", depth.improves_prior(F.col("lower95"), F.col("upper95"), F.lit(0.0), F.lit(60.0))), "center", "spread", "offset", "lower95", "upper95")


def central_widths(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("along"), F.col("l_quantity").alias("across"))
    return rounded(metrics.central_width(rows, "l_returnflag", "along", "across", -1.0), "width")


def board_planes(s: SparkSession, d: str) -> DataFrame:
    """Vectors as 8 x 8 pixels of their label's depth image, one below the other; five columns are board."""
    rows = table(s, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "z"))
    pixels = rows.select("label", (F.col("vec_id") * 8 + F.floor(F.col("i") / 8)).alias("row"), (F.col("i") % 8).alias("col"), F.round(F.col("z").cast("double") + F.col("i") % 8 / 10, 6).alias("inverse_depth"), (F.col("i") % 8 < 5).alias("is_board"), (F.col("i") % 8 >= 6).alias("is_subject"))
    return rounded(depth.coplanarity(pixels, "label"), "board_p95", "subject_median", "subject_p95")


def package_faults(s: SparkSession, d: str) -> DataFrame:
    """A package of three derived cases a vector with planted faults: some gone, some twice, some with another seed, source or variant."""
    parents = table(s, d, "embeddings").select(F.col("vec_id").alias("case_id"), F.sha2(F.col("vec_id").cast("string"), 256).alias("source_sha256"))
    k, v = F.col("case_id"), F.col("variant_id")
    made = augment.plan(parents, 3, "recipe").filter("case_id % 11 <> 0 OR variant_id <> 2").withColumn("n", F.explode(F.when((k % 13 == 0) & (v == 1), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    rows = made.select(
        F.when((k % 17 == 0) & (v == 3), F.concat("child_case_id", F.lit("x"))).otherwise(F.col("child_case_id")).alias("child_case_id"), k.alias("parent_case_id"), F.when(k % 19 == 0, F.lit("other")).otherwise(F.col("source_sha256")).alias("parent_source_sha256"),
        F.when((k % 23 == 0) & (v == 1), 9).otherwise(v).alias("variant_id"), F.when(k % 29 == 0, F.lit(None)).otherwise(F.col("seed")).alias("seed"),
    )
    return augment.package_faults(rows, parents, 3, "recipe")


def expected_members(s: SparkSession, d: str) -> DataFrame:
    """Customers with orders as parents and two variants, against the pairs that orders give."""
    orders = table(s, d, "orders")
    wanted = cohort.membership(orders.select(F.col("o_custkey").alias("case_id")), 2, "case_id")
    stated = orders.select(F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 4).cast("int").alias("variant_id"))
    return cohort.set_differences(stated, wanted, ["case_id", "variant_id"])


def parent_classes(s: SparkSession, d: str) -> DataFrame:
    rows = _texts(s, d)
    toxic = table(s, d, "labels")
    by = lambda keep: rows.join(toxic.filter(keep).select("doc_id"), "doc_id", "left_semi")
    return cohort.classified(rows, by("toxic = 1"), by("toxic = 0"), "digest").select("doc_id", "class")


def quarantined_documents(s: SparkSession, d: str) -> DataFrame:
    rows = _texts(s, d).withColumn("declared", F.when(F.col("doc_id") % 50 == 0, F.sha2(F.lit("pinned"), 256)).otherwise(F.col("digest")))
    pins = table(s, d, "benchmark").select(F.sha2("text", 256).alias("pin")).unionByName(rows.join(table(s, d, "labels").filter("toxic = 1 AND quality > 2").select("doc_id"), "doc_id", "left_semi").select(F.col("digest").alias("pin")))
    pins = pins.unionByName(s.range(1).select(F.sha2(F.lit("pinned"), 256).alias("pin")))
    return cohort.quarantined(rows.select("doc_id", "digest", "declared"), pins, ["digest", "declared"], "pin")


def flags_by_window(s: SparkSession, d: str) -> DataFrame:
    """The streaming report over events at rest."""
    rows = table(s, d, "events").select(F.col("event_type").alias("category"), F.col("event_id").alias("case_id"), "ts", F.col("value").alias("score")).filter("score is not null")
    limits = rows.groupBy("category").agg((F.max("score") / 2).alias("threshold"))
    return streaming.above_by_window(rows, limits, window="1 day", once=False).select("category", F.date_format("start", "yyyy-MM-dd").alias("day"), "cases", "above")


QUERIES = {
    f.__name__: f
    for f in (
        roles_by_rank, unmet_quotas, seeded_top_violations, exclusion_overlap, duplicate_keys, query_set_ids, known_rows_dropped, source_union, field_differences, case_evidence, manifest_faults,
        recorded_fixtures, replayed_orders, transform_bounds, planar_geometry, patch_distances, score_faults, mask_overlap, summary_faults, large_regions, region_orders, largest_masks,
        intruding_regions, tile_pair_scores, mutual_parts, overlap_means, dominant_layer, central_widths, board_planes, package_faults, expected_members, parent_classes, quarantined_documents, flags_by_window,
    )
}


_TEXTS = "texts AS (SELECT doc_id, source, lang, sha256(coalesce(text, '')) AS digest, length(text) AS length FROM documents)"
_RANKED = "ranked AS (SELECT c_mktsegment AS category, c_custkey AS group_id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('quota|' || c_mktsegment || '|' || c_custkey), c_custkey) - 1 AS rank FROM customer)"
_BOXES = "boxes AS (SELECT p_partkey, p_size, p_retailprice, p_partkey % 97 AS image, p_partkey % 400 AS x, p_partkey * 7 % 300 AS y, CAST(p_size * 4 + 20 AS BIGINT) AS width, CAST(p_size % 9 * 30 + 20 AS BIGINT) AS height FROM part)"
_NORM = "sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
_RESIDUALS = [[(d * k + s) % 4 for k in range(4)] for s in range(4) for d in (1, -1)]
_TURNED = (2, 1, 0, 3)


def _residual() -> str:
    at = [("x", "y"), ("x + width", "y"), ("x + width", "y + height"), ("x", "y + height")]
    part = lambda i, j: f"pow(({at[i][0]}) - ({at[_TURNED[j]][0]} + 3.0), 2) + pow(({at[i][1]}) - ({at[_TURNED[j]][1]} - 4.0), 2)"
    return "least(" + ", ".join("sqrt((" + " + ".join(part(i, j) for j, i in enumerate(o)) + ") / 4)" for o in _RESIDUALS) + ")"


def _region_orders() -> str:
    orders = {"evidence": "inner_ DESC, peak DESC, area DESC", "verified": "inner_ DESC, priority_rank DESC NULLS LAST, crop_distance DESC NULLS LAST, peak DESC, area DESC", "legacy": "area DESC", "boundary": "area DESC"}
    ranked = " UNION ALL ".join(f"SELECT '{k}' AS kind, image, label, row_number() OVER (PARTITION BY image ORDER BY {o}, label) AS rank, '{'B-' if k == 'boundary' else 'R-'}' AS prefix FROM r" for k, o in orders.items())
    return f"""WITH {_BOXES},
r AS (SELECT image, p_partkey AS label, width * height AS area, round(p_retailprice % 10 / 10, 6) AS peak, CASE WHEN p_partkey % 5 > 0 THEN CASE WHEN p_retailprice % 10 >= 7 THEN 2 WHEN p_retailprice % 10 >= 4 THEN 1 ELSE 0 END END AS priority_rank,
  CASE WHEN p_partkey % 5 > 0 THEN p_size / 50.0 END AS crop_distance, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS inner_ FROM boxes)
SELECT kind, image, label, CAST(rank AS INTEGER) AS rank, prefix || lpad(CAST(rank AS VARCHAR), 3, '0') AS region_id FROM ({ranked}) WHERE rank <= 4"""


ORACLES = {
    "roles_by_rank": f"WITH {_RANKED} SELECT *, CASE WHEN rank < 6 THEN 'FIT' WHEN rank < 8 THEN 'THRESHOLD_TUNING' WHEN rank < 12 THEN 'NORMAL_SELECTION' WHEN rank < 32 THEN 'NORMAL_CONFIRMATION' END AS role FROM ranked",
    "unmet_quotas": "SELECT c_mktsegment AS category, count(*) AS groups, count(*) - 3 AS quota FROM customer WHERE c_mktsegment >= 'C' GROUP BY 1",
    "seeded_top_violations": f"""WITH {_RANKED},
e AS (SELECT category, group_id FROM ranked WHERE rank < 32), s AS (SELECT category, group_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY group_id) AS r FROM ranked) WHERE r <= 32)
SELECT *, 'MISSING' AS problem FROM (SELECT * FROM e EXCEPT SELECT * FROM s) UNION ALL SELECT *, 'UNKNOWN' FROM (SELECT * FROM s EXCEPT SELECT * FROM e)""",
    "exclusion_overlap": f"""WITH {_TEXTS}, t AS (SELECT doc_id FROM labels WHERE toxic = 1), x AS (SELECT * FROM texts WHERE doc_id IN (SELECT doc_id FROM t)), a AS (SELECT * FROM texts WHERE doc_id NOT IN (SELECT doc_id FROM t))
SELECT 'digest' AS key, digest AS value, count(*) AS n FROM a WHERE digest IN (SELECT digest FROM x) GROUP BY 2
UNION ALL SELECT 'length', CAST(length AS VARCHAR), count(*) FROM a WHERE length IN (SELECT length FROM x WHERE length IS NOT NULL) GROUP BY 2""",
    "duplicate_keys": f"""WITH {_TEXTS} SELECT 'digest' AS key, digest AS value, count(*) AS n FROM texts WHERE length IS NOT NULL GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'length', CAST(length AS VARCHAR), count(*) FROM texts WHERE length IS NOT NULL GROUP BY 2 HAVING count(*) > 1""",
    "query_set_ids": """SELECT 'conv_id' AS key, CAST(conv_id AS VARCHAR) AS value, count(*) AS n FROM conversations GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'source_sha256', sha256(coalesce(text, '')), count(*) FROM conversations GROUP BY 2 HAVING count(*) > 1""",
    "known_rows_dropped": f"""WITH {_TEXTS}, x AS (SELECT digest FROM texts WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT source, count(*) FILTER (digest NOT IN (SELECT digest FROM x)) AS remaining, count(*) AS expected FROM texts WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (digest NOT IN (SELECT digest FROM x)) <> count(*)""",
    "source_union": f"""WITH {_TEXTS}, u AS (SELECT digest FROM texts UNION SELECT sha256(html) FROM pages UNION SELECT sha256(text) FROM benchmark) SELECT substr(digest, 1, 1) AS "first", count(*) AS n FROM u WHERE digest IS NOT NULL GROUP BY 1""",
    "field_differences": """SELECT doc_id, 'MISSING' AS problem FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'UNKNOWN' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""",
    "case_evidence": f"""WITH {CASES},
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY case_id) - 1 AS i, sha256(CAST(case_id AS VARCHAR)) AS source FROM cases),
b AS (SELECT category, i // 16 AS b, sha256(string_agg(case_id || '|' || role || '|' || source, chr(10) ORDER BY i)) AS d FROM r GROUP BY 1, 2),
w AS (SELECT category, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM b GROUP BY 1)
SELECT category, count(*) AS cases, count(DISTINCT case_id) AS distinct_cases, count(DISTINCT source) AS distinct_sources, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, count(*) AS records, max(digest) AS digest
FROM r JOIN w USING (category) GROUP BY category""",
    "manifest_faults": f"""WITH {_TEXTS}
SELECT CAST(doc_id AS VARCHAR) AS case_id, unnest(list_filter([CASE WHEN doc_id % 10 >= 8 THEN 'ROLE_UNKNOWN' END, CASE WHEN doc_id % 4 = 0 AND (doc_id % 10 >= 8 OR doc_id % 3 <> 2) THEN 'ANOMALY_OUTSIDE_BLIND' END,
  CASE WHEN doc_id % 7 = 0 THEN 'DIGEST_INVALID' END, CASE WHEN doc_id % 9 = 0 THEN 'PATH_UNSAFE' END, CASE WHEN doc_id % 5 = 0 AND doc_id % 2 <> 0 THEN 'PARENT_MISSING' END], lambda x: x IS NOT NULL)) AS fault FROM texts""",
    "recorded_fixtures": f"""WITH {_TEXTS}, f AS (SELECT digest, CAST(max(quality) AS DOUBLE) AS distance FROM texts JOIN labels USING (doc_id) GROUP BY 1) SELECT doc_id, coalesce(distance, -1.0::DOUBLE) AS distance FROM texts LEFT JOIN f USING (digest)""",
    "replayed_orders": """WITH l AS (SELECT l_orderkey AS case_id, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS recorded, max({'n': l_linenumber, 's': l_linestatus}).s AS recomputed FROM lineitem GROUP BY 1)
SELECT case_id, o_orderstatus AS expected, recorded, recomputed, coalesce(o_orderstatus = recorded AND o_orderstatus = recomputed, false) AS agrees FROM (SELECT o_orderkey AS case_id, o_orderstatus FROM orders) FULL JOIN l USING (case_id)""",
    "transform_bounds": """SELECT p_partkey, p_size / 25.0::DOUBLE BETWEEN 0.5 AND 1.5 AND p_partkey % 13 - 6 BETWEEN -5 AND 5 AND (p_partkey % 7) / 100.0 BETWEEN 0 AND 0.04 AND p_partkey % 31 <= 24 AS within,
  abs(p_size / 3.0::DOUBLE * 3.0 - p_size) <= 1e-12 AS "close", length(p_name) > 0 AND NOT regexp_matches(p_name, '^[A-Za-z]:') AND NOT contains(p_name, chr(92)) AND len(list_filter(string_split(p_name, '/'), lambda q: q IN ('', '.', '..'))) = 0 AS safe_name,
  p_partkey = CAST(pow(floor(sqrt(p_partkey)), 2) AS BIGINT) AS square FROM part""",
    "planar_geometry": f"""WITH {_BOXES},
r AS (SELECT *, x / 400.0::DOUBLE AS rx, y / 300.0::DOUBLE AS ry FROM boxes),
h AS (SELECT *, 0.6 * ry + 0.8 AS along, (8.0 - p_size / 50.0) / (0.6 * ry + 0.8) AS t FROM r)
SELECT p_partkey, round(rx * t, 6) AS hit_x, round(ry * t, 6) AS hit_y, round(t, 6) AS hit_z, round(10.0 - p_size / 5.0::DOUBLE, 6) AS front, round(p_size / 50.0::DOUBLE, 6) AS length_u,
  round(2.0 * (width + height) * (p_size / 100.0::DOUBLE) + pi() * (p_size / 100.0::DOUBLE) * (p_size / 100.0::DOUBLE), 6) AS area_u, round({_residual()}, 6) AS residual FROM h""",
    "patch_distances": f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT vec_id, list_transform(v[1:4], lambda x: x * CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE 1.0 END) AS a, v[61:64] AS b, list_transform(v, lambda x: abs(x / {_NORM.format(v='v')})) AS u FROM e)
SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE round({COSINE.format(a='a', b='b')}, 6) END AS distance, round(list_avg(list_reverse_sort(u)[1:5]), 6) AS top_mean FROM p""",
    "score_faults": f"""WITH p AS (SELECT vec_id AS case_id, round({_NORM.format(v='embedding[4 * i + 1 : 4 * i + 4]::DOUBLE[]')}, 6) AS n FROM embeddings, range(16) t(i)),
g AS (SELECT case_id, max(n) AS most, round(avg(n), 6) AS mean FROM p GROUP BY 1)
SELECT case_id, round(most * 1.5, 6) AS score, mean AS mean_patch_distance, most AS max_patch_distance FROM g WHERE case_id % 3 = 0 AND most > 0""",
    "mask_overlap": """WITH e AS (SELECT event_type, value > 50 AS p, user_id % 3 = 0 AS a FROM events WHERE value IS NOT NULL)
SELECT event_type, round(count(*) FILTER (p AND a) / count(*) FILTER (p OR a), 6) AS iou, round(count(*) FILTER (a AND NOT p) / nullif(count(*) FILTER (a), 0), 6) AS missing_ratio, round(count(*) FILTER (p AND NOT a) / nullif(count(*) FILTER (a), 0), 6) AS protruding_ratio,
  round((count(*) FILTER (p) - count(*) FILTER (a)) / nullif(count(*) FILTER (a), 0), 6) AS area_delta FROM e GROUP BY 1""",
    "summary_faults": """WITH g AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS n, round(max(value), 6) AS top FROM events GROUP BY 1)
SELECT event_type, 'n' AS "column", CASE WHEN event_type = 'view' THEN NULL ELSE n + 1 END AS stated, n AS derived FROM g WHERE event_type < 'p' OR event_type = 'view'
UNION ALL SELECT event_type, 'top', NULL, top FROM g WHERE event_type = 'view'""",
    "large_regions": f"WITH {_BOXES} SELECT p_partkey, image, area FROM (SELECT *, width * height AS area, max(width * height) OVER (PARTITION BY image) AS most FROM boxes) WHERE area >= greatest(256.0, 0.5 * most)",
    "region_orders": _region_orders(),
    "largest_masks": f"WITH {_BOXES}, m AS (SELECT image, p_size AS score, p_retailprice + p_partkey / 1000.0::DOUBLE AS ratio, p_partkey, row_number() OVER (PARTITION BY image ORDER BY p_size DESC, p_retailprice + p_partkey / 1000.0::DOUBLE DESC) AS r FROM boxes) SELECT image, score, round(ratio, 6) AS ratio, p_partkey FROM m WHERE r = 1",
    "intruding_regions": f"""WITH {_BOXES} SELECT p_partkey, image FROM boxes a WHERE p_size < 10 AND EXISTS (SELECT 1 FROM boxes b WHERE b.p_size > 40 AND a.image = b.image AND a.x < b.x + b.width AND b.x < a.x + a.width AND a.y < b.y + b.height AND b.y < a.y + a.height)""",
    "tile_pair_scores": f"""WITH e AS (SELECT label AS image, embedding::DOUBLE[] AS v FROM embeddings), t AS (SELECT image, v, list_transform(range(1, 65), lambda i: v[i] + v[(i % 64) + 1]) AS w FROM e)
SELECT image, count(*) AS tiles, round(avg({COSINE.format(a='v', b='w')}), 6) AS score FROM t GROUP BY 1""",
    "mutual_parts": f"""WITH {_BOXES}, p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(abs(a.x - b.x) + abs(a.y - b.y) AS DOUBLE) AS distance FROM boxes a JOIN boxes b ON a.image = b.image AND a.p_size <= 25 AND b.p_size > 25),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY distance, a) AS rb FROM p),
sa AS (SELECT a, min(distance) FILTER (ra = 2) AS second FROM r GROUP BY 1), sb AS (SELECT b, min(distance) FILTER (rb = 2) AS second FROM r GROUP BY 1)
SELECT a, b, distance FROM r JOIN sa USING (a) JOIN sb USING (b) WHERE ra = 1 AND rb = 1 AND (sa.second IS NULL OR distance < 0.75 * sa.second) AND (sb.second IS NULL OR distance < 0.75 * sb.second)""",
    "overlap_means": """WITH c AS (SELECT label, vec_id % 21 + i % 8 AS px, vec_id % 17 + i // 8 AS py, embedding[i + 1] AS v FROM embeddings, range(64) t(i)) SELECT label, px, py, round(avg(v), 6) AS value FROM c GROUP BY 1, 2, 3""",
    "dominant_layer": """
WITH e AS (SELECT event_type, round(value, 3) AS v FROM events WHERE value IS NOT NULL),
w AS (SELECT DISTINCT event_type, v AS low, count(*) OVER (PARTITION BY event_type ORDER BY v RANGE BETWEEN CURRENT ROW AND 10.0 FOLLOWING) AS n FROM e),
m AS (SELECT * FROM w QUALIFY n = max(n) OVER (PARTITION BY event_type)),
c AS (SELECT m.event_type, low, quantile_cont(v, 0.5) AS center FROM m JOIN e ON m.event_type = e.event_type AND v BETWEEN low AND low + 10.0 GROUP BY 1, 2),
i AS (SELECT c.event_type, low, center, v FROM c JOIN e ON c.event_type = e.event_type AND v BETWEEN center - 5.0 AND center + 5.0),
f AS (SELECT event_type, low, center, count(*) AS n, quantile_cont(v, 0.5) AS off FROM i GROUP BY 1, 2, 3),
t AS (SELECT event_type, count(*) AS total FROM e GROUP BY 1),
b AS (SELECT f.* FROM f JOIN t USING (event_type) WHERE n >= greatest(64, ceil(total * 0.05)) QUALIFY row_number() OVER (PARTITION BY f.event_type ORDER BY n DESC, off DESC, low DESC) = 1),
s AS (SELECT b.event_type, b.center, b.n, b.off, quantile_cont(abs(v - off), 0.95) AS spread FROM b JOIN i ON b.event_type = i.event_type AND b.low = i.low GROUP BY 1, 2, 3, 4),
p AS (SELECT *, greatest(0, off - (8.5 + spread)) AS lo, least(1000, off + 8.5 + spread) AS hi FROM s)
SELECT event_type, round(center, 6) AS center, n, round(spread, 6) AS spread, round(least(1000, greatest(0, off)), 6) AS "offset", round(lo, 6) AS lower95, round(hi, 6) AS upper95, (hi - lo) + 1e-9 < 60 AND lo + 1e-9 >= 0 AND hi <= 60 + 1e-9 AS improves FROM p""",
    "central_widths": """
WITH p AS (SELECT l_returnflag, l_extendedprice AS u, l_quantity AS v, min(l_extendedprice) OVER w AS low, max(l_extendedprice) OVER w AS high FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)),
s AS (SELECT l_returnflag, floor(((u - low) / (high - low) - 0.2) / 0.6 * 12) AS k, v FROM p),
g AS (SELECT l_returnflag, k, count(*) AS n, quantile_cont(v, 0.995) - quantile_cont(v, 0.005) AS w FROM s WHERE k BETWEEN 0 AND 11 GROUP BY 1, 2)
SELECT l_returnflag, CASE WHEN count(*) FILTER (n >= 32 AND w > 0) >= 8 THEN round(quantile_cont(w, 0.9) FILTER (n >= 32 AND w > 0), 6) ELSE -1.0 END AS width FROM g GROUP BY 1""",
    "board_planes": """
WITH p AS (SELECT label, CAST(vec_id * 8 + i // 8 AS DOUBLE) AS v, CAST(i % 8 AS DOUBLE) AS u, round(embedding[i + 1]::DOUBLE + i % 8 / 10.0::DOUBLE, 6) AS z, i % 8 < 5 AS b, i % 8 >= 6 AS s FROM embeddings, range(64) t(i)),
f AS (SELECT label, avg(u) FILTER (b) AS mu, avg(v) FILTER (b) AS mv, avg(z) FILTER (b) AS mz, var_pop(u) FILTER (b) AS uu, var_pop(v) FILTER (b) AS vv, covar_pop(u, v) FILTER (b) AS uv, covar_pop(u, z) FILTER (b) AS uz, covar_pop(v, z) FILTER (b) AS vz,
  quantile_cont(z, 0.95) - quantile_cont(z, 0.05) AS span FROM p GROUP BY 1),
o AS (SELECT p.*, abs(z - (mz + (uz * vv - vz * uv) / (uu * vv - uv * uv) * (u - mu) + (vz * uu - uz * uv) / (uu * vv - uv * uv) * (v - mv))) / span AS off FROM p JOIN f USING (label)),
q AS (SELECT label, quantile_cont(off, 0.95) FILTER (b) AS b95, quantile_cont(off, 0.5) FILTER (s) AS s50, quantile_cont(off, 0.95) FILTER (s) AS s95 FROM o GROUP BY 1)
SELECT label, 'AVAILABLE' AS state, CASE WHEN b95 <= 0.05 AND s50 <= 0.08 AND s95 <= 0.15 THEN 'COPLANAR_CANDIDATE' ELSE 'NON_COPLANAR_RISK' END AS observation, round(b95, 6) AS board_p95, round(s50, 6) AS subject_median, round(s95, 6) AS subject_p95 FROM q""",
    "package_faults": """
WITH p AS (SELECT vec_id AS k, sha256(CAST(vec_id AS VARCHAR)) AS source, v, vec_id || '/augmented/' || lpad(CAST(v AS VARCHAR), 2, '0') AS child,
  CAST(CAST('0x' || substr(sha256('recipe' || chr(0) || vec_id || chr(0) || sha256(CAST(vec_id AS VARCHAR)) || chr(0) || v), 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM embeddings, range(1, 4) t(v)),
c AS (SELECT CASE WHEN k % 17 = 0 AND v = 3 THEN child || 'x' ELSE child END AS child, k, CASE WHEN k % 19 = 0 THEN 'other' ELSE source END AS source, CASE WHEN k % 23 = 0 AND v = 1 THEN 9 ELSE v END AS v, CASE WHEN k % 29 = 0 THEN NULL ELSE seed END AS seed,
  CASE WHEN k % 13 = 0 AND v = 1 THEN 2 ELSE 1 END AS n FROM p WHERE k % 11 <> 0 OR v <> 2),
b AS (SELECT coalesce(p.child, c.child) AS child_case_id, [CASE WHEN c.child IS NULL THEN 'MISSING' END, CASE WHEN p.child IS NULL THEN 'UNEXPECTED' END, CASE WHEN n > 1 THEN 'TWICE' END,
  CASE WHEN p.child = c.child AND p.source <> c.source THEN 'SOURCE_DIFFERS' END, CASE WHEN p.child = c.child AND p.v <> c.v THEN 'VARIANT_DIFFERS' END, CASE WHEN p.child = c.child AND p.seed IS DISTINCT FROM c.seed THEN 'SEED_DIFFERS' END] AS f FROM p FULL JOIN c ON p.child = c.child)
SELECT child_case_id, unnest(list_filter(f, lambda x: x IS NOT NULL)) AS fault FROM b""",
    "expected_members": """
WITH e AS (SELECT DISTINCT o_custkey AS case_id, CAST(v AS INTEGER) AS variant_id FROM orders, range(3) t(v)), s AS (SELECT DISTINCT o_custkey AS case_id, CAST(o_orderkey % 4 AS INTEGER) AS variant_id FROM orders)
SELECT *, 'MISSING' AS problem FROM (SELECT * FROM e EXCEPT SELECT * FROM s) UNION ALL SELECT *, 'UNKNOWN' FROM (SELECT * FROM s EXCEPT SELECT * FROM e)""",
    "parent_classes": f"""WITH {_TEXTS}, h AS (SELECT digest FROM texts WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)), c AS (SELECT digest FROM texts WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0))
SELECT doc_id, CASE WHEN digest IN (SELECT digest FROM h) AND digest IN (SELECT digest FROM c) THEN 'CONFLICT' WHEN digest IN (SELECT digest FROM h) THEN 'HISTORICAL' WHEN digest IN (SELECT digest FROM c) THEN 'CONFIRMATION' ELSE 'RESERVE' END AS "class" FROM texts""",
    "quarantined_documents": f"""WITH {_TEXTS}, d AS (SELECT doc_id, digest, CASE WHEN doc_id % 50 = 0 THEN sha256('pinned') ELSE digest END AS declared FROM texts),
p AS (SELECT sha256(text) AS pin FROM benchmark WHERE text IS NOT NULL UNION SELECT digest FROM texts WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND quality > 2) UNION SELECT sha256('pinned'))
SELECT * FROM d WHERE digest IN (SELECT pin FROM p) OR declared IN (SELECT pin FROM p)""",
    "flags_by_window": """WITH t AS (SELECT event_type, max(value) / 2 AS threshold FROM events GROUP BY 1)
SELECT event_type AS category, strftime(ts, '%Y-%m-%d') AS day, count(*) AS cases, count(*) FILTER (value > threshold) AS above FROM events JOIN t USING (event_type) WHERE value IS NOT NULL GROUP BY 1, 2""",
}
