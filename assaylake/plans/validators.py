"""Validators of nested documents as rule tables, applied to documents that are made from the given tables with planted faults.

Each family is a list of rules (operators/constraints). Its documents are SQL over the given tables, in a form that Spark and DuckDB both read; `digest` is the engine's SHA-256.
The oracle states each rule as a query of its own: counts, joins, lag and string aggregation instead of entries by key.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.constraints import Ascending, Belongs, Check, Constant, Covers, Digest, Disjoint, Rule, SameSet, Total, Unique, listed_digests, violations
from ..sources.scratch import materialize
from .adapters import table

VARIANTS = ("1", "2", "3")
#: Roles, kinds and domains of reports.
NORMAL_ROLES = "('FIT', 'THRESHOLD_TUNING')"
IDENTITY = {
    "augmentationRecipeSha256": "recipe", "caseId": "case_id", "category": "category", "isAugmentation": "is_augmentation", "kind": "kind", "parentCaseId": "parent_case_id",
    "parentSourceSha256": "parent_source", "role": "role", "sourceSha256": "source", "variantId": "variant_id",
}
LISTS = {"features": "true", "calibration": "role = 'THRESHOLD_TUNING'", "originals": "role = 'THRESHOLD_TUNING' AND NOT is_augmentation"}


def is_digest(c: str) -> str:
    return f"{c} LIKE 'sha256:%' AND length({c}) = 71 AND translate(substr({c}, 8), '0123456789abcdef', '') = ''"


def is_safe(c: str) -> str:
    return f"{c} <> '' AND {c} NOT LIKE '/%' AND ('/' || {c} || '/') NOT LIKE '%/../%' AND ('/' || {c} || '/') NOT LIKE '%/./%' AND {c} NOT LIKE '%//%'"


_WHO = " || '|' || ".join(f"coalesce(cast({c} AS string), '-')" for c in IDENTITY.values())


def _inputs(on: str) -> list[Rule]:
    """A record that a report lists as an input."""
    return [
        Check(f"{on}: fields", on, "case_id", "extra IS NULL"),
        Check(f"{on}: role", on, "case_id", f"role IN {NORMAL_ROLES}"),
        Check(f"{on}: kind", on, "case_id", "kind = 'NOMINAL'"),
        Check(f"{on}: category", on, "case_id", "category IN ('k0', 'k1', 'k2')"),
        Check(f"{on}: source", on, "case_id", is_digest("source")),
        Check(f"{on}: provenance", on, "case_id", f"variant_id > 0 AND parent_case_id IS NOT NULL AND {is_digest('parent_source')} AND {is_digest('recipe')}", "is_augmentation"),
        Check(f"{on}: no provenance", on, "case_id", "variant_id IS NULL AND parent_case_id IS NULL AND parent_source IS NULL AND recipe IS NULL", "NOT is_augmentation"),
        Unique(f"{on}: case", on, "case_id"),
        Ascending(f"{on}: order", on, "position", "case_id"),
    ]


_PARENTS = (("features", "parent_case_id", "is_augmentation"), ("features", "case_id", "NOT is_augmentation"))
NORMAL_EVIDENCE = [
    *_inputs("features"),
    Check("evidence: no blind inputs", "header", "document", "blind_count = 0 AND anomaly_count = 0"),
    Total("evidence: count", ("header", "''", "feature_count"), ("features", "''", "true")),
    Total("evidence: calibration count", ("header", "''", "calibration_count"), ("calibration_scores", "''", "true")),
    Total("evidence: originals count", ("header", "''", "originals_count"), ("features", "''", LISTS["originals"])),
    SameSet("evidence: roles", ("header_roles", "role", "true"), ("features", "role", "true")),
    Belongs("evidence: parents", *_PARENTS, (("category", "category"), ("role", "role"), ("kind", "kind"), ("parent_source", "source"))),
    Belongs("evidence: recipe", ("features", "''", "is_augmentation"), ("header", "''", "true"), (("recipe", "universe_recipe"),)),
    Covers("evidence: variants", ("features", "case_id", "NOT is_augmentation"), ("features", "parent_case_id", "is_augmentation"), "variant_id", VARIANTS),
    SameSet("evidence: calibration is tuning", ("calibration", _WHO, "true"), ("features", _WHO, LISTS["calibration"])),
    SameSet("evidence: calibration has scores", ("calibration_scores", "case_id", "true"), ("calibration", "case_id", "true")),
    Digest("evidence: feature identity", ("header", "feature_identity"), "digests", "features"),
    Digest("evidence: calibration identity", ("header", "calibration_identity"), "digests", "calibration"),
    Digest("evidence: originals identity", ("header", "originals_identity"), "digests", "originals"),
]
SCORE_RECORDS = [
    Check("score: fields", "scores", "case_id", "extra IS NULL"),
    Check("score: category", "scores", "case_id", "category IN ('k0', 'k1', 'k2')"),
    Check("score: normal", "scores", "case_id", "role = 'THRESHOLD_TUNING' AND kind = 'NOMINAL' AND defect = 'good'"),
    Check("score: source", "scores", "case_id", is_digest("source")),
    Check("score: range", "scores", "case_id", "score BETWEEN 0 AND 2"),
    Check("score: provenance", "scores", "case_id", f"variant_id > 0 AND parent_case_id IS NOT NULL AND {is_digest('parent_source')} AND {is_digest('recipe')}", "is_augmentation"),
    Check("score: no variant", "scores", "case_id", "variant_id IS NULL", "NOT is_augmentation"),
    Unique("score: case", "scores", "case_id"),
    Check("gate: fields", "gates", "position", "extra IS NULL"),
    Check("gate: variant", "gates", "position", "variant_id > 0"),
    Check("gate: limits", "gates", "position", "limit_p95 >= 0 AND limit_max >= 0"),
    Unique("gate: variants once", "gates", "variant_id"),
    Ascending("gate: order", "gates", "position", "lpad(cast(variant_id AS string), 6, '0')"),
    SameSet("gate: covers variants", ("gates", "variant_id", "true"), ("frozen", "variant_id", "true")),
]
HISTORICAL_REPORT = [
    Check("report: fields", "header", "document", "extra IS NULL"),
    Check("report: not authoritative", "header", "document", "NOT authoritative AND NOT production_authorized"),
    Check("report: protocol", "header", "document", "protocol = 'NORMAL_ONLY' AND blind_state = 'NOT_RUN' AND blind_policy = 'ORIGINAL_ONLY'"),
    *_inputs("features"),
    Total("report: count", ("header", "''", "feature_count"), ("features", "''", "true")),
    SameSet("report: roles", ("header_roles", "role", "true"), ("features", "role", "true")),
    Belongs("report: parents", *_PARENTS, (("category", "category"), ("role", "role"), ("parent_source", "source"))),
    SameSet("report: calibration is tuning", ("calibration", _WHO, "true"), ("features", _WHO, LISTS["calibration"])),
    Total("report: score count", ("header", "''", "calibration_count"), ("calibration_scores", "''", "true")),
    Check("report: scores normal", "calibration_scores", "case_id", "role = 'THRESHOLD_TUNING' AND kind = 'NOMINAL' AND defect = 'good'"),
    Digest("report: feature identity", ("header", "feature_identity"), "digests", "features"),
    SameSet("report: ledger has the sources", ("ledger", "source", "true"), ("sources", "source", "source IS NOT NULL")),
]
POOL_PLAN = [
    Check("pool: fields", "pool", "case_id", "extra IS NULL"),
    Check("pool: nominal", "pool", "case_id", "kind = 'NOMINAL' AND defect = 'good'"),
    Check("pool: path", "pool", "case_id", is_safe("path")),
    Check("pool: remote path", "pool", "case_id", is_safe("remote_path")),
    Check("pool: bytes", "pool", "case_id", "expected_bytes > 0 AND expected_bytes = actual_bytes"),
    Check("pool: source", "pool", "case_id", f"source = expected_source AND source = actual_source AND {is_digest('source')}"),
    Check("pool: case binds its source", "pool", "case_id", "case_id = 'pool/' || category || '/' || substr(source, 8)"),
    Check("pool: group binds its source", "pool", "case_id", "group_id = 'CONTENT_SHA256:' || substr(source, 8)", "grouping = 'EXACT_CONTENT_ONLY'"),
    Constant("pool: group in one category", "pool", "group_id", ("category", "stratum")),
    *[Unique(f"pool: {c} once", "pool", c) for c in ("case_id", "path", "remote_path", "source")],
    Belongs("plan: pool", ("plan", "pool_digest", "true"), ("pool_header", "pool_digest", "true")),
    Unique("plan: category once", "quotas", "category"),
    Ascending("plan: categories in order", "quotas", "position", "category"),
    Check("plan: quotas", "quotas", "category", "fit > 0 AND tuning > 0 AND selection > 0"),
    SameSet("plan: categories", ("quotas", "category", "true"), ("eligible", "category", "true")),
    Total("plan: quotas use every group", ("quotas", "category", "fit + tuning + selection"), ("eligible", "category", "true")),
    Disjoint("plan: no history", ("eligible", "source", "true"), ("history", "source", "true")),
]
NUISANCE_METADATA = [
    Check("child: fields", "children", "case_id", "extra IS NULL"),
    Check("child: labels", "children", "case_id", "parent_partition = 'FIT' AND test_role = 'QUERY' AND label = 'SYNTHETIC_STIMULUS'"),
    Check("child: source", "children", "case_id", is_digest("source")),
    Check("child: case follows from parent", "children", "case_id", "case_id = parent_case_id || '/stress/' || lpad(cast(variant_id AS string), 2, '0')"),
    Check("child: path follows from case", "children", "case_id", "path = case_id || '.png'"),
    Check("child: encoding", "children", "case_id", "encoding = 'PNG'"),
    Belongs("child: parent", ("children", "parent_case_id", "true"), ("parents", "case_id", "true"), (("parent_source", "source"), ("group_id", "group_id"), ("category", "category"))),
    Belongs("child: variant's family and level", ("children", "variant_id", "true"), ("frozen", "variant_id", "true"), (("family", "family"), ("intensity", "intensity"))),
    Belongs("child: seed", ("children", "case_id", "true"), ("expected", "case_id", "true"), (("seed", "seed"),)),
    *[Unique(f"child: {n} once", "children", k) for n, k in (("case", "case_id"), ("path", "path"), ("parent, family, level", "parent_case_id || '|' || family || '|' || intensity"))],
    Ascending("child: order", "children", "position", "case_id"),
    Covers("child: every variant", ("parents", "case_id", "true"), ("children", "parent_case_id", "true"), "variant_id", VARIANTS),
    Total("package: count", ("parents_count", "''", "expected"), ("children", "''", "true")),
]
RECOVERY_LEDGER = [
    Check("ledger: safe", "header", "document", "NOT authoritative AND NOT production_authorized AND purpose = 'NON_OVERLAP'"),
    Check("ledger: digests", "historical", "source", is_digest("source")),
    Unique("ledger: historical once", "historical", "source"),
    Ascending("ledger: historical order", "historical", "position", "source"),
    Total("ledger: historical count", ("header", "''", "historical_count"), ("historical", "''", "true")),
    Ascending("ledger: excluded order", "excluded", "position", "source"),
    SameSet("ledger: excluded is historical and quarantined", ("excluded", "source", "true"), ("known", "source", "true")),
    Check("ledger: paths", "excluded_paths", "path", is_safe("path")),
    SameSet("ledger: paths are the quarantined", ("excluded_paths", "path", "true"), ("quarantined", "path", "true")),
    Check("allowlist: good and whole", "allowlist", "path", "split = 'train' AND defect = 'good' AND NOT has_mask"),
    Disjoint("allowlist: no excluded path", ("allowlist", "path", "true"), ("excluded_paths", "path", "true")),
    Disjoint("allowlist: no excluded source", ("allowlist", "source", "true"), ("excluded", "source", "true")),
    Belongs("manifest: allowed", ("acquired", "path", "true"), ("allowlist", "path", "true"), (("source", "source"), ("bytes", "bytes"))),
    SameSet("manifest: all acquired", ("acquired", "path", "true"), ("allowlist", "path", "true")),
]

_CELL = ("details", "family", "true")
STRESS_REPORT = [
    Check("condition: counts", "conditions", "family", "n > 0 AND above BETWEEN 0 AND n"),
    Check("condition: rate is above of n", "conditions", "family", "abs(rate - above / nullif(n, 0)) <= 1e-12"),
    Check("condition: signs make n", "conditions", "family", "positive + zero + negative = n"),
    Unique("condition: once", "conditions", "family"),
    SameSet("condition: families", ("conditions", "family", "true"), _CELL),
    Total("condition: n", ("conditions", "family", "n"), _CELL),
    Total("condition: above", ("conditions", "family", "above"), _CELL, "above"),
    Total("condition: positive", ("conditions", "family", "positive"), _CELL, "positive"),
    Total("overall: n", ("overall", "''", "n"), ("details", "''", "true")),
    Total("overall: above", ("overall", "''", "above"), ("details", "''", "true"), "above"),
    Total("overall: n of conditions", ("overall", "''", "n"), ("conditions", "''", "true"), "n"),
]

Digester = Callable[[str], str]
_BLOCK = "'r' || lpad(cast(cast(floor(vec_id / 16) AS bigint) AS string), 6, '0')"
_SHUFFLED = "CASE WHEN document LIKE '%7' AND n = 1 THEN 2 WHEN document LIKE '%7' AND n = 2 THEN 1 ELSE n END AS position"


def _reports(h: Digester) -> dict[str, str]:
    """Reports of 16 parents each, their children, scores and headers; faults by remainders of the parent's number."""
    source = f"'sha256:' || {h('cast(vec_id AS string)')}"
    return {
        "parents": f"""SELECT {_BLOCK} AS document, vec_id AS k, 'c' || lpad(cast(vec_id AS string), 8, '0') AS case_id, 'k' || cast(vec_id % 3 AS string) AS category,
  CASE WHEN vec_id % 41 = 0 THEN 'BLIND' WHEN vec_id % 2 = 0 THEN 'FIT' ELSE 'THRESHOLD_TUNING' END AS role, CASE WHEN vec_id % 43 = 0 THEN 'ANOMALY' ELSE 'NOMINAL' END AS kind,
  CASE WHEN vec_id % 37 = 0 THEN {h('cast(vec_id AS string)')} ELSE {source} END AS source FROM embeddings""",
        "documents_": "SELECT DISTINCT document FROM parents",
        "children": f"""SELECT document, k, case_id || '/aug/0' || CASE WHEN k % 61 = 0 AND v = 2 THEN '1' ELSE cast(v AS string) END AS case_id, CASE WHEN k % 53 = 0 AND v = 3 THEN 'k9' ELSE category END AS category, role, kind,
  'sha256:' || {h("case_id || '|' || cast(v AS string)")} AS source, CASE WHEN k % 19 = 0 AND v = 3 THEN 2 ELSE v END AS variant_id, CASE WHEN k % 31 = 0 AND v = 2 THEN case_id || 'x' ELSE case_id END AS parent_case_id,
  CASE WHEN k % 23 = 0 AND v = 1 THEN 'sha256:' || {h("'other'")} ELSE source END AS parent_source, CASE WHEN k % 97 = 0 AND v = 1 THEN 'sha256:' || {h("'old'")} ELSE 'sha256:' || {h("'recipe'")} END AS recipe
  FROM parents CROSS JOIN (VALUES (1), (2), (3)) AS t(v) WHERE k % 17 <> 0 OR v <> 2""",
        "listed": """SELECT document, k, case_id, category, role, kind, source, false AS is_augmentation, CASE WHEN k % 47 = 0 THEN 1 END AS variant_id, cast(NULL AS string) AS parent_case_id, cast(NULL AS string) AS parent_source,
  cast(NULL AS string) AS recipe, CASE WHEN k % 73 = 0 THEN 'comment' END AS extra FROM parents
UNION ALL SELECT document, k, case_id, category, role, kind, source, true, variant_id, parent_case_id, parent_source, recipe, cast(NULL AS string) FROM children""",
        "features": f"SELECT *, {_SHUFFLED} FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY case_id, variant_id) AS n FROM listed) AS l",
        "calibration": "SELECT * FROM features WHERE role = 'THRESHOLD_TUNING' AND (k % 79 <> 0 OR is_augmentation)",
        "calibration_scores": """SELECT document, k, case_id, CASE WHEN k % 83 = 0 THEN 'FIT' ELSE role END AS role, kind, CASE WHEN k % 61 = 0 THEN 'scratch' ELSE 'good' END AS defect, category, source, is_augmentation,
  variant_id, parent_case_id, parent_source, recipe, extra, CASE WHEN k % 59 = 0 THEN 2.5 WHEN k % 71 = 0 THEN NULL ELSE k % 200 / 100 END AS score FROM features WHERE role = 'THRESHOLD_TUNING' AND k % 67 <> 0""",
        "scores": "SELECT * FROM calibration_scores",
        "header_roles": "SELECT DISTINCT document, role FROM features WHERE role <> 'BLIND' UNION ALL SELECT DISTINCT document, 'EXTRA' FROM features WHERE document LIKE '%5'",
        "sources": "SELECT document, source FROM features UNION ALL SELECT document, parent_source FROM features",
        "ledger": "SELECT DISTINCT document, source FROM features WHERE k % 89 <> 0",
        "gates": """SELECT document, position, extra, limit_p95, limit_max, CASE WHEN document LIKE '%4' AND position = 3 THEN 2 WHEN document LIKE '%3' AND position = 1 THEN 0 ELSE position END AS variant_id
  FROM (SELECT document, v AS position, CASE WHEN document LIKE '%6' AND v = 1 THEN 'note' END AS extra, CASE WHEN document LIKE '%8' AND v = 2 THEN -0.5 ELSE 0.1 END AS limit_p95, 0.2 AS limit_max FROM documents_ CROSS JOIN (VALUES (1), (2), (3)) AS t(v) WHERE document NOT LIKE '%9' OR v <> 1) AS g""",
        "frozen": "SELECT document, v AS variant_id FROM documents_ CROSS JOIN (VALUES (1), (2), (3)) AS t(v)",
        "totals": "SELECT document, count(*) AS features, sum(CASE WHEN role = 'THRESHOLD_TUNING' AND NOT is_augmentation THEN 1 ELSE 0 END) AS originals FROM features GROUP BY document",
        "calibrated": "SELECT document, count(*) AS calibration FROM calibration_scores GROUP BY document",
    }


def _headers(h: Digester) -> str:
    """Headers over the digests of lists, some of which they state wrongly."""
    stated = lambda name, wrong: f"CASE WHEN document LIKE '%{wrong}' THEN {h(repr('wrong'))} ELSE coalesce((SELECT max(digest) FROM digests d WHERE d.document = t.document AND d.name = '{name}'), {h(repr('[]'))}) END AS {name.removesuffix('s') if name == 'features' else name}_identity"
    return f"""SELECT t.document, CASE WHEN t.document LIKE '%3' THEN 1 ELSE 0 END AS blind_count, 0 AS anomaly_count, t.features + CASE WHEN t.document LIKE '%2' THEN 1 ELSE 0 END AS feature_count, coalesce(c.calibration, 0) + CASE WHEN t.document LIKE '%10' THEN 1 ELSE 0 END AS calibration_count,
  t.originals - CASE WHEN t.document LIKE '%1' THEN 1 ELSE 0 END AS originals_count, 'sha256:' || {h("'recipe'")} AS universe_recipe, t.document LIKE '%05' AS authoritative, false AS production_authorized, CASE WHEN t.document LIKE '%06' THEN 'BLIND' ELSE 'NORMAL_ONLY' END AS protocol,
  CASE WHEN t.document LIKE '%08' THEN 'RUN' ELSE 'NOT_RUN' END AS blind_state, 'ORIGINAL_ONLY' AS blind_policy, CASE WHEN t.document LIKE '%09' THEN 'comment' END AS extra,
  {stated('features', 4)}, {stated('calibration', 6)}, {stated('originals', 8)} FROM totals t LEFT JOIN calibrated c ON t.document = c.document""".replace("WHEN document LIKE", "WHEN t.document LIKE")


def _pools(h: Digester) -> dict[str, str]:
    """Pools of 40 parts each; a group is a source's content, so parts of one remainder share it."""
    own = f"{h('cast(p_partkey AS string)')}"
    return {
        "raw": f"SELECT 'p' || lpad(cast(cast(floor(p_partkey / 40) AS bigint) AS string), 6, '0') AS document, p_partkey AS k, 'k' || cast(p_partkey % 3 AS string) AS category, {own} AS hex FROM part",
        "pool": f"""SELECT document, k, category, 'sha256:' || hex AS source, CASE WHEN k % 31 = 0 THEN 'sha256:' || {h("'moved'")} ELSE 'sha256:' || hex END AS expected_source, CASE WHEN k % 37 = 0 THEN 'sha256:' || {h("'changed'")} ELSE 'sha256:' || hex END AS actual_source,
  CASE WHEN k % 41 = 0 THEN 'pool/other/' || hex ELSE 'pool/' || category || '/' || hex END AS case_id, CASE WHEN k % 29 IN (0, 1) THEN 'CONTENT_SHA256:shared' ELSE 'CONTENT_SHA256:' || hex END AS group_id, 'EXACT_CONTENT_ONLY' AS grouping, 'TRAIN_GOOD' AS stratum,
  CASE WHEN k % 43 = 0 THEN '../up.png' WHEN k % 17 = 0 THEN 'same.png' ELSE 'a/' || cast(k AS string) || '.png' END AS path, CASE WHEN k % 53 = 0 THEN '/root.png' ELSE 'r/' || cast(k AS string) || '.png' END AS remote_path,
  CASE WHEN k % 59 = 0 THEN 0 ELSE k + 100 END AS expected_bytes, k + 100 AS actual_bytes, CASE WHEN k % 61 = 0 THEN 'ANOMALY' ELSE 'NOMINAL' END AS kind, 'good' AS defect, CASE WHEN k % 67 = 0 THEN 'note' END AS extra FROM raw""",
        "pool_header": f"SELECT DISTINCT document, {h('document')} AS pool_digest FROM raw",
        "plan": f"SELECT document, CASE WHEN document LIKE '%3' THEN {h(repr('older'))} ELSE pool_digest END AS pool_digest FROM pool_header",
        "history": "SELECT document, source FROM pool WHERE k % 13 = 0",
        "eligible": "SELECT document, category, source FROM pool WHERE k % 13 <> 0 OR k % 26 = 0 AND document LIKE '%5'",
        "counts": "SELECT document, category, count(*) AS n FROM eligible GROUP BY document, category",
        "quotas": """SELECT document, category, n - 3 + CASE WHEN document LIKE '%4' AND category = 'k1' THEN 1 ELSE 0 END AS fit, 2 AS tuning, CASE WHEN document LIKE '%6' AND category = 'k2' THEN 0 ELSE 1 END AS selection,
  CASE WHEN document LIKE '%8' THEN 3 - cast(substr(category, 2, 1) AS int) ELSE 1 + cast(substr(category, 2, 1) AS int) END AS position FROM counts WHERE document NOT LIKE '%2' OR category <> 'k0'""",
    }


def _packages(h: Digester) -> dict[str, str]:
    """Packages of children for 12 parents each."""
    return {
        "parents": f"""SELECT 'n' || lpad(cast(cast(floor(c_custkey / 12) AS bigint) AS string), 6, '0') AS document, c_custkey AS k, 'q' || lpad(cast(c_custkey AS string), 8, '0') AS case_id, 'sha256:' || {h('cast(c_custkey AS string)')} AS source,
  'g' || cast(c_custkey AS string) AS group_id, 'k' || cast(c_custkey % 3 AS string) AS category FROM customer""",
        "frozen": "SELECT document, v AS variant_id, CASE WHEN v = 3 THEN 'SPOT' ELSE 'SCRATCH' END AS family, CASE WHEN v = 2 THEN 'HIGH' ELSE 'LOW' END AS intensity FROM (SELECT DISTINCT document FROM parents) AS d CROSS JOIN (VALUES (1), (2), (3)) AS t(v)",
        "made": "SELECT p.*, f.variant_id AS v, f.family, f.intensity, p.case_id || '/stress/' || lpad(cast(f.variant_id AS string), 2, '0') AS child FROM parents p JOIN frozen f ON p.document = f.document",
        "expected": f"SELECT document, child AS case_id, {h("case_id || '|' || source || '|' || cast(v AS string)")} AS seed FROM made",
        "listed": f"""SELECT document, k, v, CASE WHEN k % 17 = 0 AND v = 2 THEN child || 'x' ELSE child END AS case_id, CASE WHEN k % 19 = 0 AND v = 1 THEN 'q0' ELSE case_id END AS parent_case_id, CASE WHEN k % 23 = 0 AND v = 3 THEN 'sha256:' || {h("'other'")} ELSE source END AS parent_source,
  group_id, category, 'FIT' AS parent_partition, CASE WHEN k % 29 = 0 THEN 'REFERENCE' ELSE 'QUERY' END AS test_role, 'SYNTHETIC_STIMULUS' AS label, v AS variant_id, CASE WHEN k % 31 = 0 AND v = 3 THEN 'SCRATCH' ELSE family END AS family,
  CASE WHEN k % 37 = 0 AND v = 1 THEN 'HIGH' ELSE intensity END AS intensity, CASE WHEN k % 41 = 0 THEN 'same.png' WHEN k % 17 = 0 AND v = 2 THEN child || 'x.png' ELSE child || '.png' END AS path, CASE WHEN k % 43 = 0 THEN 'JPEG' ELSE 'PNG' END AS encoding,
  CASE WHEN k % 47 = 0 AND v = 2 THEN {h("'seed'")} ELSE {h("case_id || '|' || source || '|' || cast(v AS string)")} END AS seed, 'sha256:' || {h('child')} AS source, CASE WHEN k % 53 = 0 THEN 'note' END AS extra FROM made WHERE k % 11 <> 0 OR v <> 3
UNION ALL SELECT document, k, v, child, case_id, source, group_id, category, 'FIT', 'QUERY', 'SYNTHETIC_STIMULUS', v, family, intensity, child || '.png', 'PNG', {h("case_id || '|' || source || '|' || cast(v AS string)")}, 'sha256:' || {h('child')}, cast(NULL AS string) FROM made WHERE k % 59 = 0 AND v = 1""",
        "children": f"SELECT *, {_SHUFFLED} FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY case_id) AS n FROM listed) AS l",
        "parents_count": "SELECT document, 3 * count(*) AS expected FROM parents GROUP BY document",
    }


def _ledgers(h: Digester) -> dict[str, str]:
    """Ledgers of a hundred documents each: historical and quarantined sources, the exclusions stated, an allowlist and what was acquired."""
    return {
        "texts": f"""SELECT 'l' || lpad(cast(cast(floor(doc_id / 100) AS bigint) AS string), 6, '0') AS document, doc_id AS k, 'sha256:' || {h("cast(doc_id AS string) || '|' || coalesce(text, '')")} AS source, 't/' || cast(doc_id AS string) AS path FROM documents""",
        "historical": f"SELECT document, k, CASE WHEN k % 100 = 13 THEN substr(source, 8) ELSE source END AS source, {_SHUFFLED} FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY source) AS n FROM texts WHERE k % 3 = 1) AS l",
        "quarantined": "SELECT document, k, source, path FROM texts WHERE k % 10 = 0",
        "known": "SELECT document, source FROM historical UNION SELECT document, source FROM quarantined",
        "excluded": f"SELECT document, source, {_SHUFFLED} FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY source) AS n FROM (SELECT document, source FROM historical UNION SELECT document, source FROM quarantined WHERE k % 100 <> 50 UNION SELECT document, source FROM texts WHERE k % 100 = 77) AS u) AS l",
        "excluded_paths": "SELECT document, CASE WHEN k % 100 = 20 THEN '../' || path ELSE path END AS path FROM quarantined WHERE k % 100 <> 90",
        "header": "SELECT document, document LIKE '%3' AS authoritative, false AS production_authorized, CASE WHEN document LIKE '%4' THEN 'OTHER' ELSE 'NON_OVERLAP' END AS purpose, count(*) + CASE WHEN document LIKE '%5' THEN 1 ELSE 0 END AS historical_count FROM historical GROUP BY document",
        "allowlist": "SELECT document, path, source, k + 10 AS bytes, 'train' AS split, CASE WHEN k % 100 = 14 THEN 'scratch' ELSE 'good' END AS defect, k % 100 = 26 AS has_mask FROM texts WHERE k % 3 = 2 AND k % 10 <> 0 OR k % 100 = 60 OR k % 100 = 31",
        "acquired": f"SELECT document, path, CASE WHEN bytes % 100 = 39 THEN 'sha256:' || {h("'else'")} ELSE source END AS source, bytes + CASE WHEN bytes % 100 = 45 THEN 1 ELSE 0 END AS bytes FROM allowlist WHERE bytes % 100 <> 51",
    }


def _responses(h: Digester) -> dict[str, str]:
    """Reports of responses by family, with what all families give, over the scores that they were made from."""
    return {
        "details": "SELECT 'e' || lpad(cast(user_id % 60 AS string), 3, '0') AS document, event_type AS family, CASE WHEN value > 50 THEN 1 ELSE 0 END AS above, CASE WHEN value > 20 THEN 1 ELSE 0 END AS positive, CASE WHEN value < 20 THEN 1 ELSE 0 END AS negative FROM events WHERE value IS NOT NULL",
        "truth": "SELECT document, family, count(*) AS n, sum(above) AS above, sum(positive) AS positive, sum(negative) AS negative FROM details GROUP BY document, family",
        "conditions": """SELECT document, family, n + CASE WHEN document LIKE '%3' AND family < 'm' THEN 1 ELSE 0 END AS n, above - CASE WHEN document LIKE '%4' THEN 1 ELSE 0 END AS above, above / n + CASE WHEN document LIKE '%5' THEN 0.000001 ELSE 0 END AS rate,
  positive + CASE WHEN document LIKE '%6' THEN 1 ELSE 0 END AS positive, n - positive - negative AS zero, negative - CASE WHEN document LIKE '%6' THEN 1 ELSE 0 END + CASE WHEN document LIKE '%7' THEN 1 ELSE 0 END AS negative FROM truth WHERE document NOT LIKE '%8' OR family >= 'm'
UNION ALL SELECT document, family, n, above, above / n, positive, n - positive - negative, negative FROM truth WHERE document LIKE '%9' AND family >= 's'
UNION ALL SELECT document, 'other', 0, 0, 0, 0, 0, 0 FROM truth WHERE document LIKE '%10' AND family >= 's'""",
        "overall": "SELECT document, sum(n) + CASE WHEN document LIKE '%2' THEN 2 ELSE 0 END AS n, sum(above) AS above FROM truth GROUP BY document",
    }


def _spark_digest(expression: str) -> str:
    return f"sha2({expression}, 256)"


def _duck_digest(expression: str) -> str:
    return f"sha256({expression})"


#: Family -> (documents, tables that they are made from, rules, whether lists are digested).
FAMILIES: dict[str, tuple[Callable[[Digester], dict[str, str]], tuple[str, ...], Sequence[Rule], bool]] = {
    "normal_evidence_faults": (_reports, ("embeddings",), NORMAL_EVIDENCE, True),
    "score_record_faults": (_reports, ("embeddings",), SCORE_RECORDS, False),
    "historical_report_faults": (_reports, ("embeddings",), HISTORICAL_REPORT, True),
    "pool_plan_faults": (_pools, ("part",), POOL_PLAN, False),
    "nuisance_metadata_faults": (_packages, ("customer",), NUISANCE_METADATA, False),
    "recovery_ledger_faults": (_ledgers, ("documents",), RECOVERY_LEDGER, False),
    "stress_report_faults": (_responses, ("events",), STRESS_REPORT, False),
}


def _used(rules: Sequence[Rule]) -> set[str]:
    return {on for r in rules for on, _ in r.entries()}


def _collections(s: SparkSession, d: str, family: str) -> dict[str, DataFrame]:
    """The family's documents; what rules or later tables read more than once is written."""
    made, tables, rules, digested = FAMILIES[family]
    known = {t: table(s, d, t) for t in tables}
    wanted = _used(rules) | ({"features"} if digested else set())
    for name, text in made(_spark_digest).items():
        frame = s.sql(_framed(text, known), **{f"t_{n}": f for n, f in known.items() if f"{{t_{n}}}" in _framed(text, known)})
        known[name] = materialize(frame, name) if name in wanted or name in ("totals", "calibrated", "listed", "raw", "texts", "parents") else frame
    if digested:
        known["digests"] = materialize(listed_digests(known["features"], "position", IDENTITY, LISTS), "list-digests")
        text = _headers(_spark_digest)
        known["header"] = materialize(s.sql(_framed(text, known), **{f"t_{n}": f for n, f in known.items() if f"{{t_{n}}}" in _framed(text, known)}), "headers")
    return {n: known[n] for n in wanted if n in known}


def _framed(text: str, known: Mapping[str, DataFrame]) -> str:
    """SQL whose tables after FROM and JOIN are {t_name} places for frames."""


    return re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{t_{m[2]}}}" if m[2] in known else m[0], text)


def _query(family: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        return violations(_collections(s, d, family), FAMILIES[family][2])

    run.__name__ = family
    return run


def list_digests(s: SparkSession, d: str) -> DataFrame:
    """Digests of the lists of all reports, as canonical JSON gives them."""
    return _collections(s, d, "normal_evidence_faults")["digests"]


QUERIES = {f: _query(f) for f in FAMILIES} | {"list_digests": list_digests}


# Oracles.


def _json(column: str, name: str) -> str:
    text = f"CAST({column} AS VARCHAR)" if name in ("isAugmentation", "variantId") else f"'\"' || {column} || '\"'"
    return f"'\"{name}\":' || coalesce({text}, 'null')"


def _digests_sql() -> str:
    record = "'{' || " + " || ',' || ".join(_json(c, n) for n, c in IDENTITY.items()) + " || '}'"
    return " UNION ALL ".join(f"SELECT document, '{n}' AS name, sha256('[' || string_agg({record}, ',' ORDER BY position) || ']') AS digest FROM features WHERE {w} GROUP BY document" for n, w in LISTS.items())


def _text(columns: Sequence[str]) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '-')" for c in columns) + ")" if columns else "''"


def _side(side: tuple[str, str, str], columns: Sequence[str] = (), weight: str = "1") -> str:
    on, key, where = side
    return f"(SELECT document, coalesce(CAST({key} AS VARCHAR), 'null') AS key, count(*) AS n, sum({weight}) AS total, min({_text(columns)}) AS low, max({_text(columns)}) AS high FROM {on} WHERE {where} GROUP BY ALL)"


def rule_sql(rule: Rule) -> str:
    """DuckDB SQL of one rule's faults."""
    give = lambda on, problem, n, key="key": f"SELECT document, '{rule.name.replace(chr(39), chr(39) * 2)}' AS rule, '{on}[' || {key} || ']' AS path, {problem} AS problem, CAST({n} AS BIGINT) AS n"
    match rule:
        case Check():
            return f"{give(rule.on, repr('BROKEN'), 'n')} FROM {_side((rule.on, rule.key, f'({rule.where}) AND NOT coalesce({rule.holds}, false)'))}"
        case Unique():
            return f"{give(rule.on, repr('REPEATED'), 'n')} FROM {_side((rule.on, rule.key, f'({rule.where}) AND ({rule.key}) IS NOT NULL'))} WHERE n > 1"
        case Constant():
            return f"{give(rule.on, repr('DIFFERS'), 'n')} FROM {_side((rule.on, rule.key, rule.where), rule.same)} WHERE low <> high"
        case Ascending():
            inner = f"SELECT document, CAST({rule.position} AS VARCHAR) AS key, {rule.value} AS value, lag({rule.value}) OVER (PARTITION BY document ORDER BY {rule.position}) AS before, {rule.position} - lag({rule.position}) OVER (PARTITION BY document ORDER BY {rule.position}) AS step FROM {rule.on}"
            return f"{give(rule.on, repr('UNORDERED'), '2')} FROM ({inner}) WHERE step = 1 AND value <= before"
        case SameSet():
            both = f"SELECT coalesce(l.document, r.document) AS document, coalesce(l.key, r.key) AS key, l.n AS a, r.n AS b FROM {_side(rule.left)} l FULL JOIN {_side(rule.right)} r ON l.document = r.document AND l.key = r.key"
            problem = "CASE WHEN a IS NULL THEN 'MISSING' ELSE 'UNKNOWN' END"
            return f"{give(rule.left[0], problem, 'coalesce(a, b)')} FROM ({both}) WHERE a IS NULL OR b IS NULL"
        case Disjoint():
            return f"{give(rule.left[0], repr('REPEATED'), 'l.n + r.n')} FROM {_side(rule.left)} l JOIN {_side(rule.right)} r USING (document, key)"
        case Belongs():
            child, parent = _side(rule.child, [a for a, _ in rule.same]), _side(rule.parent, [b for _, b in rule.same])
            both = f"SELECT l.document, l.key, l.n AS a, r.n AS b, l.low <> r.low OR l.high <> r.high AS wrong FROM {child} l LEFT JOIN {parent} r ON l.document = r.document AND l.key = r.key"
            problem = "CASE WHEN b IS NULL THEN 'UNKNOWN' ELSE 'DIFFERS' END"
            return f"{give(rule.child[0], problem, 'a + coalesce(b, 0)')} FROM ({both}) WHERE b IS NULL OR wrong"
        case Covers():
            values = ", ".join(f"('{v}')" for v in rule.variants)
            want = f"(SELECT document, {rule.parent[1]} || '#' || v AS key, count(*) AS n FROM {rule.parent[0]}, (VALUES {values}) t(v) WHERE {rule.parent[2]} GROUP BY ALL)"
            have = f"(SELECT document, {rule.child[1]} || '#' || CAST({rule.variant} AS VARCHAR) AS key, count(*) AS n FROM {rule.child[0]} WHERE {rule.child[2]} GROUP BY ALL)"
            both = f"SELECT coalesce(w.document, h.document) AS document, coalesce(w.key, h.key) AS key, w.n AS a, h.n AS b FROM {want} w FULL JOIN {have} h ON w.document = h.document AND w.key = h.key"
            problem = "CASE WHEN a IS NULL THEN 'UNKNOWN' WHEN b IS NULL THEN 'MISSING' ELSE 'REPEATED' END"
            return f"{give(rule.parent[0], problem, 'coalesce(a, 0) + coalesce(b, 0)')} FROM ({both}) WHERE a IS NULL OR b IS NULL OR b > 1"
        case Total():
            on, key, stated = rule.header
            head = f"(SELECT document, coalesce(CAST({key} AS VARCHAR), 'null') AS key, {stated} AS stated FROM {on})"
            both = f"SELECT coalesce(s.document, h.document) AS document, coalesce(s.key, h.key) AS key, stated, coalesce(n, 0) AS n, coalesce(total, 0) AS total, h.document IS NOT NULL AS said FROM {head} h FULL JOIN {_side(rule.of, weight=rule.weight)} s ON s.document = h.document AND s.key = h.key"
            return f"{give(rule.header[0], repr('COUNT'), 'n + CAST(said AS INTEGER)')} FROM ({both}) WHERE stated IS NULL OR stated <> total"
        case Digest():
            both = f"SELECT h.document, '{rule.list_name}' AS key, {rule.header[1]} AS stated, digest FROM {rule.header[0]} h LEFT JOIN digests d ON d.document = h.document AND d.name = '{rule.list_name}'"
            return f"{give(rule.header[0], repr('DIFFERS'), '1 + CAST(digest IS NOT NULL AS INTEGER)')} FROM ({both}) WHERE stated IS NULL OR stated <> coalesce(digest, sha256('[]'))"
    raise TypeError(type(rule))


def _oracle(family: str) -> str:
    made, _, rules, digested = FAMILIES[family]
    tables = made(_duck_digest) | ({"digests": _digests_sql(), "header": _headers(_duck_digest)} if digested else {})
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in tables.items()) + "\n" + "\nUNION ALL ".join(map(rule_sql, rules))


def _list_digests_sql() -> str:
    made = _reports(_duck_digest)
    return "WITH " + ",\n".join(f"{n} AS ({made[n]})" for n in ("parents", "children", "listed", "features")) + "\n" + _digests_sql()


ORACLES = {f: _oracle(f) for f in FAMILIES} | {"list_digests": _list_digests_sql()}
