"""DuckDB SQL of the registered queries."""

from __future__ import annotations

CASES = """
ranked AS (
  SELECT label AS category, vec_id AS case_id, embedding::DOUBLE[] AS v,
         row_number() OVER (PARTITION BY label ORDER BY sha256('case|' || label || '|' || vec_id), vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n
  FROM embeddings),
roles AS (
  SELECT category, case_id, v, CASE WHEN r * 10 < 4 * n THEN 'FIT' WHEN r * 10 < 7 * n THEN 'THRESHOLD_TUNING' ELSE 'BLIND' END AS role FROM ranked),
cases AS (
  SELECT *, CASE WHEN role = 'BLIND' AND case_id % 3 = 0 THEN 'ANOMALY' ELSE 'NOMINAL' END AS kind FROM roles)"""
COSINE = "least(2.0, greatest(0.0, 1 - list_cosine_similarity({a}, {b})))"


def scores(bank: str, name: str = "scores") -> str:
    return f"""
{name} AS (
  SELECT q.category, q.case_id, q.role, q.kind, round(min({COSINE.format(a="q.v", b="b.v")}), 6) AS score
  FROM cases q JOIN {bank} b ON q.category = b.category WHERE q.role <> 'FIT' GROUP BY ALL)"""


def spaced(source: str, order: str, maximum: int, name: str) -> str:
    return f"""
{name} AS (
  SELECT * EXCLUDE (total) FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {order}) - 1 AS position, count(*) OVER (PARTITION BY category) AS total FROM {source})
  WHERE total <= {maximum} OR position IN (SELECT ((2 * k + 1) * total) // (2 * {maximum}) FROM range({maximum}) t(k)))"""


FIT = "fit AS (SELECT * FROM cases WHERE role = 'FIT')"
SCORED = f"WITH {CASES}, {FIT}, {scores('fit')}"
P95 = "list_sort(list({x}))[CAST(ceil(count({x}) * 0.95) AS BIGINT)]"
UPPER = "list_sort(list({x}))[count({x}) // 2 + 1]"
RAW_AUROC = """SELECT {by}, sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS auroc FROM (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
    SELECT {by}, {x} AS x, count(*) FILTER ({positive}) AS pos, count(*) FILTER (NOT ({positive})) AS neg FROM {source} GROUP BY ALL)) GROUP BY {by}"""
AUROC = f"SELECT {{by}}, round(auroc, 6) AS auroc FROM ({RAW_AUROC})"
LABELLED = "(SELECT lang, n_chars, toxic FROM documents JOIN labels USING (doc_id))"
LINES = """
lines AS (
  SELECT o_orderpriority AS category, l_linenumber AS variant, l_returnflag AS family, l_linestatus AS level,
         round(l_extendedprice / 1000 - o_totalprice / 10000, 6) AS delta, l_extendedprice > 50000 AS above
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
BOXES = """
boxes AS (
  SELECT p_partkey, p_partkey % 97 AS image, p_partkey % 400 AS x, p_partkey * 7 % 300 AS y, p_size * 4 + 20 AS width, p_size % 9 * 30 + 20 AS height FROM part)"""
DEFECT = "CASE WHEN kind = 'ANOMALY' THEN 'd' || (case_id % 2) ELSE 'good' END"
REPORTS = f"""WITH {CASES}, {FIT}, {spaced('fit', 'case_id', 8, 'small')}, {scores('fit', 'one')}, {scores('small', 'two')},
deltas AS (
  SELECT a.case_id, a.category, a.role, a.kind, {DEFECT.replace('kind', 'a.kind').replace('case_id', 'a.case_id')} AS defect, a.score AS baseline_score, b.score AS candidate_score, b.score - a.score AS delta
  FROM one a JOIN two b USING (case_id))"""


def _median(x: str) -> str:
    return f"round(quantile_cont({x}, 0.5), 6)"

def _affine_fits() -> str:
    """Four passes, each a fit, the median of its residuals, and their median distance to it."""
    parts = ["p0 AS (SELECT o_custkey AS image, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y, true AS kept FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)"]
    for k in range(4):
        before = f" OR (SELECT poor FROM f{k - 1} g WHERE g.image = p.image)" if k else ""
        parts.append(f"f{k} AS (SELECT image, regr_slope(y, x) FILTER (kept) AS slope, regr_intercept(y, x) FILTER (kept) AS intercept, count(*) FILTER (kept) < 16 OR coalesce(max(x) FILTER (kept) <= min(x) FILTER (kept), true){before} AS poor FROM p{k} p GROUP BY image)")
        if k < 3:
            parts.append(f"r{k} AS (SELECT p.*, y - (slope * x + intercept) AS off FROM p{k} p JOIN f{k} USING (image) WHERE NOT poor)")
            parts.append(f"m{k} AS (SELECT image, quantile_cont(off, 0.5) FILTER (kept) AS middle FROM r{k} GROUP BY 1)")
            parts.append(f"d{k} AS (SELECT r.*, abs(off - middle) AS far FROM r{k} r JOIN m{k} USING (image))")
            parts.append(f"s{k} AS (SELECT image, quantile_cont(far, 0.5) FILTER (kept) AS spread FROM d{k} GROUP BY 1)")
            parts.append(f"p{k + 1} AS (SELECT image, x, y, CASE WHEN spread <= 1e-12 THEN kept ELSE far <= greatest(3.5 * 1.4826::DOUBLE * spread, 1e-10) END AS kept FROM d{k} JOIN s{k} USING (image))")
    return f"WITH {', '.join(parts)} SELECT i.image, CASE WHEN NOT poor AND slope > 0 THEN round(slope, 6) END AS slope, CASE WHEN NOT poor AND slope > 0 THEN round(intercept, 6) END AS intercept FROM (SELECT DISTINCT image FROM p0) i LEFT JOIN f3 USING (image)"


def _starts(at: str, length: str) -> str:
    stride = "(0.7 * seen)"
    last = f"greatest(ceil(({length} - seen) / {stride}) - 1, 0)"
    closing = f"CASE WHEN {at} + {length} - seen - ({at} + {last} * {stride}) > 1e-6 THEN [{at} + {length} - seen] ELSE [] END"
    return f"CASE WHEN {length} <= seen THEN [{at} + ({length} - seen) / 2] ELSE list_concat(list_transform(range(0, CAST({last} AS BIGINT) + 1), lambda i: {at} + i * {stride}), {closing}) END"


ORACLES: dict[str, str] = {
    "global_knn_scores": f"{SCORED} SELECT * FROM scores",
    "calibrated_thresholds": f"{SCORED} SELECT category, max(score) AS threshold FROM scores WHERE role = 'THRESHOLD_TUNING' GROUP BY 1",
    "blind_metric_summary": f"""{SCORED},
limits AS (SELECT category, max(score) AS threshold FROM scores WHERE role = 'THRESHOLD_TUNING' GROUP BY 1),
blind AS (SELECT * FROM scores JOIN limits USING (category) WHERE role = 'BLIND'),
curve AS ({AUROC.format(by="category", x="score", positive="kind = 'ANOMALY'", source="blind")})
SELECT category, count(*) AS cases, count(*) FILTER (kind = 'NOMINAL') AS nominal_cases, count(*) FILTER (kind = 'ANOMALY') AS anomaly_cases, max(threshold) AS threshold,
       round(count(*) FILTER (kind = 'NOMINAL' AND score > threshold) / nullif(count(*) FILTER (kind = 'NOMINAL'), 0), 6) AS nominal_above_rate,
       round(count(*) FILTER (kind = 'ANOMALY' AND score > threshold) / nullif(count(*) FILTER (kind = 'ANOMALY'), 0), 6) AS anomaly_above_rate, max(auroc) AS auroc
FROM blind JOIN curve USING (category) GROUP BY category""",
    "normal_calibration_summary": f"""{SCORED},
tuning AS (SELECT category, score, CASE WHEN case_id % 2 = 0 THEN 'original' ELSE 'augmented' END AS part FROM scores WHERE role = 'THRESHOLD_TUNING'),
every AS (SELECT * FROM tuning UNION ALL SELECT category, score, 'all' FROM tuning)
SELECT category, part, count(*) AS n, {UPPER.format(x="score")} AS median, {P95.format(x="score")} AS p95, max(score) AS max FROM every GROUP BY 1, 2""",
    "image_auroc": AUROC.format(by="lang", x="n_chars", positive="toxic = 1", source=LABELLED),
    "binned_auroc": AUROC.format(by="lang", x="n_chars // 100", positive="toxic = 1", source=LABELLED),
    "confusion_by_family": """
WITH e AS (SELECT event_id, user_id % 5 AS category, event_type, value, count(*) OVER (PARTITION BY user_id % 5) AS n,
  row_number() OVER (PARTITION BY user_id % 5 ORDER BY sha256('calibration|' || event_id), event_id) - 1 AS r FROM events WHERE value IS NOT NULL),
limits AS (SELECT category, max(value) / 4 AS threshold FROM e WHERE r * 20 < n GROUP BY 1),
j AS (SELECT * FROM e JOIN limits USING (category) WHERE r * 20 >= n),
nominal AS (SELECT category, count(*) FILTER (value > threshold) AS fp, count(*) FILTER (value <= threshold) AS tn FROM j WHERE event_id % 2 = 0 GROUP BY 1),
own AS (SELECT category, event_type, count(*) FILTER (value > threshold) AS tp, count(*) FILTER (value <= threshold) AS fn FROM j WHERE event_id % 2 = 1 GROUP BY 1, 2),
m AS (SELECT category, event_type, tp, coalesce(fp, 0) AS fp, fn, coalesce(tn, 0) AS tn FROM own LEFT JOIN nominal USING (category)),
pr AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM m)
SELECT category, event_type, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM pr""",
    "evenly_spaced_bank": f"WITH e AS (SELECT label AS category, vec_id AS case_id FROM embeddings), {spaced('e', 'case_id', 16, 'bank')} SELECT category, case_id, position FROM bank",
    "stratified_bank": """
WITH r AS (SELECT label AS stratum, vec_id AS case_id, row_number() OVER (PARTITION BY label ORDER BY sha256('stratum|' || vec_id), vec_id) AS n FROM embeddings),
o AS (SELECT stratum, case_id, row_number() OVER (ORDER BY n, stratum) - 1 AS position FROM r)
SELECT * FROM o WHERE position < 64""",
    "patch_knn": f"""WITH {CASES},
p AS (SELECT category, case_id, role, case_id * 16 + i AS key, v[4 * i + 1 : 4 * i + 4] AS w FROM cases, range(16) t(i)),
fit AS (SELECT * FROM p WHERE role = 'FIT'), {spaced('fit', 'key', 64, 'bank')},
near AS (SELECT q.category, q.case_id, q.key, min({COSINE.format(a="q.w", b="b.w")}) AS d FROM p q JOIN bank b ON q.category = b.category WHERE q.role <> 'FIT' GROUP BY ALL)
SELECT category, case_id, round(list_avg(list_reverse_sort(list(d))[1:4]), 6) AS score, round(max(d), 6) AS max_patch_distance, round(avg(d), 6) AS mean_patch_distance FROM near GROUP BY 1, 2""",
    "quota_allocation": """
WITH r AS (SELECT c_mktsegment AS category, c_custkey AS group_id, count(*) OVER (PARTITION BY c_mktsegment) AS n,
  row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('quota|' || c_mktsegment || '|' || c_custkey), c_custkey) - 1 AS rank FROM customer)
SELECT category, group_id, rank, CASE WHEN rank < 4 * n // 10 THEN 'FIT' WHEN rank < 4 * n // 10 + 2 * n // 10 THEN 'THRESHOLD_TUNING' WHEN rank < 4 * n // 10 + 2 * n // 10 + n // 10 THEN 'NORMAL_SELECTION'
  WHEN rank < 4 * n // 10 + 2 * n // 10 + n // 10 + n // 10 THEN 'NORMAL_CONFIRMATION' ELSE 'RESERVE_UNTOUCHED' END AS partition FROM r""",
    "history_group_anti_join": """
SELECT l_orderkey AS group_id, l_linenumber, sha256(l_orderkey || '|' || l_linenumber) AS digest FROM lineitem
WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE sha256(l_orderkey || '|' || l_linenumber) IN (SELECT sha256(l_orderkey || '|' || l_linenumber) FROM lineitem WHERE l_returnflag = 'R'))""",
    "history_counts": """
WITH l AS (SELECT l_orderkey AS g, sha256(l_orderkey || '|' || l_linenumber) AS x, l_returnflag FROM lineitem),
m AS (SELECT * FROM l WHERE x IN (SELECT x FROM l WHERE l_returnflag = 'R'))
SELECT (SELECT count(*) FROM m) AS matched_sources, (SELECT count(DISTINCT g) FROM m) AS excluded_groups, (SELECT count(*) FROM l WHERE g NOT IN (SELECT g FROM m)) AS eligible_sources""",
    "role_disjointness": "SELECT sha256(text) AS group_id, count(DISTINCT doc_id % 3) AS roles FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1",
    "paired_delta_grouping_sets": f"""WITH {LINES}
SELECT category, coalesce(variant, 0) AS variant, CASE WHEN grouping(variant) = 1 THEN 'category' ELSE 'category,variant' END AS grain, count(*) AS n, round({P95.format(x="delta")}, 6) AS p95, round(max(delta), 6) AS max
FROM lines GROUP BY GROUPING SETS ((category), (category, variant))""",
    "delta_summary": f"""WITH {LINES}
SELECT category, count(*) AS pairs, round(avg(delta), 6) AS mean, {_median("delta")} AS median, round(min(delta), 6) AS minimum, round(max(delta), 6) AS maximum,
       count(*) FILTER (delta > 0) AS positive, count(*) FILTER (delta = 0) AS zero, count(*) FILTER (delta < 0) AS negative, round(count(*) FILTER (delta > 0) / count(*), 6) AS positive_rate
FROM lines GROUP BY 1""",
    "stress_multi_grain": f"""WITH {LINES},
raws AS (SELECT o_orderpriority AS category, count(*) AS raw, count(*) FILTER (o_totalprice > 200000) AS raw_above FROM orders GROUP BY 1)
SELECT category, family, level, count(*) AS stimuli, count(*) FILTER (above) AS stimuli_above, round(count(*) FILTER (above) / count(*), 6) AS stimuli_rate, max(raw) AS raw, max(raw_above) AS raw_above,
       round(max(raw_above) / max(raw), 6) AS raw_rate, round(avg(delta), 6) AS mean_delta, round(min(delta), 6) AS min_delta, round(max(delta), 6) AS max_delta,
       count(*) FILTER (delta > 0) AS positive, count(*) FILTER (delta = 0) AS zero
FROM lines JOIN raws USING (category) GROUP BY GROUPING SETS ((category), (category, family), (category, level), (category, family, level))""",
    "nuisance_contrast": """
WITH p AS (SELECT user_id, avg(value) AS parent_score FROM events GROUP BY 1),
d AS (SELECT user_id, parent_score, event_type < 'p' AS control, value - parent_score AS delta FROM events JOIN p USING (user_id)),
s AS (SELECT user_id, max(parent_score) AS parent_score, count(*) FILTER (control) AS control_count, avg(delta) FILTER (control) AS c, count(*) FILTER (NOT control) AS stimulus_count, avg(delta) FILTER (NOT control) AS t FROM d GROUP BY 1)
SELECT user_id, round(parent_score, 6) AS parent_score, control_count, round(c, 6) AS control_delta, stimulus_count, round(t, 6) AS stimulus_delta, round(t - c, 6) AS contrast FROM s WHERE c IS NOT NULL AND t IS NOT NULL""",
    "report_case_deltas": f"{REPORTS} SELECT case_id, category, role, kind, defect, round(baseline_score, 6) AS baseline_score, round(candidate_score, 6) AS candidate_score, round(delta, 6) AS delta FROM deltas",
    "report_categories": f"""{REPORTS},
c1 AS ({RAW_AUROC.format(by="category", x="baseline_score", positive="kind = 'ANOMALY'", source="(SELECT * FROM deltas WHERE role = 'BLIND')")}),
c2 AS ({RAW_AUROC.format(by="category", x="candidate_score", positive="kind = 'ANOMALY'", source="(SELECT * FROM deltas WHERE role = 'BLIND')")}),
t AS (SELECT category, max(baseline_score) AS b, max(candidate_score) AS c FROM deltas WHERE role = 'THRESHOLD_TUNING' GROUP BY 1)
SELECT category, count(*) AS cases, round(avg(delta), 6) AS mean, {_median("delta")} AS median, round(max(b), 6) AS baseline_threshold, round(max(c), 6) AS candidate_threshold, round(max(c1.auroc), 6) AS baseline_auroc, round(max(c2.auroc), 6) AS candidate_auroc,
       round(max(c2.auroc) - max(c1.auroc), 6) AS auroc_delta, round(max(c) - max(b), 6) AS threshold_delta
FROM deltas JOIN t USING (category) JOIN c1 USING (category) JOIN c2 USING (category) GROUP BY category""",
    "report_defects": f"{REPORTS} SELECT category, defect, count(*) AS cases, round(avg(delta), 6) AS mean, {_median('delta')} AS median FROM deltas WHERE role = 'BLIND' AND kind = 'ANOMALY' GROUP BY 1, 2",
    "coverage_violations": """
WITH expected AS (SELECT user_id, event_type FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT event_type FROM events)),
seen AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type, CASE WHEN n IS NULL THEN 'MISSING' ELSE 'DUPLICATE' END AS problem FROM expected LEFT JOIN seen USING (user_id, event_type) WHERE n IS NULL OR n > 1""",
    "mean_references": "SELECT label, CAST(i AS BIGINT) AS i, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1, 2",
    "nearest_reference": f"""
WITH m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1, 2),
g AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY 1),
e AS (SELECT vec_id AS case_id, embedding::DOUBLE[] AS v, vec_id % 11 <> 0 AS a, vec_id % 7 <> 0 AS b FROM embeddings),
d AS (SELECT case_id, label, {COSINE.format(a="e.v", b="g.v")} AS d FROM e, g WHERE a AND b),
s AS (SELECT case_id, first(label ORDER BY d, label) AS nearest_id, round(min(d), 6) AS nearest_distance, round(avg(d), 6) AS global_distance, round(least(1.0, max(d) - min(d)), 6) AS uncertainty FROM d GROUP BY 1)
SELECT case_id, CASE WHEN a THEN 'PASSED' ELSE 'FAILED' END AS "DIGEST_state", CASE WHEN NOT a THEN 'NOT_RUN' WHEN b THEN 'PASSED' ELSE 'FAILED' END AS "ALIGNMENT_state",
       CASE WHEN a AND b THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS state, CASE WHEN NOT a THEN 'DIGEST' WHEN NOT b THEN 'ALIGNMENT' END AS reason, coalesce(nearest_id, -1) AS nearest_id, nearest_distance, global_distance, uncertainty,
       CASE WHEN nearest_distance >= 0.9 THEN 'HIGH' WHEN nearest_distance >= 0.7 THEN 'REVIEW' ELSE 'LOW' END AS priority
FROM e LEFT JOIN s USING (case_id)""",
    "still_gate": """
WITH w AS (SELECT p_partkey, concat_ws(',', CASE WHEN p_retailprice < 1200 THEN 'BLUR' END, CASE WHEN p_size / 50.0 > 0.8 THEN 'OVEREXPOSED' END, CASE WHEN p_partkey % 40 < 8 THEN 'CORNERS' END) AS reasons FROM part)
SELECT p_partkey, reasons, reasons = '' AS passed FROM w""",
    "touching_regions": f"""WITH {BOXES}
SELECT p_partkey, image FROM boxes a WHERE p_partkey % 2 = 0 AND EXISTS (SELECT 1 FROM boxes b WHERE b.p_partkey % 2 = 1 AND a.image = b.image
  AND a.x < b.x + b.width AND b.x < a.x + a.width AND a.y < b.y + b.height AND b.y < a.y + a.height)""",
    "densest_window": """
WITH w AS (SELECT event_type, value AS start, count(*) OVER (PARTITION BY event_type ORDER BY value RANGE BETWEEN CURRENT ROW AND 5.0 FOLLOWING) AS n FROM events WHERE value IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, start DESC) AS k FROM w)
SELECT event_type, start, n FROM r WHERE k = 1""",
    "content_duplicates": """
SELECT 'documents' AS source, sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'pages', sha256(html), count(*) FROM pages GROUP BY 2 HAVING count(*) > 1""",
    "score_quantiles": f"""SELECT event_type, count(value) AS n, round({P95.format(x="value")}, 6) AS p95, round({UPPER.format(x="value")}, 6) AS upper_median, {_median("value")} AS median, round(quantile_cont(value, 0.95), 6) AS q95
FROM events WHERE value IS NOT NULL GROUP BY 1""",
    "aupro": """
WITH p AS (SELECT event_type AS category, floor(value) AS score, CASE WHEN user_id % 3 = 0 THEN user_id % 7 END AS region FROM events),
sizes AS (SELECT category, region, count(*) AS size FROM p WHERE region IS NOT NULL GROUP BY 1, 2),
e AS (SELECT p.category, score, count(*) FILTER (p.region IS NULL) AS fp, coalesce(sum(1.0 / size), 0) AS pro FROM p LEFT JOIN sizes s ON p.category = s.category AND p.region = s.region GROUP BY 1, 2),
n AS (SELECT category, count(*) FILTER (region IS NULL) AS normal, count(DISTINCT region) AS regions FROM p GROUP BY 1),
c AS (SELECT category, sum(fp) OVER w / normal AS x1, (sum(fp) OVER w - fp) / normal AS x0, sum(pro) OVER w / regions AS y1, (sum(pro) OVER w - pro) / regions AS y0
  FROM e JOIN n USING (category) WINDOW w AS (PARTITION BY category ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, CASE WHEN x1 > x0 THEN least(1.0, (0.3 - x0) / (x1 - x0)) ELSE 0 END AS share FROM c WHERE x0 < 0.3)
SELECT category, round(sum((x1 - x0) * share * (y0 + y0 + share * (y1 - y0)) / 2) / 0.3, 6) AS aupro FROM f GROUP BY 1""",
    "augmentation_plan": """
SELECT vec_id AS case_id, k AS variant_id, vec_id || '/augmented/' || lpad(CAST(k AS VARCHAR), 2, '0') AS child_case_id,
       CAST(CAST('0x' || substr(sha256('recipe' || chr(0) || vec_id || chr(0) || sha256(CAST(vec_id AS VARCHAR)) || chr(0) || k), 1, 16) AS UBIGINT) AS VARCHAR) AS seed
FROM embeddings, range(1, 4) t(k)""",
    "roi_tiles": f"""WITH {BOXES},
r AS (SELECT p_partkey, x * 2.0::DOUBLE AS x, y * 2.0::DOUBLE AS y, width * 2.0::DOUBLE AS w, height * 2.0::DOUBLE AS h, ceil(least(384, 1280, 960, greatest(224.0, 1.25 * least(width * 2.0::DOUBLE, height * 2.0::DOUBLE)))) AS side FROM boxes),
s AS (SELECT *, side * 224 / 256.0 AS seen, (side - side * 224 / 256.0) / 2 AS edge FROM r),
a AS (SELECT p_partkey, side, edge, unnest({_starts("x", "w")}) AS ax, {_starts("y", "h")} AS ys FROM s),
b AS (SELECT p_partkey, side, edge, ax, unnest(ys) AS ay FROM a),
t AS (SELECT DISTINCT p_partkey, CAST(greatest(0, least(1280 - side, round_even(ax - edge, 0))) AS INTEGER) AS x, CAST(greatest(0, least(960 - side, round_even(ay - edge, 0))) AS INTEGER) AS y, CAST(side AS INTEGER) AS side FROM b)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY y, x, side) - 1 AS INTEGER) AS n, x, y, side FROM t""",
    "difference_regions": """
WITH RECURSIVE cells AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i) WHERE embedding[i + 1]::DOUBLE >= 0.1),
reach AS (
  SELECT vec_id, i AS a, i AS b FROM cells
  UNION SELECT x.vec_id, x.a, z.i FROM reach x JOIN cells y ON y.vec_id = x.vec_id AND y.i = x.b JOIN cells z ON z.vec_id = y.vec_id AND abs(z.r - y.r) <= 1 AND abs(z.c - y.c) <= 1),
least AS (SELECT vec_id, b AS i, min(a) AS first FROM reach GROUP BY 1, 2),
found AS (SELECT vec_id, first, count(*) AS area, min(c) AS x, min(r) AS y, max(c) - min(c) + 1 AS width, max(r) - min(r) + 1 AS height, least(1, greatest(0, max(v) / 2)) AS peak, least(1, greatest(0, avg(v) / 2)) AS mean
  FROM cells JOIN least USING (vec_id, i) GROUP BY 1, 2),
named AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY first) AS label FROM found),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY peak DESC, area DESC, label) AS rank FROM named)
SELECT vec_id, CAST(label AS INTEGER) AS label, CAST(area AS INTEGER) AS area, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, round(peak, 6) AS peak, round(mean, 6) AS mean,
  CAST(rank AS INTEGER) AS rank, 'R-' || lpad(CAST(rank AS VARCHAR), 3, '0') AS region_id FROM ranked WHERE rank <= 3""",
    "affine_fits": _affine_fits(),
}
