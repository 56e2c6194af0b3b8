"""DuckDB oracle SQL for the plans over stored records."""

from __future__ import annotations

from skillgrid.plans import oracle_demand, oracle_ops, oracle_publish, oracle_text
from skillgrid.plans.oracle_demand import RATIO4
from skillgrid.plans.sqlfrag import key

DATASET_REGISTRY = """
WITH f AS (
  SELECT concat_ws('/', 'postings', o_orderstatus, strftime(o_orderdate, '%Y-%m')) AS path, o_orderstatus AS source,
         CAST(o_orderdate AS DATE) AS d
  FROM orders
)
SELECT DISTINCT sha256(path) AS dataset_id, path, source, 'uploaded' AS status FROM f
WHERE path NOT IN (SELECT path FROM f WHERE d < DATE '1996-01-01')
"""

DECAYING_HISTORY = f"""
SELECT role_id, skill_id, snapshot_date, requirement_version, demand_index FROM ({oracle_demand.MONTHLY_SERIES}) s
WHERE (role_id, skill_id) IN (SELECT (role_id, skill_id) FROM ({oracle_demand.DECAY_SIGNALS}) g)
"""

RUN_EVIDENCE = f"""
SELECT role_id, skill_id, evidence_count, prior_evidence, cumulative_evidence, threshold_met
FROM ({oracle_demand.CUMULATIVE}) x WHERE period_month = DATE '1995-06-01'
"""

EVIDENCE_REWRITES = f"""
SELECT period_month, role_id, skill_id, evidence_count FROM ({oracle_demand.CUMULATIVE}) x
WHERE period_month >= DATE '1995-06-01' AND period_month < DATE '1995-09-01'
"""

JOB_EVIDENCE_SUMMARY = f"""
SELECT period_month, count(*) AS evidence_rows, CAST(sum(evidence_count) AS BIGINT) AS evidence_count,
       CAST(count_if(threshold_met) AS BIGINT) AS pairs_meeting_threshold,
       CAST(count_if(NOT threshold_met) AS BIGINT) AS pairs_below_threshold
FROM ({oracle_demand.CUMULATIVE}) x GROUP BY period_month
"""

RUN_COUNTERS = f"""
WITH q AS ({oracle_ops.QUERIES["run_quality_report"]}),
ad AS (SELECT count(*) AS n FROM ({oracle_text.QUERIES["adapter_projection"]}) a WHERE reason IS NULL),
po AS (SELECT CAST(count_if(inserted) AS BIGINT) AS fresh, CAST(count_if(NOT inserted) AS BIGINT) AS old
       FROM ({oracle_publish.INSERT_OR_GET}) p),
ps AS (
  SELECT CAST(count_if(dataset_id <> 'F') AS BIGINT) AS fresh, CAST(count_if(dataset_id = 'F') AS BIGINT) AS old FROM (
    SELECT DISTINCT o_orderkey, o_orderstatus AS dataset_id, c_nationkey, p_brand
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
    WHERE date_trunc('month', o_orderdate) = DATE '1995-06-01')
),
ev AS (SELECT count(*) AS n, CAST(count_if(threshold_met) AS BIGINT) AS met FROM ({RUN_EVIDENCE}) e),
sn AS (SELECT count(*) AS n FROM ({oracle_demand.MONTHLY_SERIES}) s WHERE snapshot_date = DATE '1995-06-01'),
sg AS (SELECT count(*) AS n FROM ({oracle_demand.DECAY_SIGNALS}) g)
SELECT q.*, ad.n AS rows_passing_adapter_mapping, po.fresh AS job_postings_inserted, po.old AS job_postings_reused_existing,
       ps.fresh AS job_posting_skills_inserted, ps.old AS job_posting_skills_reused_existing,
       ev.n AS evidence_rows_written, ev.met AS pairs_meeting_threshold, ev.met AS role_skill_requirements_rows_published,
       sn.n AS sdi_snapshots_rows_published, sg.n AS skill_decay_signals_rows_published
FROM q, ad, po, ps, ev, sn, sg
"""

REQUIREMENTS_WITH_GIVEN_TOTALS = f"""
WITH base AS ({oracle_demand.REQUIREMENTS}),
given AS (
  SELECT c_nationkey AS role_id, CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE count(*) END AS total
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 2 = 0 GROUP BY c_nationkey
),
t AS (
  SELECT base.* EXCLUDE (role_total, demand_weight), CAST(coalesce(given.total, role_total) AS BIGINT) AS role_total
  FROM base LEFT JOIN given USING (role_id)
)
SELECT *, least(greatest({RATIO4("skill_posting_count", "role_total")}, 0.1::DOUBLE), 1.0::DOUBLE) AS demand_weight
FROM t WHERE role_total > 0
"""

VERSION_CHECKS = f"""
WITH s AS ({oracle_demand.MONTHLY_SERIES}),
c AS (
  SELECT CAST(count_if(NOT coalesce(NOT isnan(demand_index) AND demand_index BETWEEN 0 AND 1, FALSE)) AS BIGINT) AS a,
         CAST(count_if(requirement_version <= 0) AS BIGINT) AS b,
         CAST(count_if(requirement_version <> 199506) AS BIGINT) AS d
  FROM s
)
SELECT 'demand_index_range' AS rule_name, 'sdi_snapshots' AS table_name, a AS violations FROM c
UNION ALL SELECT 'version_positive', 'sdi_snapshots', b FROM c
UNION ALL SELECT 'version_matches_request', 'sdi_snapshots', d FROM c
"""

REVIEW_ACTIONS = f"""
WITH a AS (
  SELECT p_partkey, {key('p_name')} AS normalized_alias,
         CASE p_size % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'dismiss' ELSE 'reopen' END AS action
  FROM part
)
SELECT a.p_partkey, a.normalized_alias, a.action, r.role_id,
       CASE WHEN r.reviewed IS DISTINCT FROM TRUE THEN 'pending' WHEN r.role_id IS NULL THEN 'dismissed' ELSE 'approved' END
         AS review_state,
       (a.action = 'approve' AND r.role_id IS NOT NULL) OR (a.action = 'dismiss' AND r.role_id IS NULL) AS action_valid
FROM a LEFT JOIN {oracle_ops._RA} r ON r.normalized_alias = a.normalized_alias
"""

_COUNTS = """SELECT '{name}' AS layout, CAST({found} AS INTEGER) AS required_found, {missing} AS required_missing,
  count(*) AS rows_read, CAST(count_if(reason IS NULL) AS BIGINT) AS rows_valid,
  CAST(count_if(reason IS NOT NULL) AS BIGINT) AS rows_rejected FROM ({rows}) x"""

DATASET_VALIDATION = (
    _COUNTS.format(name="with_url", found=8, missing="''", rows=oracle_text.QUERIES["adapter_projection"])
    + "\nUNION ALL\n"
    + _COUNTS.format(name="without_url", found=7, missing="'url'", rows=oracle_text.QUERIES["adapter_missing_column"]))

_RESULTS = """
days AS (SELECT DISTINCT o_custkey AS student_id, CAST(o_orderdate AS DATE) AS created_at FROM orders),
targets AS (
  SELECT c_custkey AS student_id, c_nationkey AS role_id FROM customer
  UNION ALL SELECT c_custkey, (c_nationkey + 7) % 25 FROM customer WHERE c_custkey % 8 = 0
),
results AS (
  SELECT student_id, role_id, strftime(created_at, '%Y%m%d') AS profile_version, created_at,
         sha256(concat_ws('|', CAST(student_id AS VARCHAR), CAST(role_id AS VARCHAR),
                          strftime(created_at, '%Y%m%d'), '1')) AS result_key
  FROM targets JOIN days USING (student_id)
)"""

RESULTS_TO_COMPUTE = f"""
WITH {_RESULTS.strip()}
SELECT * FROM results WHERE created_at >= DATE '1997-01-01'
"""

READINESS_SUMMARY = f"""
WITH {_RESULTS.strip()},
latest AS (SELECT student_id, role_id, max(created_at) AS created_at FROM results GROUP BY student_id, role_id),
ready AS ({oracle_ops.QUERIES["readiness"]}),
top AS (
  SELECT student_id, role_id, count(*) AS n FROM ({oracle_ops.QUERIES["skill_gap"]}) p
  WHERE priority <= 3 AND gap_score > 0 GROUP BY student_id, role_id
)
SELECT r.student_id, r.role_id, r.result_key AS latest_result_key, ready.readiness_score,
       coalesce(top.n, 0) AS top_gap_count, r.profile_version, r.created_at
FROM latest JOIN results r USING (student_id, role_id, created_at)
JOIN ready ON ready.student_id = r.student_id AND ready.role_id = r.role_id
LEFT JOIN top ON top.student_id = r.student_id AND top.role_id = r.role_id
"""

QUERIES = {
    "dataset_registry": DATASET_REGISTRY,
    "decaying_history": DECAYING_HISTORY,
    "run_evidence": RUN_EVIDENCE,
    "evidence_rewrites": EVIDENCE_REWRITES,
    "job_evidence_summary": JOB_EVIDENCE_SUMMARY,
    "run_counters": RUN_COUNTERS,
    "requirements_with_given_totals": REQUIREMENTS_WITH_GIVEN_TOTALS,
    "version_checks": VERSION_CHECKS,
    "review_actions": REVIEW_ACTIONS,
    "dataset_validation": DATASET_VALIDATION,
    "results_to_compute": RESULTS_TO_COMPUTE,
    "readiness_summary": READINESS_SUMMARY,
}
