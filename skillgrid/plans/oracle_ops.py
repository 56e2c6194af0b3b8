"""DuckDB oracle SQL for bookkeeping, audits and student analytics."""

from __future__ import annotations

from skillgrid.operators.ops import ERROR_MESSAGE_MAX
from skillgrid.plans import oracle_demand, oracle_publish
from skillgrid.plans.oracle_demand import R4, RATIO4
from skillgrid.plans.sqlfrag import blank, clean, document_postings_cte, key, q, reason_case, strip_ws
from skillgrid.sources.dimensions import (
    TEST_ROLE_ALIASES, TEST_ROLES, TEST_SKILL_ALIASES, TEST_SKILLS, sql_values,
)

# ---------------------------------------------------------------- ledger / outbox

_LOG = """
log AS (
  SELECT user_id AS job_id, ts, event_id AS seq,
         CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type IN ('view', 'click') THEN 'running'
              WHEN event_type = 'purchase' THEN 'complete' ELSE 'failed' END AS action,
         CAST(floor(value) AS BIGINT) * 3 AS processed_rows,
         CAST(floor(value) AS BIGINT) % 2 AS rejected_rows, CAST(floor(value) AS INTEGER) + 1 AS output_version,
         props AS message
  FROM events
)"""

_LEDGER = f"""
{_LOG.strip()},
cr AS (
  SELECT job_id, ts AS c_ts, seq AS c_seq FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS rn FROM log WHERE action = 'create')
  WHERE rn = 1
),
af AS (
  SELECT l.* FROM log l JOIN cr ON l.job_id = cr.job_id
  WHERE l.ts > cr.c_ts OR (l.ts = cr.c_ts AND l.seq > cr.c_seq)
),
ru AS (
  SELECT job_id, ts AS r_ts, seq AS r_seq FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS rn FROM af WHERE action = 'running')
  WHERE rn = 1
),
nrun AS (SELECT job_id, count(*) AS running_calls FROM af WHERE action = 'running' GROUP BY job_id),
fa AS (
  SELECT job_id, ts AS f_ts, seq AS f_seq, substr({strip_ws('message')}, 1, {ERROR_MESSAGE_MAX}) AS f_msg FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS rn FROM af WHERE action = 'failed')
  WHERE rn = 1
),
co AS (
  SELECT job_id, k_ts, k_seq, k_proc, k_rej, k_ver FROM (
    SELECT l.job_id, l.ts AS k_ts, l.seq AS k_seq, l.processed_rows AS k_proc, l.rejected_rows AS k_rej, l.output_version AS k_ver,
           row_number() OVER (PARTITION BY l.job_id ORDER BY l.ts, l.seq) AS rn
    FROM log l JOIN ru ON l.job_id = ru.job_id
    WHERE l.action = 'complete' AND (l.ts > ru.r_ts OR (l.ts = ru.r_ts AND l.seq > ru.r_seq)))
  WHERE rn = 1
),
s0 AS (
  SELECT cr.job_id, cr.c_ts, ru.r_ts, ru.r_seq, fa.f_ts, fa.f_seq, fa.f_msg, co.k_ts, co.k_proc, co.k_rej, co.k_ver,
         coalesce(nrun.running_calls, 0) AS running_calls,
         coalesce(fa.f_ts IS NOT NULL AND (co.k_ts IS NULL OR fa.f_ts < co.k_ts
                                           OR (fa.f_ts = co.k_ts AND fa.f_seq < co.k_seq)), FALSE) AS fail_first
  FROM cr LEFT JOIN ru ON cr.job_id = ru.job_id LEFT JOIN fa ON cr.job_id = fa.job_id
  LEFT JOIN co ON cr.job_id = co.job_id LEFT JOIN nrun ON cr.job_id = nrun.job_id
),
s1 AS (SELECT *, (k_ts IS NOT NULL AND NOT fail_first) AS co_first FROM s0),
ledger AS (
  SELECT job_id,
         CASE WHEN co_first THEN (CASE WHEN k_rej > 0 THEN 'partial' ELSE 'complete' END)
              WHEN fail_first THEN 'failed' WHEN r_ts IS NOT NULL THEN 'running' ELSE 'pending' END AS status,
         c_ts AS created_at,
         CASE WHEN r_ts IS NOT NULL AND (NOT fail_first OR r_ts < f_ts OR (r_ts = f_ts AND r_seq < f_seq)) THEN r_ts END AS started_at,
         CASE WHEN co_first THEN k_ts WHEN fail_first THEN f_ts END AS finished_at,
         CAST(CASE WHEN co_first THEN k_proc ELSE 0 END AS BIGINT) AS processed_rows,
         CAST(CASE WHEN co_first THEN k_rej ELSE 0 END AS BIGINT) AS rejected_rows,
         CAST(CASE WHEN co_first THEN k_ver END AS INTEGER) AS output_version,
         CASE WHEN fail_first AND NOT co_first THEN f_msg END AS error_message,
         running_calls
  FROM s1
)"""

RUN_LEDGER_STATUS = f"""
WITH {_LEDGER.strip()}
SELECT * FROM ledger
"""

LEDGER_RULE_VIOLATIONS = f"""
WITH {_LEDGER.strip()}
SELECT CAST(count_if((status IN ('complete', 'partial', 'failed')) <> (finished_at IS NOT NULL)) AS BIGINT) AS finished_at_rule,
       CAST(count_if(output_version IS NOT NULL AND status NOT IN ('complete', 'partial')) AS BIGINT) AS output_version_rule,
       CAST(count_if(finished_at < started_at) AS BIGINT) AS finished_after_started_rule,
       CAST(count_if(status NOT IN ('pending', 'running', 'complete', 'partial', 'failed')) AS BIGINT) AS status_enum_rule
FROM ledger
"""

# call by call, as the ledger would take them
LEDGER_REFUSED_CALLS = f"""
WITH RECURSIVE {_LOG.strip()},
numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS n FROM log),
calls AS (
  SELECT job_id, n, seq, ts, action, CAST(NULL AS VARCHAR) AS from_status,
         CASE WHEN action = 'create' THEN 'pending' END AS to_status
  FROM numbered WHERE n = 1
  UNION ALL
  SELECT m.job_id, m.n, m.seq, m.ts, m.action, c.to_status,
         CASE WHEN c.to_status IS NULL THEN (CASE WHEN m.action = 'create' THEN 'pending' END)
              WHEN m.action = 'running' AND c.to_status = 'pending' THEN 'running'
              WHEN m.action = 'complete' AND c.to_status = 'running'
                THEN (CASE WHEN m.rejected_rows > 0 THEN 'partial' ELSE 'complete' END)
              WHEN m.action = 'failed' AND c.to_status IN ('pending', 'running') THEN 'failed'
              ELSE c.to_status END
  FROM calls c JOIN numbered m ON m.job_id = c.job_id AND m.n = c.n + 1
)
SELECT job_id, seq, ts, action, from_status FROM calls
WHERE action <> 'create'
  AND CASE WHEN from_status IS NULL THEN TRUE
           WHEN action = 'running' THEN from_status NOT IN ('pending', 'running')
           WHEN action = 'complete' THEN from_status NOT IN ('running', 'complete', 'partial')
           ELSE from_status NOT IN ('pending', 'running', 'failed') END
"""

_OUTBOX = """
outbox AS (
  SELECT user_id AS aggregate_id, event_type, event_id AS event_seq, ts AS available_at, props AS payload,
         'pending' AS status, attempts
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn,
               count(*) OVER (PARTITION BY user_id, event_type) AS attempts
        FROM events)
  WHERE rn = 1
)"""

OUTBOX_FIRST_EVENT = f"""
WITH {_OUTBOX.strip()}
SELECT * FROM outbox
"""

OUTBOX_PICKUP = f"""
WITH {_OUTBOX.strip()}
SELECT * FROM outbox WHERE status = 'pending' AND available_at <= TIMESTAMP '2024-01-10 00:00:00'
"""

# ---------------------------------------------------------------- document run


def _classified(source_sql: str, prefix: str) -> str:
    """Tiered skill matching of (doc_id, text) rows from ``source_sql``; first hit per skill."""
    from skillgrid.plans.oracle_text import CLASSIFIED_CTES
    ctes = CLASSIFIED_CTES.replace(
        "raw AS (SELECT doc_id, regexp_split_to_array(text, '[,;\\n]+') AS parts FROM documents)",
        f"raw AS (SELECT doc_id, regexp_split_to_array(text, '[,;\\n]+') AS parts FROM ({source_sql}))")
    assert ctes != CLASSIFIED_CTES
    return ctes.strip() + f""",
{prefix}_first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, skill_id ORDER BY signal_pos, match_key) AS rn
                 FROM hits)
  WHERE rn = 1
)"""


_DP = document_postings_cte().strip()

_DOC_RUN = f"""
{_DP},
r AS (SELECT *, {reason_case()} AS reason FROM dp),
v AS (
  SELECT source_row_number, {strip_ws('external_id')} AS external_id, {clean('source')} AS ns, {clean('title')} AS nt,
         {clean('company')} AS nc, try_cast(substr({strip_ws('posted_at')}, 1, 10) AS DATE) AS pa,
         {clean('title')} AS normalized_role_hint, {strip_ws('description')} AS description
  FROM r WHERE reason IS NULL
),
surv AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ns, nt, nc, pa ORDER BY source_row_number) AS rn FROM v)
  WHERE rn = 1
),
hints AS (
  SELECT external_id,
         arg_max(coalesce(nullif(role, ''), nullif(title, ''), ''), source_row_number) AS source_role_hint
  FROM dp GROUP BY external_id
),
ra AS (SELECT * FROM {sql_values(TEST_ROLE_ALIASES, ['alias', 'role_id', 'reviewed'])}),
rlk AS (SELECT {key('alias')} AS role_key, role_id FROM ra),
resolved AS (
  SELECT s.*, rlk.role_id
  FROM surv s LEFT JOIN hints h ON h.external_id = s.external_id
  LEFT JOIN rlk ON rlk.role_key = {key("coalesce(nullif(h.source_role_hint, ''), s.normalized_role_hint)")}
)"""

_MATCHED_HITS = _classified(
    "SELECT source_row_number - 1 AS doc_id, description AS text FROM resolved WHERE role_id IS NOT NULL", "mh")


def _rate(num: str, den: str) -> str:
    return f"CASE WHEN {den} <= 0 THEN 0.0::DOUBLE ELSE {RATIO4(num, den)} END"


RUN_QUALITY_REPORT = f"""
WITH {_DOC_RUN.strip()},
{_MATCHED_HITS},
c AS (
  SELECT (SELECT count(*) FROM r) AS rows_read_from_source,
         (SELECT count(*) FROM r WHERE reason IS NULL) AS rows_passing_validation,
         (SELECT count(*) FROM r WHERE reason IS NOT NULL) AS rows_rejected_by_validation,
         (SELECT count(*) FROM resolved) AS rows_surviving_deduplication,
         (SELECT count(*) FROM resolved WHERE role_id IS NOT NULL) AS rows_matched_to_canonical_role,
         (SELECT count(*) FROM resolved WHERE role_id IS NULL) AS rows_unmatched_to_any_role,
         (SELECT count(*) FROM mh_first) AS skill_matches_produced
),
rt AS (
  SELECT *, {_rate('rows_passing_validation', 'rows_read_from_source')} AS validation_pass_rate,
         {_rate('rows_matched_to_canonical_role', 'rows_surviving_deduplication')} AS role_match_rate,
         least({_rate('skill_matches_produced', 'rows_surviving_deduplication')}, 1.0::DOUBLE) AS skill_match_rate
  FROM c
),
sc AS (
  SELECT *, {R4("0.35::DOUBLE * validation_pass_rate + 0.35::DOUBLE * role_match_rate + 0.3::DOUBLE * skill_match_rate")}
           AS confidence_score
  FROM rt
)
SELECT *, confidence_score < 0.8::DOUBLE AS manual_review_recommended FROM sc
"""

TOP_REJECTION_REASONS = f"""
WITH {_DP},
r AS (SELECT *, {reason_case()} AS reason FROM dp)
SELECT reason, count(*) AS count, min(source_row_number) AS first_row
FROM r WHERE reason IS NOT NULL GROUP BY reason ORDER BY count DESC, first_row LIMIT 5
"""

_VALID_HITS = _classified(
    "SELECT source_row_number - 1 AS doc_id, " + strip_ws("description") + " AS text FROM r WHERE reason IS NULL",
    "vh")

STAGE_SUMMARY = f"""
WITH {_DP},
r AS (SELECT *, {reason_case()} AS reason FROM dp),
{_VALID_HITS},
d AS (SELECT doc_id, source AS job_id FROM documents),
hs AS (
  SELECT d.job_id, count(*) AS skill_hits, count(DISTINCT f.skill_id) AS evidence_skills
  FROM vh_first f JOIN d ON d.doc_id = f.doc_id GROUP BY d.job_id
),
st AS (
  SELECT d.job_id, count(*) AS rows_read, CAST(count_if(r.reason IS NOT NULL) AS BIGINT) AS rows_rejected,
         CAST(count_if(r.reason IS NULL) AS BIGINT) AS rows_valid
  FROM d JOIN r ON d.doc_id + 1 = r.source_row_number GROUP BY d.job_id
)
SELECT st.job_id, rows_read, rows_rejected, rows_valid, coalesce(skill_hits, 0) AS skill_hits,
       coalesce(evidence_skills, 0) AS evidence_skills,
       CASE WHEN rows_rejected > 0 THEN 'partial' ELSE 'complete' END AS status
FROM st LEFT JOIN hs ON hs.job_id = st.job_id
"""

VALIDATION_SUMMARY = f"""
WITH {_DP},
r AS (SELECT *, {reason_case()} AS reason FROM dp)
SELECT d.source AS job_id, r.reason, count(*) AS rows
FROM documents d JOIN r ON d.doc_id + 1 = r.source_row_number
WHERE r.reason IS NOT NULL GROUP BY d.source, r.reason
"""

BELOW_THRESHOLD_EVIDENCE = f"""
SELECT * FROM ({oracle_demand.CUMULATIVE}) x WHERE NOT threshold_met
"""

# ---------------------------------------------------------------- audits


def _rules(table: str, source: str, rules: dict[str, str]) -> str:
    parts = [f"SELECT {q(name)} AS rule_name, {q(table)} AS table_name, "
             f"CAST(count_if(NOT coalesce({cond}, FALSE)) AS BIGINT) AS violations FROM {source}"
             for name, cond in rules.items()]
    return "\nUNION ALL\n".join(parts)


def _in_range(c: str, lo: float, hi: float) -> str:
    return f"({c} IS NOT NULL AND NOT isnan({c}) AND {c} >= {lo}::DOUBLE AND {c} <= {hi}::DOUBLE)"


def _dup(table: str, source: str, keys: list[str], name: str | None = None) -> str:
    k = ", ".join(keys)
    return (f"SELECT {q(name or 'unique_' + '_'.join(keys))} AS rule_name, {q(table)} AS table_name, "
            f"CAST(count(*) AS BIGINT) AS violations FROM (SELECT {k} FROM {source} GROUP BY {k} HAVING count(*) > 1)")


def _orphan(table: str, child: str, ck: str, parent: str, pk: str, name: str) -> str:
    return (f"SELECT {q(name)} AS rule_name, {q(table)} AS table_name, CAST(count(*) AS BIGINT) AS violations "
            f"FROM {child} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = c.{ck})")


def _nonblank(c: str) -> str:
    return f"NOT {blank(c)}"


_PUB_MANIFEST = f"(WITH {oracle_publish._MANIFEST.strip()} SELECT * FROM manifest)"
_PUB_REQ = f"(WITH {oracle_publish._PUBLISHED.strip()} SELECT * FROM pubreq)"
_PUB_SIG = (f"(WITH {oracle_publish._PUBLISHED.strip()}, {oracle_publish._SNAP.strip()}, "
            f"{oracle_publish._SIGNALS.strip()} SELECT * FROM sig)")

TABLE_AUDIT = "\nUNION ALL\n".join([
    _rules("lineitem", "lineitem", {
        "quantity_range": _in_range("l_quantity", 1.0, 50.0),
        "discount_range": _in_range("l_discount", 0.0, 1.0),
        "returnflag_enum": "l_returnflag IN ('A', 'N', 'R')",
    }),
    _rules("orders", "orders", {
        "orderstatus_enum": "o_orderstatus IN ('F', 'O', 'P')",
        "totalprice_positive": "o_totalprice > 0",
    }),
    _rules("documents", "documents", {
        "non_blank_text": _nonblank("text"), "non_blank_source": _nonblank("source"),
        "non_blank_lang": _nonblank("lang"), "n_chars_positive": "n_chars > 0",
    }),
    _rules("labels", "labels", {"quality_flag": "quality IN (0, 1)", "toxic_flag": "toxic IN (0, 1)"}),
    _dup("orders", "orders", ["o_orderkey"]),
    _dup("part", "part", ["p_partkey"]),
    _dup("lineitem", "lineitem", ["l_orderkey", "l_linenumber"]),
    _orphan("lineitem", "lineitem", "l_orderkey", "orders", "o_orderkey", "fk_orders"),
    _orphan("lineitem", "lineitem", "l_partkey", "part", "p_partkey", "fk_part"),
    _orphan("orders", "orders", "o_custkey", "customer", "c_custkey", "fk_customer"),
    _orphan("customer", "customer", "c_nationkey", "nation", "n_nationkey", "fk_nation"),
    _orphan("labels", "labels", "doc_id", "documents", "doc_id", "fk_documents"),
    _rules("role_skill_requirements", f"({oracle_demand.REQUIREMENTS})", {
        "required_depth_range": _in_range("required_depth", 0.0, 1.0),
        "demand_weight_range": _in_range("demand_weight", 0.1, 1.0),
    }),
    _rules("sdi_snapshots", f"({oracle_demand.DEMAND_INDEX})", {
        "demand_index_range": _in_range("demand_index", 0.0, 1.0),
    }),
    _rules("published_requirements", _PUB_REQ, {
        "required_depth_range": _in_range("required_depth", 0.0, 1.0),
        "demand_weight_range": _in_range("demand_weight", 0.1, 1.0),
        "evidence_minimum": "evidence_count >= 5",
        "version_positive": "requirement_version > 0",
    }),
    _rules("skill_decay_signals", _PUB_SIG, {
        "decay_rate_range": _in_range("decay_rate", -1.0, 0.0),
        "confidence_range": _in_range("confidence", 0.0, 1.0),
        "version_positive": "requirement_version > 0",
    }),
    f"SELECT 'one_current_per_month' AS rule_name, 'role_requirement_versions' AS table_name, "
    f"CAST(count_if(n <> 1) AS BIGINT) AS violations FROM "
    f"(SELECT period_month, count_if(is_current) AS n FROM {_PUB_MANIFEST} GROUP BY period_month)",
    _rules("role_requirement_versions", _PUB_MANIFEST, {
        "period_month_is_month_start": "period_month = date_trunc('month', period_month)",
        "period_revision_positive": "period_revision > 0",
    }),
])

_SK = f"(SELECT * FROM {sql_values(TEST_SKILLS, ['skill_id', 'name', 'is_active'])})"
_AL = f"(SELECT *, {key('alias')} AS normalized_alias FROM {sql_values(TEST_SKILL_ALIASES, ['alias', 'skill_id'])})"
_RA = (f"(SELECT *, {key('alias')} AS normalized_alias "
       f"FROM {sql_values(TEST_ROLE_ALIASES, ['alias', 'role_id', 'reviewed'])})")
_RO = f"(SELECT * FROM {sql_values(TEST_ROLES, ['role_id', 'title'])})"

DIMENSION_AUDIT = "\nUNION ALL\n".join([
    _rules("skill_aliases", _AL, {"alias_key_normalized": f"normalized_alias = {key('alias')}"}),
    _rules("role_aliases", f"(SELECT * FROM {_RA} WHERE role_id IS NOT NULL)",
           {"alias_key_normalized": f"normalized_alias = {key('alias')}"}),
    _dup("skill_aliases", _AL, ["normalized_alias"]),
    _dup("role_aliases", _RA, ["normalized_alias"]),
    _orphan("skill_aliases", _AL, "skill_id", _SK, "skill_id", "fk_skills"),
    _orphan("role_aliases", f"(SELECT * FROM {_RA} WHERE role_id IS NOT NULL)", "role_id", _RO, "role_id",
            "fk_roles"),
    f"SELECT 'alias_of_inactive_skill' AS rule_name, 'skill_aliases' AS table_name, CAST(count(*) AS BIGINT) AS violations "
    f"FROM {_AL} a JOIN {_SK} s ON a.skill_id = s.skill_id WHERE NOT s.is_active",
    "SELECT 'course_weight_allowed' AS rule_name, 'course_skills' AS table_name, "
    "CAST(count_if(NOT coalesce((p_size % 5) * 0.25::DOUBLE IN (0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 1.0::DOUBLE), "
    "FALSE)) AS BIGINT) AS violations FROM part",
    f"SELECT 'hint_without_alias' AS rule_name, 'part' AS table_name, CAST(count(DISTINCT p_name) AS BIGINT) AS violations "
    f"FROM part WHERE NOT EXISTS (SELECT 1 FROM {_RA} r WHERE r.normalized_alias = {key('part.p_name')})",
])

DUPLICATE_KEYS = """
SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1
"""

ORPHAN_KEYS = """
SELECT DISTINCT 'lineitem.l_suppkey' AS relation, l_suppkey AS key FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey)
UNION ALL
SELECT DISTINCT 'orders.o_custkey', o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL
SELECT DISTINCT 'labels.doc_id', doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
UNION ALL
SELECT DISTINCT 'embeddings.unlabelled', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)
UNION ALL
SELECT DISTINCT 'part.unused', p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)
"""

ALIAS_REVIEW_STATE = f"""
WITH cand AS (SELECT DISTINCT {key('p_name')} AS normalized_alias FROM part),
ra AS (SELECT normalized_alias, role_id, reviewed FROM {_RA}),
j AS (SELECT c.normalized_alias, ra.role_id, ra.reviewed FROM cand c LEFT JOIN ra ON ra.normalized_alias = c.normalized_alias),
s AS (
  SELECT *, CASE WHEN NOT coalesce(reviewed, FALSE) THEN 'pending' WHEN role_id IS NOT NULL THEN 'approved'
                 ELSE 'dismissed' END AS review_state
  FROM j
)
SELECT normalized_alias, role_id, coalesce(reviewed, FALSE) AS reviewed, review_state,
       CASE WHEN review_state = 'approved' THEN role_id IS NOT NULL
            WHEN review_state = 'dismissed' THEN role_id IS NULL END AS action_valid
FROM s
"""

NAME_BASED_IDS = """
SELECT p_partkey, p_brand, sha256(concat_ws('|', 'part', CAST(p_partkey AS VARCHAR), p_brand)) AS part_skill_id
FROM part
"""

# ---------------------------------------------------------------- students

_STUDENT = f"""
bought AS (
  SELECT o.o_custkey, l.l_partkey, l.l_quantity, p.p_brand, o.o_orderdate
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
),
profile AS (
  SELECT o_custkey AS student_id, p_brand AS skill_id,
         least(sum(l_quantity) / (50.0::DOUBLE * count(*)), 1.0::DOUBLE) AS depth
  FROM bought GROUP BY 1, 2
),
req AS (SELECT * FROM ({oracle_demand.REQUIREMENTS}) WHERE required_depth > 0),
g0 AS (
  SELECT c.c_custkey AS student_id, req.role_id, req.skill_id, req.required_depth, req.demand_weight,
         coalesce(pr.depth, 0.0::DOUBLE) AS have
  FROM customer c JOIN req ON req.role_id = c.c_nationkey OR (c.c_custkey % 8 = 0 AND req.role_id = (c.c_nationkey + 7) % 25)
  LEFT JOIN profile pr ON pr.student_id = c.c_custkey AND pr.skill_id = req.skill_id
),
gaps AS (
  SELECT student_id, role_id, skill_id, required_depth, demand_weight,
         {R4("have")} AS student_depth,
         {R4("greatest(required_depth - have, 0.0::DOUBLE)")} AS raw_gap,
         {R4("greatest(required_depth - have, 0.0::DOUBLE) * demand_weight")} AS gap_score,
         least(have / required_depth, 1.0::DOUBLE) AS coverage
  FROM g0
),
pri AS (
  SELECT *, CAST(rank() OVER (PARTITION BY student_id, role_id ORDER BY gap_score DESC, demand_weight DESC)
                 AS INTEGER) AS priority
  FROM gaps
)"""

SKILL_GAP = f"""
WITH {_STUDENT.strip()}
SELECT student_id, role_id, skill_id, required_depth, demand_weight, student_depth, raw_gap, gap_score, priority
FROM pri
"""

READINESS = f"""
WITH {_STUDENT.strip()},
ver AS (SELECT o_custkey AS student_id, strftime(max(o_orderdate), '%Y%m%d') AS profile_version
        FROM orders GROUP BY o_custkey),
rd AS (
  SELECT student_id, role_id, {R4("sum(coverage * demand_weight) / sum(demand_weight)")} AS readiness_score,
         count(*) AS required_skills, CAST(count_if(raw_gap > 0) AS BIGINT) AS skills_with_gap
  FROM gaps GROUP BY student_id, role_id
)
SELECT rd.*, ver.profile_version,
       sha256(concat_ws('|', CAST(rd.student_id AS VARCHAR), CAST(rd.role_id AS VARCHAR), ver.profile_version, '1'))
         AS result_key
FROM rd LEFT JOIN ver ON ver.student_id = rd.student_id
"""

ROADMAP = f"""
WITH {_STUDENT.strip()},
top AS (SELECT * FROM pri WHERE priority <= 3 AND gap_score > 0),
catalog AS (SELECT p_brand AS skill_id, p_partkey AS item_id, p_size AS difficulty FROM part WHERE p_size <= 45),
done AS (SELECT DISTINCT o_custkey AS student_id, l_partkey AS item_id FROM bought),
mine AS (
  SELECT t.student_id, t.role_id, t.skill_id, t.priority, t.gap_score, c.item_id, c.difficulty
  FROM top t JOIN catalog c USING (skill_id)
)
SELECT m.*, 'todo' AS status FROM mine m LEFT JOIN done d ON d.student_id = m.student_id AND d.item_id = m.item_id
WHERE d.item_id IS NULL
"""


def _trigrams(x: str) -> str:
    words = f"list_filter(string_split({clean(x)}, ' '), lambda w: length(w) > 0)"
    return ("list_distinct(flatten(list_transform(" + words + ", lambda w: list_transform("
            "generate_series(1, length('  ' || w || ' ') - 2), lambda i: substr('  ' || w || ' ', i, 3)))))")


ROLE_SEARCH_TIERS = f"""
WITH qs AS (
  SELECT DISTINCT {clean('query')} AS query_key FROM (
    SELECT CASE WHEN p_partkey % 37 = 5 THEN title WHEN p_partkey % 37 = 6 THEN left(title, length(title) - 1)
                WHEN p_partkey % 37 = 7 THEN 'zzqx' WHEN p_partkey % 3 = 0 THEN upper(p_name)
                WHEN p_partkey % 3 = 1 THEN '  ' || p_name || '!' ELSE replace(p_name, ' ', '-') END AS query
    FROM part JOIN (SELECT title, row_number() OVER (ORDER BY role_id) - 1 AS n FROM {_RO}) t
      ON t.n = p_partkey % {len(TEST_ROLES)})
),
tg AS (
  SELECT role_id, 'title' AS kind, {clean('title')} AS target_key FROM {_RO}
  UNION ALL
  SELECT role_id, 'alias', {clean('alias')} FROM {_RA} WHERE role_id IS NOT NULL
),
ex AS (
  SELECT qs.query_key, tg.role_id, CASE WHEN kind = 'title' THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END AS score,
         CASE WHEN kind = 'title' THEN 'exact_title' ELSE 'exact_alias' END AS tier
  FROM qs JOIN tg ON qs.query_key = tg.target_key
),
qt AS (SELECT query_key, unnest(list_distinct(string_split(query_key, ' '))) AS tok FROM qs),
tt AS (
  SELECT role_id, target_key, unnest(list_distinct(string_split(target_key, ' '))) AS tok,
         len(list_distinct(string_split(target_key, ' '))) AS n_tok
  FROM tg
),
kw AS (
  SELECT qt.query_key, tt.role_id, 0.7::DOUBLE + 0.2::DOUBLE * count(*) / n_tok AS score, 'keyword' AS tier
  FROM qt JOIN tt ON qt.tok = tt.tok WHERE qt.tok <> ''
  GROUP BY qt.query_key, tt.role_id, tt.target_key, tt.n_tok
),
qg AS (SELECT query_key, len(g) AS nq, unnest(g) AS gram FROM (SELECT query_key, {_trigrams('query_key')} AS g FROM qs)),
tgm AS (SELECT role_id, target_key, len(g) AS nt, unnest(g) AS gram
        FROM (SELECT role_id, target_key, {_trigrams('target_key')} AS g FROM tg)),
sh AS (
  SELECT qg.query_key, qg.nq, tgm.role_id, tgm.target_key, tgm.nt, count(*) AS shared
  FROM qg JOIN tgm ON qg.gram = tgm.gram GROUP BY 1, 2, 3, 4, 5
),
fz AS (
  SELECT query_key, role_id,
         CASE WHEN sim >= 0.3::DOUBLE THEN 0.5::DOUBLE + 0.3::DOUBLE * sim ELSE 0.5::DOUBLE * sim END AS score,
         CASE WHEN sim >= 0.3::DOUBLE THEN 'fuzzy' ELSE 'fallback' END AS tier
  FROM (SELECT *, CAST(shared AS DOUBLE) / (nq + nt - shared) AS sim FROM sh)
),
allc AS (
  SELECT query_key, role_id, {R4("score")} AS score, tier,
         CASE tier WHEN 'exact_title' THEN 5 WHEN 'exact_alias' THEN 4 WHEN 'keyword' THEN 3 WHEN 'fuzzy' THEN 2
                   ELSE 1 END AS r
  FROM (SELECT * FROM ex UNION ALL SELECT * FROM kw UNION ALL SELECT * FROM fz)
),
best AS (
  SELECT query_key, role_id, score, tier FROM (
    SELECT *, row_number() OVER (PARTITION BY query_key, role_id ORDER BY score DESC, r DESC) AS rn FROM allc)
  WHERE rn = 1
),
strong AS (SELECT * FROM best WHERE score >= 0.5::DOUBLE),
weak AS (
  SELECT query_key, role_id, score, tier FROM (
    SELECT *, max(score) OVER (PARTITION BY query_key) AS m FROM best
    WHERE score < 0.5::DOUBLE AND query_key NOT IN (SELECT query_key FROM strong))
  WHERE score = m
)
SELECT * FROM strong UNION ALL SELECT * FROM weak
UNION ALL
SELECT query_key, role_id, 0.0::DOUBLE, 'top_active'
FROM qs, (SELECT r.role_id FROM {_RO} r LEFT JOIN {_RA} a ON a.role_id = r.role_id
          GROUP BY r.role_id ORDER BY count(a.role_id) DESC, r.role_id LIMIT 3)
WHERE query_key NOT IN (SELECT query_key FROM best)
"""

RETENTION_VERSIONS = f"""
WITH {oracle_publish._MANIFEST.strip()}
SELECT version, period_month, is_current,
       is_current OR row_number() OVER (ORDER BY version DESC) <= 4 AS keep_online
FROM manifest
"""

REINGEST_GUARD = """
WITH e AS (
  SELECT user_id AS dataset_id, event_type AS job_type, sha256(props) AS file_hash, event_id AS seq, ts FROM events
),
ledger AS (SELECT DISTINCT dataset_id, job_type, file_hash FROM e WHERE ts < TIMESTAMP '2024-01-15 00:00:00'),
req AS (SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'),
fr AS (SELECT dataset_id, job_type, file_hash, min(seq) AS first_seq FROM req GROUP BY ALL)
SELECT r.dataset_id, r.job_type, r.file_hash, r.seq,
       (l.dataset_id IS NULL AND r.seq = fr.first_seq) AS runs
FROM req r JOIN fr ON fr.dataset_id = r.dataset_id AND fr.job_type = r.job_type AND fr.file_hash = r.file_hash
LEFT JOIN ledger l ON l.dataset_id = r.dataset_id AND l.job_type = r.job_type AND l.file_hash = r.file_hash
"""

LATEST_ORDERS = """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
WHERE rn = 1
"""

QUERIES = {
    "run_ledger_status": RUN_LEDGER_STATUS,
    "ledger_rule_violations": LEDGER_RULE_VIOLATIONS,
    "ledger_refused_calls": LEDGER_REFUSED_CALLS,
    "outbox_first_event": OUTBOX_FIRST_EVENT,
    "outbox_pickup": OUTBOX_PICKUP,
    "run_quality_report": RUN_QUALITY_REPORT,
    "top_rejection_reasons": TOP_REJECTION_REASONS,
    "stage_summary": STAGE_SUMMARY,
    "validation_summary": VALIDATION_SUMMARY,
    "below_threshold_evidence": BELOW_THRESHOLD_EVIDENCE,
    "table_audit": TABLE_AUDIT,
    "dimension_audit": DIMENSION_AUDIT,
    "duplicate_keys": DUPLICATE_KEYS,
    "orphan_keys": ORPHAN_KEYS,
    "alias_review_state": ALIAS_REVIEW_STATE,
    "name_based_ids": NAME_BASED_IDS,
    "skill_gap": SKILL_GAP,
    "readiness": READINESS,
    "roadmap": ROADMAP,
    "role_search_tiers": ROLE_SEARCH_TIERS,
    "retention_versions": RETENTION_VERSIONS,
    "reingest_guard": REINGEST_GUARD,
    "latest_orders": LATEST_ORDERS,
}
