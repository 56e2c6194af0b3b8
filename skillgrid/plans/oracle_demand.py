"""DuckDB oracle SQL for the demand plans (same tables, independent formulation)."""

from __future__ import annotations

MAPPED = """
m AS (
  SELECT o.o_orderkey AS job_posting_id, o.o_orderstatus AS dataset_id, c.c_nationkey AS role_id,
         p.p_brand AS skill_id,
         CASE WHEN l.l_returnflag = 'N' THEN NULL ELSE l.l_quantity / 50.0::DOUBLE END AS normalized_depth,
         CAST(o.o_orderdate AS DATE) AS posted_at,
         date_trunc('month', CAST(o.o_orderdate AS DATE))::DATE AS period_month
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""

CLIP = "least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"


def R4(x: str) -> str:
    """Half-up to 4 places of a double, through a 12-place decimal."""
    return f"CAST(round(CAST({x} AS DECIMAL(24,12)), 4) AS DOUBLE)"


def RATIO4(num: str, den: str) -> str:
    """num / den of whole numbers, half-up to 4 places, by whole-number division."""
    return f"(CAST((CAST({num} AS HUGEINT) * 20000 + ({den})) // (2 * ({den})) AS DOUBLE) / 10000.0::DOUBLE)"

REQUIREMENTS = f"""
WITH {MAPPED.strip()},
ev AS (
  SELECT role_id, job_posting_id, skill_id,
         sum(CAST(round(normalized_depth * 1000000000.0::DOUBLE) AS BIGINT)) AS depth_sum, count(normalized_depth) AS depth_n
  FROM m GROUP BY role_id, job_posting_id, skill_id
),
tot AS (SELECT role_id, count(DISTINCT job_posting_id) AS role_total FROM ev GROUP BY role_id),
pairs AS (
  SELECT role_id, skill_id, sum(depth_sum) AS depth_sum, sum(depth_n) AS depth_n, count(*) AS skill_posting_count
  FROM ev GROUP BY role_id, skill_id
)
SELECT p.role_id, p.skill_id,
       {CLIP.format(x=RATIO4("p.depth_sum", "CAST(p.depth_n AS HUGEINT) * 1000000000"))} AS required_depth,
       p.skill_posting_count, t.role_total,
       least(greatest({RATIO4("p.skill_posting_count", "t.role_total")}, 0.1::DOUBLE), 1.0::DOUBLE) AS demand_weight
FROM pairs p JOIN tot t ON p.role_id = t.role_id
WHERE t.role_total > 0 AND p.depth_n > 0
"""

CUMULATIVE = f"""
WITH {MAPPED.strip()},
ev AS (
  SELECT period_month, role_id, job_posting_id, skill_id, count(normalized_depth) AS depth_n
  FROM m GROUP BY period_month, role_id, job_posting_id, skill_id
),
pairs AS (
  SELECT period_month, role_id, skill_id, sum(depth_n) AS depth_n, count(*) AS evidence_count
  FROM ev GROUP BY period_month, role_id, skill_id
),
runs AS (SELECT * FROM pairs WHERE depth_n > 0)
SELECT period_month, role_id, skill_id, evidence_count,
       CAST(sum(evidence_count) OVER w - evidence_count AS BIGINT) AS prior_evidence,
       CAST(sum(evidence_count) OVER w AS BIGINT) AS cumulative_evidence,
       sum(evidence_count) OVER w >= 5 AS threshold_met
FROM runs
WINDOW w AS (PARTITION BY role_id, skill_id ORDER BY period_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

_REQ_PAIRS = """
ev AS (
  SELECT role_id, job_posting_id, skill_id, count(normalized_depth) AS depth_n
  FROM m GROUP BY role_id, job_posting_id, skill_id
),
req AS (
  SELECT role_id, skill_id FROM ev GROUP BY role_id, skill_id
  HAVING sum(depth_n) > 0 AND count(*) >= 5
)"""


def _inputs(where: str = "", by: str = "") -> str:
    return f"""
SELECT {by}m.role_id, m.job_posting_id, m.skill_id, min(m.posted_at) AS posted_at
FROM m
WHERE EXISTS (SELECT 1 FROM req r WHERE r.role_id = m.role_id AND r.skill_id = m.skill_id) {where}
GROUP BY {by}m.role_id, m.job_posting_id, m.skill_id"""


def _index(snapshot: str, by: str = "", prev_join: str = "", prev_col: str = "NULL::DOUBLE") -> str:
    byc = by.replace("m.", "")
    return f"""
pp AS (
  SELECT {byc}role_id, skill_id, count(*) AS skill_posting_count,
         sum(greatest(90 - greatest(date_diff('day', posted_at, {snapshot}), 0), 0)) AS rec_sum
  FROM inp GROUP BY {byc}role_id, skill_id
),
tot AS (SELECT {byc}role_id, count(DISTINCT job_posting_id) AS role_required_total FROM inp GROUP BY {byc}role_id),
x AS (
  SELECT pp.*, t.role_required_total,
         {CLIP.format(x="CAST(pp.skill_posting_count AS DOUBLE) / CAST(t.role_required_total AS DOUBLE)")} AS s,
         {CLIP.format(x="CAST(pp.rec_sum AS DOUBLE) / (90.0::DOUBLE * pp.skill_posting_count)")} AS r,
         {prev_col} AS prev
  FROM pp JOIN tot t ON pp.role_id = t.role_id {"AND pp.period_month = t.period_month" if byc else ""}
  {prev_join}
),
y AS (
  SELECT *, CASE WHEN prev IS NULL THEN 0.5::DOUBLE
                 ELSE {CLIP.format(x="(s - prev + 1.0::DOUBLE) / 2.0::DOUBLE")} END AS g
  FROM x
)"""


_INDEX_COLS = f"""
       skill_posting_count, role_required_total,
       {R4("s")} AS frequency_share, {R4("r")} AS recency_score, {R4("g")} AS growth_score,
       {R4("least(greatest((0.5::DOUBLE * s) + (0.3::DOUBLE * r) + (0.2::DOUBLE * g), 0.0::DOUBLE), 1.0::DOUBLE)")}
         AS demand_index"""

DEMAND_INDEX = f"""
WITH {MAPPED.strip()},
{_REQ_PAIRS.strip()},
inp AS ({_inputs()}),
{_index("DATE '1995-06-01'").strip()}
SELECT role_id, skill_id,{_INDEX_COLS}
FROM y
"""

DEMAND_INDEX_WITH_GROWTH = f"""
WITH {MAPPED.strip()},
{_REQ_PAIRS.strip()},
inp AS ({_inputs("AND m.posted_at >= DATE '1997-01-01' AND m.posted_at <= DATE '1997-12-31'")}),
prev_inp AS ({_inputs("AND m.posted_at >= DATE '1996-01-02' AND m.posted_at <= DATE '1996-12-31'")}),
prev_tot AS (SELECT role_id, count(DISTINCT job_posting_id) AS n FROM prev_inp GROUP BY role_id),
prev_share AS (
  SELECT p.role_id, p.skill_id,
         {CLIP.format(x="CAST(count(*) AS DOUBLE) / CAST(max(t.n) AS DOUBLE)")} AS previous_share
  FROM prev_inp p JOIN prev_tot t ON p.role_id = t.role_id GROUP BY p.role_id, p.skill_id
),
{_index("DATE '1997-12-31'", prev_join="LEFT JOIN prev_share ps ON ps.role_id = pp.role_id AND ps.skill_id = pp.skill_id",
        prev_col="ps.previous_share").strip()}
SELECT role_id, skill_id,{_INDEX_COLS}
FROM y
"""

MONTHLY_SERIES_CTES = f"""
{MAPPED.strip()},
{_REQ_PAIRS.strip()},
inp AS ({_inputs(by="m.period_month, ")}),
mtot AS (SELECT period_month, role_id, count(DISTINCT job_posting_id) AS n FROM inp GROUP BY period_month, role_id),
mshare AS (
  SELECT (i.period_month + INTERVAL 1 MONTH)::DATE AS period_month, i.role_id, i.skill_id,
         {CLIP.format(x="CAST(count(*) AS DOUBLE) / CAST(max(t.n) AS DOUBLE)")} AS previous_share
  FROM inp i JOIN mtot t ON i.period_month = t.period_month AND i.role_id = t.role_id
  GROUP BY i.period_month, i.role_id, i.skill_id
),
{_index("period_month", by="m.period_month, ",
        prev_join="LEFT JOIN mshare ps ON ps.role_id = pp.role_id AND ps.skill_id = pp.skill_id AND ps.period_month = pp.period_month",
        prev_col="ps.previous_share").strip()},
series AS (
  SELECT role_id, skill_id, period_month AS snapshot_date,
         CAST(strftime(period_month, '%Y%m') AS INTEGER) AS requirement_version,{_INDEX_COLS}
  FROM y
)"""

MONTHLY_SERIES = f"""
WITH {MONTHLY_SERIES_CTES.strip()}
SELECT * FROM series
"""

_SLOPES_CTES = """
last AS (
  SELECT *, row_number() OVER (PARTITION BY role_id, skill_id
                               ORDER BY snapshot_date DESC, requirement_version DESC) AS rn
  FROM series
),
agg AS (
  SELECT role_id, skill_id, count(*) AS n_points,
         sum(-rn) AS sx, sum(CAST(round(demand_index * 10000) AS BIGINT)) AS sy,
         sum(-rn * CAST(round(demand_index * 10000) AS BIGINT)) AS sxy, sum(rn * rn) AS sxx,
         max(CASE WHEN rn = 1 THEN requirement_version END) AS latest_version,
         max(CASE WHEN rn = 1 THEN snapshot_date END) AS latest_snapshot_date
  FROM last WHERE rn <= 3 GROUP BY role_id, skill_id
),
sl AS (
  SELECT *, CASE WHEN n_points * sxx - sx * sx = 0 THEN 0.0::DOUBLE
                 ELSE CAST(n_points * sxy - sx * sy AS DOUBLE) / CAST(n_points * sxx - sx * sx AS DOUBLE)
                      / 10000.0::DOUBLE END AS slope
  FROM agg
)"""

TREND_SLOPES = f"""
WITH {MONTHLY_SERIES_CTES.strip()},
{_SLOPES_CTES.strip()}
SELECT role_id, skill_id, n_points, slope, latest_version, latest_snapshot_date FROM sl
"""

DECAY_SIGNALS = f"""
WITH {MONTHLY_SERIES_CTES.strip()},
{_SLOPES_CTES.strip()}
SELECT role_id, skill_id,
       {R4("least(greatest(slope, -1.0::DOUBLE), 0.0::DOUBLE)")} AS decay_rate,
       {R4(CLIP.format(x="abs(slope) / 0.20::DOUBLE"))} AS confidence,
       latest_version AS requirement_version,
       CAST(latest_snapshot_date AS TIMESTAMP) AS detected_at
FROM sl
WHERE n_points = 3 AND slope < -0.10::DOUBLE AND {CLIP.format(x="abs(slope) / 0.20::DOUBLE")} >= 0.70::DOUBLE
"""

QUERIES = {
    "role_requirements": REQUIREMENTS,
    "cumulative_evidence": CUMULATIVE,
    "demand_index": DEMAND_INDEX,
    "demand_index_with_growth": DEMAND_INDEX_WITH_GROWTH,
    "monthly_demand_series": MONTHLY_SERIES,
    "trend_slopes": TREND_SLOPES,
    "decay_signals": DECAY_SIGNALS,
}
