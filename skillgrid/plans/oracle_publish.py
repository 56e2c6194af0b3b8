"""DuckDB oracle SQL for the publish chain."""

from __future__ import annotations

from skillgrid.plans.oracle_demand import CLIP, MAPPED, R4, RATIO4

_MANIFEST = """
posts AS (
  SELECT o.o_orderkey AS job_posting_id, o.o_orderstatus AS status, CAST(o.o_orderdate AS DATE) AS posted_at
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
),
runs AS (
  SELECT status || '-' || strftime(date_trunc('month', posted_at), '%Y-%m') AS dataset_id, status,
         count(*) AS n_postings, date_trunc('month', max(posted_at))::DATE AS period_month
  FROM posts GROUP BY 1, 2
),
mf0 AS (SELECT *, CAST(row_number() OVER (ORDER BY period_month, status) AS INTEGER) AS version FROM runs),
mf1 AS (SELECT *, CAST(row_number() OVER (PARTITION BY period_month ORDER BY version) AS INTEGER) AS period_revision
        FROM mf0),
manifest AS (SELECT *, period_revision = max(period_revision) OVER (PARTITION BY period_month) AS is_current FROM mf1)"""

_PUBLISHED = f"""
{_MANIFEST.strip()},
{MAPPED.strip()},
mm AS (
  SELECT m.*, mf.version AS requirement_version
  FROM m JOIN manifest mf ON mf.dataset_id = m.dataset_id || '-' || strftime(m.period_month, '%Y-%m')
),
ev AS (
  SELECT requirement_version, role_id, job_posting_id, skill_id,
         sum(CAST(round(normalized_depth * 1000000000.0::DOUBLE) AS BIGINT)) AS depth_sum, count(normalized_depth) AS depth_n
  FROM mm GROUP BY ALL
),
tot AS (SELECT requirement_version, role_id, count(DISTINCT job_posting_id) AS role_total FROM ev GROUP BY ALL),
prs AS (
  SELECT requirement_version, role_id, skill_id, sum(depth_sum) AS ds, sum(depth_n) AS dn, count(*) AS cnt
  FROM ev GROUP BY ALL
),
rr AS (
  SELECT p.requirement_version, p.role_id, p.skill_id,
         {CLIP.format(x=RATIO4("p.ds", "CAST(p.dn AS HUGEINT) * 1000000000"))} AS required_depth,
         least(greatest({RATIO4("p.cnt", "t.role_total")}, 0.1::DOUBLE), 1.0::DOUBLE) AS demand_weight,
         p.cnt
  FROM prs p JOIN tot t ON p.requirement_version = t.requirement_version AND p.role_id = t.role_id
  WHERE t.role_total > 0 AND p.dn > 0
),
cum AS (
  SELECT *, CAST(sum(cnt) OVER (PARTITION BY role_id, skill_id ORDER BY requirement_version
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS evidence_count
  FROM rr
),
pubreq AS (
  SELECT requirement_version, role_id, skill_id, required_depth, demand_weight, evidence_count
  FROM cum WHERE evidence_count >= 5
)"""


def _snapshots(pairs: str, name: str) -> str:
    return f"""
{name}_inp AS (
  SELECT mm.requirement_version, mf.period_month, mm.role_id, mm.job_posting_id, mm.skill_id,
         min(mm.posted_at) AS posted_at
  FROM mm JOIN manifest mf ON mf.version = mm.requirement_version
  WHERE EXISTS (SELECT 1 FROM {pairs})
  GROUP BY ALL
),
{name}_pp AS (
  SELECT requirement_version, period_month, role_id, skill_id, count(*) AS c,
         sum(greatest(90 - greatest(date_diff('day', posted_at, period_month), 0), 0)) AS rec_sum
  FROM {name}_inp GROUP BY ALL
),
{name}_tot AS (
  SELECT requirement_version, role_id, count(DISTINCT job_posting_id) AS n FROM {name}_inp GROUP BY ALL
),
{name}_x AS (
  SELECT pp.*, {CLIP.format(x="CAST(pp.c AS DOUBLE) / CAST(t.n AS DOUBLE)")} AS s,
         {CLIP.format(x="CAST(pp.rec_sum AS DOUBLE) / (90.0::DOUBLE * pp.c)")} AS r, 0.5::DOUBLE AS g
  FROM {name}_pp pp JOIN {name}_tot t ON pp.requirement_version = t.requirement_version AND pp.role_id = t.role_id
),
{name} AS (
  SELECT role_id, skill_id, period_month AS snapshot_date, requirement_version,
         {R4("s")} AS frequency_share, {R4("r")} AS recency_score, {R4("g")} AS growth_score,
         {R4("least(greatest((0.5::DOUBLE * s) + (0.3::DOUBLE * r) + (0.2::DOUBLE * g), 0.0::DOUBLE), 1.0::DOUBLE)")}
           AS demand_index
  FROM {name}_x
)"""


_SNAP = _snapshots("pubreq r WHERE r.requirement_version = mm.requirement_version "
                   "AND r.role_id = mm.role_id AND r.skill_id = mm.skill_id", "snap")

_SIGNALS = f"""
fr AS (
  SELECT role_id, skill_id, snapshot_date, requirement_version,
         row_number() OVER (PARTITION BY role_id, skill_id ORDER BY snapshot_date, requirement_version) AS x,
         CAST(round(demand_index * 10000) AS BIGINT) AS y
  FROM snap
),
fw AS (
  SELECT *, count(*) OVER w AS n, sum(x) OVER w AS sx, sum(y) OVER w AS sy, sum(x * y) OVER w AS sxy,
         sum(x * x) OVER w AS sxx
  FROM fr
  WINDOW w AS (PARTITION BY role_id, skill_id ORDER BY snapshot_date, requirement_version
               ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
),
sl AS (
  SELECT *, CASE WHEN n * sxx - sx * sx = 0 THEN 0.0::DOUBLE
                 ELSE CAST(n * sxy - sx * sy AS DOUBLE) / CAST(n * sxx - sx * sx AS DOUBLE) / 10000.0::DOUBLE END
              AS slope
  FROM fw
),
sig AS (
  SELECT role_id, skill_id,
         {R4("least(greatest(slope, -1.0::DOUBLE), 0.0::DOUBLE)")} AS decay_rate,
         {R4(CLIP.format(x="abs(slope) / 0.20::DOUBLE"))} AS confidence,
         requirement_version, CAST(snapshot_date AS TIMESTAMP) AS detected_at
  FROM sl
  WHERE n = 3 AND slope < -0.10::DOUBLE AND {CLIP.format(x="abs(slope) / 0.20::DOUBLE")} >= 0.70::DOUBLE
),
flag AS (
  SELECT s.role_id, s.skill_id, s.requirement_version, mf.period_month, -abs(s.decay_rate) AS decay_rate,
         s.confidence, s.detected_at,
         row_number() OVER (PARTITION BY s.role_id, s.skill_id, mf.period_month
                            ORDER BY s.requirement_version DESC) = 1 AS is_active
  FROM sig s JOIN manifest mf ON mf.version = s.requirement_version
)"""

VERSION_MANIFEST = f"""
WITH {_MANIFEST.strip()}
SELECT dataset_id, status, n_postings, period_month, version, period_revision, is_current FROM manifest
"""

LINEAGE_BY_DATASET = f"""
WITH {_MANIFEST.strip()},
lin AS (
  SELECT version AS requirement_version, dataset_id, 1 AS lineage_position FROM manifest
  UNION ALL
  SELECT version, prev, 2 FROM (
    SELECT version, dataset_id, lag(dataset_id) OVER (PARTITION BY period_month ORDER BY version) AS prev
    FROM manifest)
  WHERE prev IS NOT NULL AND prev <> dataset_id
)
SELECT l.dataset_id, l.requirement_version, m.period_month, m.period_revision, m.is_current, l.lineage_position,
       m.dataset_id AS triggering_dataset_id
FROM lin l JOIN manifest m ON m.version = l.requirement_version
"""

CURRENT_REQUIREMENTS = f"""
WITH {_PUBLISHED.strip()}
SELECT p.*, mf.period_month, mf.period_revision
FROM pubreq p JOIN manifest mf ON mf.version = p.requirement_version WHERE mf.is_current
"""

CURRENT_SNAPSHOTS = f"""
WITH {_PUBLISHED.strip()},
{_SNAP.strip()}
SELECT s.*, mf.period_month, mf.period_revision
FROM snap s JOIN manifest mf ON mf.version = s.requirement_version WHERE mf.is_current
"""

CURRENT_SIGNALS = f"""
WITH {_PUBLISHED.strip()},
{_SNAP.strip()},
{_SIGNALS.strip()}
SELECT f.role_id, f.skill_id, f.requirement_version, f.decay_rate, f.confidence, f.detected_at, f.is_active,
       mf.period_month, mf.period_revision
FROM flag f JOIN manifest mf ON mf.version = f.requirement_version WHERE mf.is_current AND f.is_active
"""

CURRENT_VERSION = f"""
WITH {_MANIFEST.strip()}
SELECT version, dataset_id, period_month, period_revision FROM manifest WHERE is_current
ORDER BY version DESC LIMIT 1
"""

PREPARED_REQUIREMENTS = f"""
WITH {_PUBLISHED.strip()}
SELECT * FROM pubreq
WHERE requirement_version = (SELECT max(version) FROM manifest WHERE is_current)
"""

PREPARED_SNAPSHOTS = f"""
WITH {_PUBLISHED.strip()},
{_SNAP.strip()}
SELECT * FROM snap WHERE requirement_version = (SELECT max(version) FROM manifest WHERE is_current)
"""

ACTIVE_SIGNALS = f"""
WITH {_PUBLISHED.strip()},
{_SNAP.strip()},
{_SIGNALS.strip()}
SELECT role_id, skill_id, requirement_version, period_month, decay_rate, confidence, detected_at, is_active FROM flag
"""

PUBLISHED_REQUIREMENTS = f"""
WITH {_PUBLISHED.strip()}
SELECT * FROM pubreq
"""

PUBLISHED_SNAPSHOTS = f"""
WITH {_PUBLISHED.strip()},
{_SNAP.strip()}
SELECT * FROM snap
"""

PUBLISHED_SIGNALS = f"""
WITH {_PUBLISHED.strip()},
{_SNAP.strip()},
{_SIGNALS.strip()}
SELECT role_id, skill_id, decay_rate, confidence, requirement_version, detected_at FROM sig
"""

ACTIVE_ROLE_SIGNALS = f"""
WITH {_PUBLISHED.strip()},
{_SNAP.strip()},
{_SIGNALS.strip()}
SELECT role_id, skill_id, requirement_version, period_month, decay_rate, confidence, detected_at FROM flag
WHERE is_active AND role_id = 8
"""

_INCOMING = _snapshots(
    "req r WHERE r.role_id = mm.role_id AND r.skill_id = mm.skill_id", "inc")

SNAPSHOT_PUBLISH_DIFF = f"""
WITH {_PUBLISHED.strip()},
{_SNAP.strip()},
gev AS (
  SELECT role_id, job_posting_id, skill_id, count(normalized_depth) AS depth_n
  FROM m GROUP BY role_id, job_posting_id, skill_id
),
req AS (SELECT role_id, skill_id FROM gev GROUP BY role_id, skill_id HAVING sum(depth_n) > 0 AND count(*) >= 5),
{_INCOMING.strip()}
SELECT i.role_id, i.skill_id, i.snapshot_date, i.requirement_version, i.demand_index AS incoming_value,
       s.demand_index AS stored_value,
       CASE WHEN mf.period_month IS NULL OR i.snapshot_date <> mf.period_month THEN 'off_month'
            WHEN s.demand_index IS NULL THEN 'new'
            WHEN round(s.demand_index, 4) = round(i.demand_index, 4) THEN 'same'
            ELSE 'conflict' END AS publish_status
FROM inc i
LEFT JOIN snap s ON s.role_id = i.role_id AND s.skill_id = i.skill_id AND s.snapshot_date = i.snapshot_date
                AND s.requirement_version = i.requirement_version
LEFT JOIN manifest mf ON mf.version = i.requirement_version
"""

INSERT_OR_GET = """
WITH p AS (
  SELECT o.o_orderstatus AS source, o.o_orderpriority AS title, CAST(o.o_custkey AS VARCHAR) AS company,
         CAST(o.o_orderdate AS DATE) AS posted_at, c.c_nationkey AS role_id, o.o_orderkey AS job_posting_id
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
),
st AS (
  SELECT source, title, company, posted_at, arg_min(role_id, job_posting_id) AS role_id,
         sha256(concat_ws('|', source, title, company, CAST(posted_at AS VARCHAR))) AS posting_id
  FROM p WHERE posted_at < DATE '1998-01-01' GROUP BY source, title, company, posted_at
),
inc AS (
  SELECT source, title, company, posted_at, arg_min(role_id, job_posting_id) AS role_id
  FROM p WHERE posted_at >= DATE '1997-01-01' GROUP BY source, title, company, posted_at
)
SELECT i.source, i.title, i.company, i.posted_at, i.role_id,
       coalesce(st.posting_id, sha256(concat_ws('|', i.source, i.title, i.company, CAST(i.posted_at AS VARCHAR))))
         AS posting_id,
       st.posting_id IS NULL AS inserted,
       (st.posting_id IS NOT NULL AND st.role_id <> i.role_id) AS role_mismatch
FROM inc i LEFT JOIN st ON st.source = i.source AND st.title = i.title AND st.company = i.company
                       AND st.posted_at = i.posted_at
"""

QUERIES = {
    "version_manifest": VERSION_MANIFEST,
    "lineage_by_dataset": LINEAGE_BY_DATASET,
    "current_requirements": CURRENT_REQUIREMENTS,
    "current_snapshots": CURRENT_SNAPSHOTS,
    "current_signals": CURRENT_SIGNALS,
    "current_version": CURRENT_VERSION,
    "prepared_requirements": PREPARED_REQUIREMENTS,
    "prepared_snapshots": PREPARED_SNAPSHOTS,
    "active_signals": ACTIVE_SIGNALS,
    "published_requirements": PUBLISHED_REQUIREMENTS,
    "published_snapshots": PUBLISHED_SNAPSHOTS,
    "published_signals": PUBLISHED_SIGNALS,
    "prepared_role_requirements": PREPARED_REQUIREMENTS + " AND role_id = 8",
    "prepared_role_snapshots": PREPARED_SNAPSHOTS + " AND role_id = 8",
    "active_role_signals": ACTIVE_ROLE_SIGNALS,
    "snapshot_publish_diff": SNAPSHOT_PUBLISH_DIFF,
    "insert_or_get": INSERT_OR_GET,
}
