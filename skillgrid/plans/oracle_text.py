"""DuckDB oracle SQL for the text plans."""

from __future__ import annotations

from skillgrid.operators.ingest import MSG_NOT_DECIMAL, MSG_NOT_STRING
from skillgrid.operators.resolve import COLLISION_WORDS, TOKEN_CHARS
from skillgrid.plans.sqlfrag import (
    DATE_SHAPE, PUNCT_CLASS, WS_RUN, blank, clean, collapse, document_postings_cte, key, q, reason_case,
    strip_ws,
)
from skillgrid.sources.dimensions import (
    TEST_ROLE_ALIASES, TEST_SKILL_ALIASES, TEST_SKILLS, sql_values,
)

_DP = document_postings_cte().strip()

REJECT_REASONS = f"""
WITH {_DP}
SELECT source_row_number, external_id, {reason_case()} AS reason FROM dp
"""

QUARANTINE_PAYLOAD = f"""
WITH {_DP},
r AS (SELECT *, {reason_case()} AS reason FROM dp)
SELECT 'job-documents' AS pipeline_job_id, source_row_number AS row_number,
       CAST(json_object('external_id', external_id, 'source', source, 'title', title, 'company', company,
                        'location', location, 'posted_at', posted_at, 'description', description,
                        'url', url, 'role', role) AS VARCHAR) AS raw_payload,
       reason
FROM r WHERE reason IS NOT NULL
"""


def _foreign_cte(with_url: bool = True) -> str:
    url = ", 'https://example.com/e/' || CAST(event_id AS VARCHAR) AS job_url" if with_url else ""
    return f"""
fp AS (
  SELECT event_id + 1 AS source_row_number, CAST(event_id AS VARCHAR) AS posting_id, event_type AS platform,
         CASE WHEN event_id % 10 = 1 THEN '2024-13' WHEN event_id % 10 = 2 THEN 'bad-date'
              WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m') ELSE strftime(ts, '%Y-%m-%d') END AS posted_date,
         'job ' || event_type AS job_title,
         CASE WHEN event_id % 9 = 4 THEN ' ' WHEN event_id % 9 = 5 THEN '!?!' ELSE 'user ' || CAST(user_id AS VARCHAR) END AS company_name,
         'remote' AS location, props AS job_description,
         CASE WHEN event_id % 4 = 0 THEN 'full time' ELSE '' END AS work_type,
         CASE WHEN event_id % 6 = 5 THEN '12x' ELSE '1000' END AS salary_min{url}
  FROM events
),
fs AS (SELECT *, {strip_ws("coalesce(posted_date, '')")} AS s FROM fp),
fd AS (
  SELECT *, CASE WHEN length(s) = 7
                 THEN CASE WHEN regexp_matches(s || '-01', {q(DATE_SHAPE)}) THEN try_cast(s || '-01' AS DATE) END
                 ELSE CASE WHEN regexp_matches(s, {q(DATE_SHAPE)}) THEN try_cast(s AS DATE) END END AS d
  FROM fs
)"""


def _contract() -> str:
    fields = [("external_id", "posting_id"), ("source", "platform"), ("title", "job_title"),
              ("company", "company_name"), ("location", "location"), ("description", "job_description"),
              ("url", "job_url")]
    parts = [f"CASE WHEN {blank(src)} THEN {q(f'CANONICAL_VALIDATION:{t}:{MSG_NOT_STRING}')} END"
             for t, src in fields]
    sal = f"nullif({strip_ws('salary_min')}, '')"
    parts.append(f"CASE WHEN NOT {blank('salary_min')} AND {sal} IS NOT NULL "
                 f"AND try_cast({sal} AS DECIMAL(18,2)) IS NULL "
                 f"THEN {q(f'CANONICAL_VALIDATION:salary_min:{MSG_NOT_DECIMAL}')} END")
    return "nullif(concat_ws(';', " + ", ".join(parts) + "), '')"


ADAPTER_PROJECTION = f"""
WITH {_foreign_cte().strip()}
SELECT source_row_number, posting_id AS external_id, platform AS source, strftime(d, '%Y-%m-%d') AS posted_at,
       job_title AS title, company_name AS company,
       CASE WHEN NOT {blank('work_type')} THEN work_type END AS employment_type,
       CASE WHEN NOT {blank('salary_min')} THEN salary_min END AS salary_min,
       coalesce(CASE WHEN d IS NULL THEN 'INVALID_SOURCE_DATE:posted_date' END, {_contract()},
                CASE WHEN company_name = '!?!' THEN 'EMPTY_AFTER_NORMALIZATION:company' END) AS reason
FROM fd
"""

ADAPTER_MISSING_COLUMN = f"""
WITH {_foreign_cte(with_url=False).strip()}
SELECT source_row_number, posting_id AS external_id, strftime(d, '%Y-%m-%d') AS posted_at,
       coalesce(CASE WHEN d IS NULL THEN 'INVALID_SOURCE_DATE:posted_date' END,
                'MISSING_SOURCE_COLUMN:url:url|job_url') AS reason
FROM fd
"""

CLEAN_TEXT_VARIANTS = f"""
SELECT doc_id, {collapse('text')} AS collapsed,
       regexp_replace(text, {q(PUNCT_CLASS)}, ' ', 'g') AS no_punctuation,
       {clean('text')} AS cleaned, {key('text')} AS alias_key, {clean('text')} AS role_query
FROM documents
"""

TITLE_TOKEN_MAP = f"""
WITH t AS (
  SELECT p_partkey,
         CASE p_size % 4 WHEN 0 THEN 'Sr.' WHEN 1 THEN 'jr' WHEN 2 THEN 'Dev-' ELSE 'ENG' END || ' ' || p_name AS title_raw
  FROM part
)
SELECT p_partkey, title_raw,
       array_to_string(list_transform(string_split({clean('title_raw')}, ' '),
                       lambda t: CASE t WHEN 'dev' THEN 'developer' WHEN 'eng' THEN 'engineer'
                                        WHEN 'jr' THEN 'junior' WHEN 'sr' THEN 'senior' ELSE t END), ' ')
         AS normalized_title
FROM t
"""

_NW = r"[^\p{L}\p{N}_]"
_SKILL_PUNCT = r"""[!"$%&'()*,\-/:;<=>?@\[\\\]^_`{|}~]"""


def _skill_token(x: str) -> str:
    """The rule on the text as a whole: the glued names are set apart by spaces, then the dropped
    punctuation (which none of them contains) becomes spaces."""
    s = f"lower({collapse(x)})"
    for found, name in (((r'c ?\+ ?\+'), "c++"), ("c ?#", "c#")):
        s = f"regexp_replace({s}, {q('(^|' + _NW + ')' + found)}, {q(r'\1 ' + name + ' ')}, 'g')"
    s = f"regexp_replace({s}, {q('(^|' + _NW + r')\.net(' + _NW + '|$)')}, {q(r'\1 .net \2')}, 'g')"
    return collapse(f"regexp_replace({s}, {q(_SKILL_PUNCT)}, ' ', 'g')")


SKILL_TOKEN_TEXT = f"""
SELECT doc_id, {_skill_token('text')} AS skill_tokens FROM documents
"""

DEDUP_SURVIVORS = f"""
SELECT sha256({clean('text')}) AS text_key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source,
       count(*) AS n_copies
FROM documents GROUP BY 1
"""

POSTING_SURVIVORS = f"""
WITH {_DP},
v AS (
  SELECT source_row_number, {strip_ws('external_id')} AS external_id,
         {clean('source')} AS normalized_source, {clean('title')} AS normalized_title,
         {clean('company')} AS normalized_company,
         try_cast(substr({strip_ws('posted_at')}, 1, 10) AS DATE) AS posted_at
  FROM dp WHERE ({reason_case()}) IS NULL
)
SELECT source_row_number, external_id, normalized_source, normalized_title, normalized_company, posted_at
FROM (SELECT *, row_number() OVER (PARTITION BY normalized_source, normalized_title, normalized_company, posted_at
                                   ORDER BY source_row_number) AS rn FROM v)
WHERE rn = 1
"""

_ROLE_HINTS = f"""
ra AS (SELECT * FROM {sql_values(TEST_ROLE_ALIASES, ['alias', 'role_id', 'reviewed'])}),
lk AS (SELECT {key('alias')} AS role_key, role_id FROM ra),
h AS (
  SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN '  ' || p_name || ' '
                    ELSE replace(p_name, ' ', '   ') END AS role_hint
  FROM part
),
res AS (SELECT h.p_partkey, h.role_hint, {key('h.role_hint')} AS role_key, lk.role_id
        FROM h LEFT JOIN lk ON lk.role_key = {key('h.role_hint')})"""

ROLE_RESOLUTION = f"""
WITH {_ROLE_HINTS.strip()}
SELECT * FROM res
"""

ROLE_UNMATCHED = f"""
WITH {_ROLE_HINTS.strip()}
SELECT {strip_ws('role_hint')} AS example, min(p_partkey) AS first_row
FROM res WHERE role_id IS NULL AND {strip_ws('role_hint')} <> ''
GROUP BY 1 ORDER BY first_row LIMIT 5
"""

_COLLISIONS = ", ".join(q(w) for w in COLLISION_WORDS)
_TOK = TOKEN_CHARS

CLASSIFIED_CTES = f"""
sk AS (SELECT * FROM {sql_values(TEST_SKILLS, ['skill_id', 'name', 'is_active'])}),
al AS (SELECT * FROM {sql_values(TEST_SKILL_ALIASES, ['alias', 'skill_id'])}),
names AS (
  SELECT {key('name')} AS name_key, arg_max(skill_id, name) AS skill_id, max(name) AS skill_name
  FROM sk WHERE is_active GROUP BY 1
),
lk AS (
  SELECT a.nk AS normalized_alias, a.skill_id, s.name AS skill_name,
         (len(list_filter(string_split(a.nk, ' '), lambda t: length(t) > 0 AND length(t) <= 3)) > 0
          OR a.nk IN ({_COLLISIONS})) AS guarded,
         regexp_replace(a.nk, '([\\.^$|?*+()\\[\\]{{}}])', '\\\\\\1', 'g') AS esc
  FROM (SELECT {key('alias')} AS nk, skill_id FROM al) a JOIN sk s ON a.skill_id = s.skill_id
  WHERE s.is_active AND a.nk <> ''
),
raw AS (SELECT doc_id, regexp_split_to_array(text, '[,;\\n]+') AS parts FROM documents),
sig0 AS (SELECT doc_id, unnest(parts) AS part, CAST(unnest(generate_series(0, len(parts) - 1)) AS INTEGER) AS signal_pos FROM raw),
sig1 AS (SELECT doc_id, signal_pos, {strip_ws('part')} AS signal_text FROM sig0),
s AS (SELECT doc_id, signal_pos, signal_text, {key('signal_text')} AS signal_key FROM sig1 WHERE signal_text <> ''),
t12 AS (
  SELECT s.*, n.skill_id AS t1, n.skill_name AS t1n, a.skill_id AS t2, a.skill_name AS t2n
  FROM s LEFT JOIN names n ON n.name_key = s.signal_key LEFT JOIN lk a ON a.normalized_alias = s.signal_key
),
t3 AS (
  SELECT t.doc_id, t.signal_pos, t.signal_text, t.signal_key, a.skill_id, a.skill_name, a.normalized_alias
  FROM t12 t JOIN lk a
    ON CASE WHEN a.guarded
            THEN regexp_matches(t.signal_key, '(^|[^{_TOK}])' || a.esc || '([^{_TOK}]|$)')
            ELSE contains(t.signal_key, a.normalized_alias) END
  WHERE t.t1 IS NULL AND t.t2 IS NULL
),
hits AS (
  SELECT doc_id, signal_pos, signal_text, t1 AS skill_id, t1n AS skill_name, signal_key AS match_key,
         'exact' AS match_type FROM t12 WHERE t1 IS NOT NULL
  UNION ALL
  SELECT doc_id, signal_pos, signal_text, t2, t2n, signal_key, 'alias' FROM t12 WHERE t1 IS NULL AND t2 IS NOT NULL
  UNION ALL
  SELECT doc_id, signal_pos, signal_text, skill_id, skill_name, normalized_alias, 'alias' FROM t3
),
unresolved AS (
  SELECT t.doc_id, t.signal_pos, t.signal_key FROM t12 t
  WHERE t.t1 IS NULL AND t.t2 IS NULL
    AND NOT EXISTS (SELECT 1 FROM t3 WHERE t3.doc_id = t.doc_id AND t3.signal_pos = t.signal_pos)
)"""

SKILL_MATCH_TIERS = f"""
WITH {CLASSIFIED_CTES.strip()}
SELECT doc_id, skill_id, skill_name, signal_pos, signal_text, match_key, match_type
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, skill_id ORDER BY signal_pos, match_key) AS rn FROM hits)
WHERE rn = 1
"""

UNRESOLVED_SIGNALS = f"""
WITH {CLASSIFIED_CTES.strip()},
g AS (
  SELECT signal_key, count(*) AS n, min(doc_id) AS first_doc_id FROM unresolved GROUP BY signal_key
)
SELECT g.signal_key, g.n, g.first_doc_id,
       (SELECT min(u.signal_pos) FROM unresolved u WHERE u.signal_key = g.signal_key AND u.doc_id = g.first_doc_id)
         AS first_signal_pos
FROM g
"""

UNRESOLVED_SIGNALS_TOP = f"""
{UNRESOLVED_SIGNALS.strip()} ORDER BY n DESC, first_doc_id, first_signal_pos, signal_key LIMIT 20
"""

QUERIES = {
    "reject_reasons": REJECT_REASONS,
    "quarantine_payload": QUARANTINE_PAYLOAD,
    "adapter_projection": ADAPTER_PROJECTION,
    "adapter_missing_column": ADAPTER_MISSING_COLUMN,
    "clean_text_variants": CLEAN_TEXT_VARIANTS,
    "title_token_map": TITLE_TOKEN_MAP,
    "skill_token_text": SKILL_TOKEN_TEXT,
    "dedup_survivors": DEDUP_SURVIVORS,
    "posting_survivors": POSTING_SURVIVORS,
    "role_resolution": ROLE_RESOLUTION,
    "role_unmatched": ROLE_UNMATCHED,
    "skill_match_tiers": SKILL_MATCH_TIERS,
    "unresolved_signals": UNRESOLVED_SIGNALS,
    "unresolved_signals_top": UNRESOLVED_SIGNALS_TOP,
}

_ = WS_RUN  # shared with the Spark side
