"""SQL fragments for the DuckDB oracles: the text rules written in SQL.

The regular expressions are the same text as the Spark side uses (they are
valid in both Java regex and RE2); only look-behind, which RE2 lacks, is
rewritten with an explicit boundary group.
"""

from __future__ import annotations

from skillgrid.functions.text import WHITESPACE_CLASS

WS_RUN = WHITESPACE_CLASS + "+"
PUNCT_CLASS = r"[!-/:-@\[-`{-~]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS_RUN + '|' + WS_RUN + '$')}, '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(WS_RUN)}, ' ', 'g'))"


def clean(x: str) -> str:
    no_punct = f"regexp_replace({x}, {q(PUNCT_CLASS)}, ' ', 'g')"
    return f"lower({collapse(no_punct)})"


def key(x: str) -> str:
    return f"lower({collapse(x)})"


def blank(x: str) -> str:
    stripped = strip_ws(f"coalesce({x}, '')")
    return f"({stripped} = '')"


def document_postings_cte() -> str:
    """Documents as canonical posting rows (same derivation as sources.tables)."""
    day = "(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER))"
    return f"""
dp AS (
  SELECT doc_id + 1 AS source_row_number,
         CAST(doc_id AS VARCHAR) AS external_id,
         CASE WHEN doc_id % 7 = 1 THEN '' ELSE source END AS source,
         CASE WHEN doc_id % 19 = 2 THEN '!!!' ELSE split_part(text, chr(10), 1) END AS title,
         CASE WHEN doc_id % 13 = 4 THEN '   ' ELSE 'publisher ' || lang END AS company,
         lang AS location,
         CASE WHEN doc_id % 11 = 3 THEN 'not-a-date'
              WHEN doc_id % 5 = 0 THEN strftime({day}, '%Y-%m-%d') || 'T09:30:00Z'
              ELSE strftime({day}, '%Y-%m-%d') END AS posted_at,
         text AS description,
         CASE WHEN doc_id % 17 = 5 THEN '' ELSE 'https://example.com/doc/' || CAST(doc_id AS VARCHAR) END AS url,
         lang AS role
  FROM documents
)"""


DATE_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DATETIME_SHAPE = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]([01][0-9]|2[0-3])(:[0-5][0-9](:[0-5][0-9]([.][0-9]{1,6})?)?)?"
    r"(Z|[+-]([01][0-9]|2[0-3]):?[0-5][0-9])?$"
)


def date_valid(x: str) -> str:
    s = strip_ws(f"coalesce({x}, '')")
    return (f"((regexp_matches({s}, {q(DATE_SHAPE)}) OR regexp_matches({s}, {q(DATETIME_SHAPE)}))"
            f" AND try_cast(substr({s}, 1, 10) AS DATE) IS NOT NULL)")


def reason_case(prefix: str = "") -> str:
    """First rejection reason of a canonical posting row (no salary columns)."""
    p = prefix
    parts = [f"WHEN {blank(p + c)} THEN 'EMPTY_REQUIRED_FIELD:{c}'"
             for c in ("external_id", "source", "title", "company", "url")]
    parts.append(f"WHEN NOT {date_valid(p + 'posted_at')} THEN 'INVALID_DATE:posted_at'")
    parts += [f"WHEN {blank(p + c)} THEN 'CANONICAL_VALIDATION:{c}'" for c in ("location", "description")]
    parts += [f"WHEN {clean(p + c)} = '' THEN 'EMPTY_AFTER_NORMALIZATION:{c}'" for c in ("source", "title", "company")]
    return "CASE " + " ".join(parts) + " END"
