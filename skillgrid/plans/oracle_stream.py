"""DuckDB oracle SQL for the streaming plans: the batch answer over the same table."""

from __future__ import annotations

from skillgrid.plans.oracle_ops import OUTBOX_FIRST_EVENT
from skillgrid.plans.oracle_text import POSTING_SURVIVORS
from skillgrid.plans.sqlfrag import document_postings_cte, reason_case

QUERIES = {
    "evidence_threshold_stream": """
SELECT user_id, event_type, count(*) AS evidence_count, count(*) >= 5 AS threshold_met
FROM events GROUP BY user_id, event_type
""",
    "outbox_stream": OUTBOX_FIRST_EVENT,
    "ingest_stream_rejects": f"""
WITH {document_postings_cte().strip()},
r AS (SELECT source_row_number AS row_number, {reason_case()} AS reason FROM dp)
SELECT row_number, reason FROM r WHERE reason IS NOT NULL
""",
    "due_outbox_stream": """
SELECT event_id, user_id, event_type, ts FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00'
""",
    "posting_survivors_stream": POSTING_SURVIVORS,
    "event_dedup_stream": """
SELECT DISTINCT event_id, user_id, event_type FROM events
""",
}
