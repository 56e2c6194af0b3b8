"""Run bookkeeping: dataset registry, run ledger, outbox, run report, stage
summaries, re-ingest guard (K1, K10, K11, A11-A14, R4-R6, T4, X10).

The ledger keeps the reference's transition rules (pending -> running ->
complete/partial/failed; a repeated terminal call is a no-op; anything else is
refused) but evaluates a whole event log at once, as one fold over segments of
time: a segment is a map from the state a job enters it with, and a job's few
maps are applied in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.functions.scores import MANUAL_REVIEW_BELOW, REPORT_WEIGHTS, round4, safe_rate
from skillgrid.functions.text import error_text, name_based_id, strip_ws

# --- fixed values -----------------------------------------------------------
JOB_STATUSES = ("pending", "running", "complete", "partial", "failed")
TERMINAL_STATUSES = ("complete", "partial", "failed")
EVENT_COMPLETED = "ingestion.completed"
EVENT_FAILED = "ingestion.failed"
ERROR_MESSAGE_MAX = 2000
# --- end of fixed values ----------------------------------------------------


def register_datasets(files: DataFrame, *, path: str = "path", source: str = "source") -> DataFrame:
    """Dataset registry rows: deterministic id from the path, status 'uploaded' (K1)."""
    return files.select(name_based_id(path).alias("dataset_id"), F.col(path).alias("path"),
                        F.col(source).alias("source"), F.lit("uploaded").alias("status"))


def new_datasets(files: DataFrame, stored: DataFrame, **names: str) -> DataFrame:
    """Registry rows of files whose dataset is not registered yet, each once however often it is asked for (K1)."""
    return register_datasets(files, **names).distinct().join(stored.select("dataset_id"), "dataset_id", "left_anti")


def _milestones(log: DataFrame, job: str, ts: str, seq: str, action: str, segment: str, payload: Column) -> DataFrame:
    """Per created job: the calls that moved it (``_c`` create, ``_r`` running, ``_k`` complete, ``_f`` failed).

    One pass: a job's log is cut into segments of time.  A segment is reduced
    to what it does to a job that enters it absent, pending or running (the
    state machine as a map over states); a job's few maps are then applied in
    order.  So a job with very many calls is spread over its segments.
    """
    at = F.struct(F.col(ts).alias("at"), F.col(seq).alias("seq"))
    keys = [F.col(job), F.date_trunc(segment, F.col(ts).cast("timestamp")).alias("_seg")]
    calls = log.select(*keys, at.alias("_at"), F.col(action).alias("_do"), payload.alias("_p"))
    earlier = Window.partitionBy(job, "_seg").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)

    def before(flag: Column) -> Column:
        return F.coalesce(F.max(flag).over(earlier), F.lit(False))

    run, done, fail = (F.col("_do") == x for x in ("running", "complete", "failed"))
    calls = calls.withColumn("_created", before(F.col("_do") == "create")).withColumn("_ran", before(run)) \
        .withColumn("_ran_created", before(run & F.col("_created")))

    def first(flag: Column, value: Column) -> Column:
        return F.min_by(value, F.when(flag, F.col("_at")))

    call = F.struct("_at", "_p")
    maps = calls.groupBy(job, "_seg").agg(
        F.min(F.when(F.col("_do") == "create", F.col("_at"))).alias("c"),
        F.min(F.when(run, F.col("_at"))).alias("r_pending"),
        F.min(F.when(run & F.col("_created"), F.col("_at"))).alias("r_absent"),
        first(fail, call).alias("f_pending"),
        first(fail & F.col("_created"), call).alias("f_absent"),
        first(done, call).alias("k_running"),
        first(done & F.col("_ran"), call).alias("k_pending"),
        first(done & F.col("_ran_created"), call).alias("k_absent"),
        F.count_if(run).alias("n_pending"),
        F.count_if(run & F.col("_created")).alias("n_absent"))
    order = maps.schema["c"].dataType.simpleString()
    kind = maps.schema["k_running"].dataType.simpleString()
    start = F.struct(*[F.lit(None).cast(order).alias(c) for c in "cr"], *[F.lit(None).cast(kind).alias(c) for c in "kf"],
                     F.lit(0).cast("bigint").alias("n"))

    def step(acc: Column, m: Column) -> Column:
        pending, running = acc["c"].isNotNull(), acc["r"].isNotNull()
        return F.struct(
            F.coalesce(acc["c"], m["c"]).alias("c"),
            F.coalesce(acc["r"], F.when(pending, m["r_pending"]).otherwise(m["r_absent"])).alias("r"),
            F.coalesce(acc["k"], F.when(running, m["k_running"]).when(pending, m["k_pending"])
                       .otherwise(m["k_absent"])).alias("k"),
            F.coalesce(acc["f"], F.when(pending, m["f_pending"]).otherwise(m["f_absent"])).alias("f"),
            (acc["n"] + F.when(pending, m["n_pending"]).otherwise(m["n_absent"])).alias("n"))

    # the segment comes first in the struct, so sorting the array puts a job's maps in order of time
    folded = maps.groupBy(job).agg(F.sort_array(F.collect_list(F.struct(*[c for c in maps.columns if c != job])))
                                   .alias("_maps")).select(job, F.aggregate("_maps", start, step).alias("_s"))
    return folded.where(F.col("_s.c").isNotNull()).select(
        job, F.col("_s.c").alias("_c"), F.col("_s.r").alias("_r"), F.col("_s.k").alias("_k"), F.col("_s.f").alias("_f"),
        F.col("_s.n").alias("running_calls"))


def _outcome() -> tuple[Column, Column, Column]:
    """(status, started, ended) of a job's milestones, the latter two as (at, seq)."""
    failed = F.col("_f").isNotNull() & (F.col("_k").isNull() | (F.col("_f._at") < F.col("_k._at")))
    completed = F.col("_k").isNotNull() & ~failed
    started = F.when(F.col("_r").isNotNull() & (~failed | (F.col("_r") < F.col("_f._at"))), F.col("_r"))
    status = (F.when(completed, F.when(F.col("_k._p.rejected") > 0, F.lit("partial")).otherwise(F.lit("complete")))
              .when(failed, F.lit("failed")).when(F.col("_r").isNotNull(), F.lit("running")).otherwise(F.lit("pending")))
    return status, started, F.when(completed, F.col("_k._at")).when(failed, F.col("_f._at"))


def ledger_state(log: DataFrame, *, job: str = "job_id", ts: str = "ts", seq: str = "seq",
                 action: str = "action", processed: str = "processed_rows", rejected: str = "rejected_rows",
                 output_version: str = "output_version", message: str = "message", segment: str = "day") -> DataFrame:
    """Final ledger row per job from an action log.

    ``action`` is one of create / running / complete / failed.  A complete call
    counts only after a running call; failed counts from pending or running;
    the first terminal call that is allowed wins and later calls change nothing
    (``refused_calls`` lists those that are errors).  A job that was never
    created has no row.  ``segment`` is the time unit the log is folded by.
    """
    payload = F.struct(F.col(processed).alias("processed"), F.col(rejected).alias("rejected"),
                       F.col(output_version).alias("version"), F.col(message).alias("message"))
    s = _milestones(log, job, ts, seq, action, segment, payload)
    status, started, ended = _outcome()
    s = s.withColumn("status", status)
    completed = F.col("status").isin("complete", "partial")
    return s.select(
        job,
        "status",
        F.col("_c.at").alias("created_at"),
        started["at"].alias("started_at"),
        ended["at"].alias("finished_at"),
        F.when(completed, F.col("_k._p.processed")).otherwise(F.lit(0)).cast("bigint").alias("processed_rows"),
        F.when(completed, F.col("_k._p.rejected")).otherwise(F.lit(0)).cast("bigint").alias("rejected_rows"),
        F.when(completed, F.col("_k._p.version")).cast("int").alias("output_version"),
        F.when(F.col("status") == "failed", error_text("_f._p.message", ERROR_MESSAGE_MAX)).alias("error_message"),
        "running_calls",
    )


def refused_calls(log: DataFrame, *, job: str = "job_id", ts: str = "ts", seq: str = "seq", action: str = "action",
                  rejected: str = "rejected_rows", segment: str = "day") -> DataFrame:
    """One row per call the ledger refuses, with the status it met.

    ``from_status`` is null where the job did not exist yet.  Refused are: any
    call to an absent job, running on a finished one, complete on a pending or
    failed one, failed on a completed one.  A repeat of the terminal call that
    was taken, and running on a running job, change nothing and are not listed.
    """
    status, started, ended = _outcome()
    jobs = _milestones(log, job, ts, seq, action, segment, F.struct(F.col(rejected).alias("rejected"))).select(
        F.col(job).alias("_job"), "_c", started.alias("_started"), ended.alias("_ended"), status.alias("_status"))
    at = F.struct(F.col(ts).alias("at"), F.col(seq).alias("seq"))
    met = (F.when(F.col("_c").isNull() | (at < F.col("_c")), F.lit(None).cast("string"))
           .when(at > F.col("_ended"), F.col("_status"))
           .when(at > F.col("_started"), F.lit("running")).otherwise(F.lit("pending")))
    calls = log.select(job, seq, ts, action).where(F.col(action) != "create")
    found = calls.join(jobs, F.col(job) == F.col("_job"), "left").withColumn("from_status", met)
    refused = (F.col("from_status").isNull()
               | ((F.col(action) == "running") & F.col("from_status").isin(*TERMINAL_STATUSES))
               | ((F.col(action) == "complete") & F.col("from_status").isin("pending", "failed"))
               | ((F.col(action) == "failed") & F.col("from_status").isin("complete", "partial")))
    return found.where(refused).select(job, seq, ts, action, "from_status")


def ledger_rule_violations(ledger: DataFrame) -> DataFrame:
    """Row-state rules of the ledger, as counts."""
    terminal = F.col("status").isin(*TERMINAL_STATUSES)
    return ledger.agg(
        F.count_if(terminal != F.col("finished_at").isNotNull()).alias("finished_at_rule"),
        F.count_if(F.col("output_version").isNotNull() & ~F.col("status").isin("complete", "partial"))
        .alias("output_version_rule"),
        F.count_if(F.col("finished_at") < F.col("started_at")).alias("finished_after_started_rule"),
        F.count_if(~F.col("status").isin(*JOB_STATUSES)).alias("status_enum_rule"),
    )


def outbox_first(events: DataFrame, *, aggregate_id: str, event_type: str, ts: str, seq: str,
                 payload: Column | str) -> DataFrame:
    """At most one outbox row per (aggregate, event type): the first."""
    p = F.col(payload) if isinstance(payload, str) else payload
    first = events.groupBy(aggregate_id, event_type).agg(
        F.min_by(F.struct(F.col(seq).alias("event_seq"), F.col(ts).alias("available_at"), p.alias("payload")),
                 F.struct(F.col(ts), F.col(seq))).alias("_e"),
        F.count(F.lit(1)).alias("attempts"))
    return first.select(
        F.col(aggregate_id).alias("aggregate_id"), F.col(event_type).alias("event_type"),
        "_e.event_seq", "_e.available_at", "_e.payload", F.lit("pending").alias("status"), "attempts")


def outbox_pickup(outbox: DataFrame, now) -> DataFrame:
    """Pending rows that are due (T4); oldest first at the reporting edge."""
    return outbox.where((F.col("status") == "pending") & (F.col("available_at") <= F.lit(now)))


def top_reasons(rejected: DataFrame, *, reason: str = "reason", order: str = "source_row_number",
                n: int = 5) -> DataFrame:
    """Most common rejection reasons; ties by first occurrence."""
    return (rejected.groupBy(reason).agg(F.count(F.lit(1)).alias("count"), F.min(order).alias("first_row"))
            .orderBy(F.col("count").desc(), "first_row").limit(n))


def stage_counter(df: DataFrame, stage: str, flag: Column | None = None) -> DataFrame:
    """One tagged row per input row, for the single-pass run report."""
    return df.select(F.lit(stage).alias("stage"), (flag if flag is not None else F.lit(True)).alias("flag"))


def run_report(counters: DataFrame) -> DataFrame:
    """Run quality report as one row.

    ``counters`` is the union of ``stage_counter`` frames for the stages read,
    validated, deduplicated (flag = role matched) and skill_match; every
    counter is one conditional count in a single aggregate.
    """
    st = F.col("stage")
    c = counters.agg(
        F.count_if(st == "read").alias("rows_read_from_source"),
        F.count_if((st == "read") & F.col("flag")).alias("rows_passing_validation"),
        F.count_if((st == "read") & ~F.col("flag")).alias("rows_rejected_by_validation"),
        F.count_if(st == "deduplicated").alias("rows_surviving_deduplication"),
        F.count_if((st == "deduplicated") & F.col("flag")).alias("rows_matched_to_canonical_role"),
        F.count_if((st == "deduplicated") & ~F.col("flag")).alias("rows_unmatched_to_any_role"),
        F.count_if(st == "skill_match").alias("skill_matches_produced"),
    )
    return with_rates(c)


#: counters of a whole run by stage: (stage, flagged rows or not, or all rows of it)
RUN_COUNTERS = {
    "rows_read_from_source": ("read", None),
    "rows_passing_adapter_mapping": ("adapted", True),
    "rows_passing_validation": ("read", True),
    "rows_rejected_by_validation": ("read", False),
    "rows_surviving_deduplication": ("deduplicated", None),
    "rows_matched_to_canonical_role": ("deduplicated", True),
    "rows_unmatched_to_any_role": ("deduplicated", False),
    "job_postings_inserted": ("posting", True),
    "job_postings_reused_existing": ("posting", False),
    "skill_matches_produced": ("skill_match", None),
    "job_posting_skills_inserted": ("posting_skill", True),
    "job_posting_skills_reused_existing": ("posting_skill", False),
    "evidence_rows_written": ("evidence", None),
    "pairs_meeting_threshold": ("evidence", True),
    "role_skill_requirements_rows_published": ("requirement", None),
    "sdi_snapshots_rows_published": ("snapshot", None),
    "skill_decay_signals_rows_published": ("signal", None),
}


def full_run_report(counters: DataFrame) -> DataFrame:
    """All counters of a run with the report's rates, as one row.

    ``counters`` is the union of ``stage_counter`` frames; a stage without rows
    counts 0.  One aggregate, combined map-side.
    """
    def count(stage: str, flag: bool | None) -> Column:
        at = F.col("stage") == stage
        return F.count_if(at if flag is None else at & (F.col("flag") if flag else ~F.col("flag")))

    return with_rates(counters.agg(*[count(*which).alias(name) for name, which in RUN_COUNTERS.items()]))


def with_rates(c: DataFrame) -> DataFrame:
    """The report's three rates, score and review flag beside its counters."""
    v = safe_rate("rows_passing_validation", "rows_read_from_source")
    r = safe_rate("rows_matched_to_canonical_role", "rows_surviving_deduplication")
    s = F.least(safe_rate("skill_matches_produced", "rows_surviving_deduplication"), F.lit(1.0))
    c = c.withColumn("validation_pass_rate", v).withColumn("role_match_rate", r).withColumn("skill_match_rate", s)
    score = round4(F.lit(REPORT_WEIGHTS["validation_pass_rate"]) * F.col("validation_pass_rate")
                   + F.lit(REPORT_WEIGHTS["role_match_rate"]) * F.col("role_match_rate")
                   + F.lit(REPORT_WEIGHTS["skill_match_rate"]) * F.col("skill_match_rate"))
    return (c.withColumn("confidence_score", score)
            .withColumn("manual_review_recommended", F.col("confidence_score") < F.lit(MANUAL_REVIEW_BELOW)))


def terminal_status(rejected_rows: Column | str) -> Column:
    """complete when nothing was rejected, else partial."""
    r = F.col(rejected_rows) if isinstance(rejected_rows, str) else rejected_rows
    return F.when(r > 0, F.lit("partial")).otherwise(F.lit("complete"))


def reingest_guard(requests: DataFrame, ledger: DataFrame, *,
                   keys: tuple[str, ...] = ("dataset_id", "job_type", "file_hash"), order: str = "seq") -> DataFrame:
    """Requests with a flag saying whether they run: the key must not be in the
    ledger and must be the first request with that key (X10)."""
    first = requests.groupBy(*keys).agg(F.min(order).alias("_first"))
    seen = ledger.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return (requests.join(first, list(keys)).join(seen, list(keys), "left")
            .withColumn("runs", F.col("_seen").isNull() & (F.col(order) == F.col("_first")))
            .drop("_first", "_seen"))


def blank_examples(values: DataFrame, col: str, order: str, n: int = 5) -> DataFrame:
    """First ``n`` distinct non-blank values in input order."""
    ex = strip_ws(F.col(col))
    return (values.where(ex != F.lit("")).groupBy(ex.alias("example")).agg(F.min(order).alias("first_row"))
            .orderBy("first_row").limit(n))
