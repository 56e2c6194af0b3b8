"""One ingestion run end to end, as Spark jobs over Parquet tables (the runner).

CSV -> validate / adapt -> quarantine -> normalise -> dedup -> role resolution
-> insert-or-get postings -> skill mapping -> posting skills -> evidence summary
-> requirement version -> demand snapshots -> decay signals -> ledger, outbox,
report.

A run is all or nothing.  Every step writes rows of its job under ``root``;
they become visible together, by the ledger row that completes the job, and
those of a failed run never do.  The driver only moves scalars (counts, the
new version number).  A dry run (``dry_run=True``) computes everything, by the
same reads and checks, and writes nothing there.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skillgrid.functions.scores import EVIDENCE_THRESHOLD
from skillgrid.sources.materialize import materialize
from skillgrid.operators import dedup, demand, ingest, ops, publish, quality, requirements, resolve, trend

DEFAULT_DEPTH = 0.8

_SCHEMAS = {
    "job_postings": "source string, title string, company string, posted_at date, role_id string, "
                    "external_id string, posting_id string, dataset_id string",
    "job_posting_skills": "posting_id string, role_id string, skill_id string, normalized_depth double",
    "pipeline_skill_evidence_summary": "dataset_id string, pipeline_job_id string, role_id string, "
                                       "skill_id string, evidence_count bigint, threshold_met boolean",
    "sdi_snapshots": "role_id string, skill_id string, demand_index double, snapshot_date date, "
                     "requirement_version int",
    "skill_decay_signals": "role_id string, skill_id string, decay_rate double, confidence double, "
                           "detected_at timestamp, requirement_version int",
    "pipeline_job_log": "job_id string, dataset_id string, ts timestamp, seq bigint, action string, "
                        "processed_rows bigint, rejected_rows bigint, output_version int, message string",
    "app_events": "aggregate_id string, event_type string, payload string, status string, available_at timestamp",
    "datasets": "dataset_id string, path string, source string, status string",
}


_LEDGER_TABLES = ("pipeline_job_log", "datasets")


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    read = publish.read_table if name in _LEDGER_TABLES else publish.read_visible
    t = read(spark, root, name)
    return t if t is not None else spark.createDataFrame([], _SCHEMAS[name])


def _append(df: DataFrame, root: str, name: str, dry_run: bool, job_id: str | None = None,
            by: tuple[str, ...] = ()) -> None:
    if dry_run:
        return
    if job_id is not None:
        df = df.withColumn(publish.JOB, F.lit(job_id))
        by = (*by, publish.JOB)
    w = df.write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(f"{root}/{name}")


def _counted(spark: SparkSession, df: DataFrame, name: str, **flags: Column) -> tuple[DataFrame, dict[str, int]]:
    """``df`` written once, and how many of its rows have each flag, counted while they are written.

    The counts sit on the rows as written, above every shuffle, so a repeated task does not count twice.
    """
    seen = Observation()
    out = materialize(spark, df.observe(seen, *[F.count_if(flag).alias(c) for c, flag in flags.items()]), name)
    return out, {c: seen.get[c] for c in flags}


def _log(spark: SparkSession, root: str, job_id: str, dataset_id: str, action: str, dry_run: bool,
         processed: int = 0, rejected: int = 0, version: int | None = None, message: str | None = None) -> None:
    seq = _read(spark, root, "pipeline_job_log").count() + 1
    row = [(job_id, dataset_id, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), seq, action, processed,
            rejected, version, message)]
    _append(spark.createDataFrame(row, _SCHEMAS["pipeline_job_log"]), root, "pipeline_job_log", dry_run)


def _emit(spark: SparkSession, root: str, job_id: str, event_type: str, payload: dict, dry_run: bool) -> None:
    """Write an event once.  A completed job's event is a row of the job, seen with the ledger row that completes it;
    a failed job's event belongs to no job, so it is seen at once."""
    import json
    new = spark.createDataFrame(
        [(job_id, event_type, json.dumps(payload, separators=(",", ":")), "pending",
          dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))], _SCHEMAS["app_events"])
    fresh = publish.new_rows(new, _read(spark, root, "app_events"), ["aggregate_id", "event_type"])
    owner = F.lit(job_id if event_type == ops.EVENT_COMPLETED else None).cast("string")
    if not dry_run:
        fresh.withColumn(publish.JOB, owner).write.mode("append").partitionBy(publish.JOB).parquet(f"{root}/app_events")


def run_ingestion(spark: SparkSession, csv_path: str, root: str, *, skills: DataFrame, skill_aliases: DataFrame,
                  role_aliases: DataFrame, layout: str = "canonical", period_month: dt.date | None = None,
                  depth: float = DEFAULT_DEPTH, threshold: int = EVIDENCE_THRESHOLD, dry_run: bool = False) -> dict:
    """Run one dataset file through the whole chain; returns the run report as a dict."""
    dataset_id = hashlib.sha256(csv_path.encode()).hexdigest()
    job_id = f"job-{uuid.uuid4().hex}"
    files = spark.createDataFrame([(csv_path, layout)], "path string, source string")
    _append(ops.new_datasets(files, _read(spark, root, "datasets")), root, "datasets", dry_run)
    _log(spark, root, job_id, dataset_id, "create", dry_run)
    _log(spark, root, job_id, dataset_id, "running", dry_run)
    try:
        result = _run(spark, csv_path, root, dataset_id, job_id, skills=skills, skill_aliases=skill_aliases,
                      role_aliases=role_aliases, layout=layout, period_month=period_month, depth=depth,
                      threshold=threshold, dry_run=dry_run)
    except Exception as error:  # the failure is recorded, then re-raised
        message = str(error).strip()[: ops.ERROR_MESSAGE_MAX]
        _log(spark, root, job_id, dataset_id, "failed", dry_run, message=message)
        _emit(spark, root, job_id, ops.EVENT_FAILED,
              {"type": ops.EVENT_FAILED, "pipelineJobId": job_id, "status": "failed", "errorMessage": message},
              dry_run)
        raise
    status = "partial" if result["rows_rejected_by_validation"] > 0 else "complete"
    # the event first: a crash between the two leaves a job that is not complete and an event nobody sees
    _emit(spark, root, job_id, ops.EVENT_COMPLETED,
          {"type": ops.EVENT_COMPLETED, "pipelineJobId": job_id, "status": status,
           "outputVersion": result["output_version"]}, dry_run)
    _log(spark, root, job_id, dataset_id, "complete", dry_run, processed=result["rows_read_from_source"],
         rejected=result["rows_rejected_by_validation"], version=result["output_version"])
    result.update(job_id=job_id, dataset_id=dataset_id, terminal_status=status)
    return result


def _run(spark, csv_path, root, dataset_id, job_id, *, skills, skill_aliases, role_aliases, layout,
         period_month, depth, threshold, dry_run) -> dict:
    rows = ingest.read_posting_csv(spark, csv_path)
    if layout == "foreign":
        rows = materialize(spark, rows, "run-rows")
    ok = F.col("reason").isNull()
    staged, read = _counted(spark, ingest.adapt_foreign(rows) if layout == "foreign" else ingest.validate_postings(rows),
                            "run-staged", rows_read_from_source=F.lit(True), rows_passing_adapter_mapping=ok,
                            rows_passing_validation=ok, rows_rejected_by_validation=~ok)
    if layout != "foreign":
        rows = staged.drop("reason")
    raw_cols = [c for c in rows.columns if c not in ("source_row_number", "source_file", ingest.SURPLUS)]
    valid, rejected = ingest.split_valid(staged)
    if layout == "foreign":
        rejected = rejected.select("source_row_number", "reason").join(rows, "source_row_number").select(
            "source_row_number", *raw_cols, "reason")
    _append(ingest.quarantine_rows(rejected, job_id, raw_cols), root, "pipeline_rejected_rows", dry_run, job_id)

    norm = ingest.normalize_postings(ingest.to_raw_posting(valid))
    survivors = dedup.dedup_postings(norm)
    hints = resolve.role_hints(rows, external_id="posting_id" if layout == "foreign" else "external_id") \
        .withColumnRenamed("posting_id", "external_id")
    with_hint = survivors.join(hints, "external_id", "left").withColumn(
        "role_hint", F.coalesce(F.when(F.col("source_role_hint") != "", F.col("source_role_hint")),
                                F.col("normalized_role_hint")))
    has_role = F.col("role_id").isNotNull()
    resolved, deduplicated = _counted(
        spark, resolve.resolve_roles(with_hint, role_aliases), "run-resolved", rows_surviving_deduplication=F.lit(True),
        rows_matched_to_canonical_role=has_role, rows_unmatched_to_any_role=~has_role)
    matched = resolved.where(F.col("role_id").isNotNull()).select(
        F.col("normalized_source").alias("source"), F.col("normalized_title").alias("title"),
        F.col("normalized_company").alias("company"), "posted_at", "role_id", "external_id", "description")

    keys = ["source", "title", "company", "posted_at"]
    stored = _read(spark, root, "job_postings")
    # the run's own rows are not visible to its reads: its job is not complete yet
    got, postings = _counted(spark, publish.insert_or_get(matched, stored, keys=keys), "run-postings",
                             job_postings_inserted=F.col("inserted"), job_postings_reused_existing=~F.col("inserted"),
                             role_mismatches=F.col("role_mismatch"))
    if postings.pop("role_mismatches") > 0:
        raise RuntimeError("a stored posting has a different role")
    _append(got.where("inserted").select(*keys, "role_id", "external_id", "posting_id",
                                         F.lit(dataset_id).alias("dataset_id")), root, "job_postings", dry_run, job_id)

    hits, _ = resolve.map_skills(got, skills, skill_aliases, posting="posting_id", text="description")
    skill_key = ["posting_id", "role_id", "skill_id"]
    known = _read(spark, root, "job_posting_skills").select(*skill_key).distinct().withColumn("stored", F.lit(True))
    mapped, matches = _counted(
        spark, hits.join(got.select("posting_id", "role_id", "posted_at"), "posting_id")
        .select(*skill_key, F.lit(float(depth)).alias("normalized_depth"), "posted_at")
        .join(known, skill_key, "left").withColumn("stored", F.col("stored").isNotNull()), "run-skills",
        job_posting_skills_inserted=~F.col("stored"), job_posting_skills_reused_existing=F.col("stored"),
        skill_matches_produced=F.lit(True))
    _append(mapped.where(~F.col("stored")).drop("posted_at", "stored"), root, "job_posting_skills", dry_run, job_id)
    mapped = mapped.drop("stored")

    role_totals = got.groupBy("role_id").agg(F.countDistinct("posting_id").alias("role_total"))
    per_run = requirements.aggregate_role_requirements(mapped, role_totals=role_totals, posting="posting_id")
    current = per_run.select("role_id", "skill_id", F.col("skill_posting_count").alias("evidence_count"))
    evidence, written = _counted(spark, requirements.evidence_against_prior(
        current, _read(spark, root, "pipeline_skill_evidence_summary"), threshold=threshold), "run-evidence",
        evidence_rows_written=F.lit(True), pairs_meeting_threshold=F.col("threshold_met"))
    _append(evidence.select(F.lit(dataset_id).alias("dataset_id"), "role_id", "skill_id", "evidence_count",
                            "threshold_met"), root, "pipeline_skill_evidence_summary", dry_run, job_id)
    to_publish, published = _counted(spark, requirements.publishable(per_run, evidence, threshold=threshold).select(
        "role_id", "skill_id", "required_depth", "demand_weight", "evidence_count"), "run-requirements",
        role_skill_requirements_rows_published=F.lit(True))
    quality.assert_rules(quality.publish_rules(to_publish, "role_skill_requirements"))

    month = period_month or valid_month(norm)
    if dry_run:
        version = publish.next_version(publish.read_manifest(spark, root), month)[0]
    else:
        version = publish.publish_requirements(spark, root, to_publish, dataset_id=dataset_id, period_month=month,
                                               job_id=job_id)

    pairs = to_publish.select("role_id", "skill_id")
    inputs = demand.demand_inputs(mapped, pairs, posting="posting_id")
    sdi, snapshots = _counted(spark, demand.compute_demand_index(inputs, month, posting="posting_id").select(
        "role_id", "skill_id", "demand_index", F.lit(month).alias("snapshot_date"),
        F.lit(version).alias("requirement_version")), "run-snapshots", sdi_snapshots_rows_published=F.lit(True))
    manifest = publish.read_manifest(spark, root, own=(version, dataset_id, month))
    stored_snap = _read(spark, root, "sdi_snapshots").select(*sdi.columns)
    plan = materialize(spark, publish.snapshot_publish_plan(sdi, stored_snap, manifest), "run-publish-plan")
    publish.assert_publishable(plan)
    fresh = sdi.join(plan.where("publish_status = 'new'").select("role_id", "skill_id"), ["role_id", "skill_id"],
                     "left_semi").select(*sdi.columns)
    _append(fresh, root, "sdi_snapshots", dry_run, job_id, by=("requirement_version",))

    history = trend.snapshot_history(stored_snap.unionByName(fresh), sdi)
    signals, decayed = _counted(spark, trend.detect_decay(history).select(
        "role_id", "skill_id", "decay_rate", "confidence", "detected_at",
        F.lit(version).alias("requirement_version")), "run-signals", skill_decay_signals_rows_published=F.lit(True))
    _append(signals, root, "skill_decay_signals", dry_run, job_id, by=("requirement_version",))

    counts = {**read, **deduplicated, **postings, **matches, **written, **published, **snapshots, **decayed}
    schema = ", ".join(f"{c} bigint" for c in counts)
    report = ops.with_rates(spark.createDataFrame([tuple(counts.values())], schema)).first().asDict()
    report.update(
        output_version=version,
        # by reason, a bounded list; the rows themselves are in the quarantine table
        rejected={r["reason"]: r["count"] for r in rejected.groupBy("reason").count().collect()},
    )
    return report


def valid_month(postings: DataFrame) -> dt.date:
    """Month of the latest posting of the run's dataset (A9), as a scalar."""
    one = postings.select(F.lit("run").alias("dataset_id"), "posted_at")
    return demand.dataset_period_month(one).first()["period_month"]
