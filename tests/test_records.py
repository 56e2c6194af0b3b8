"""Stored records: registry, write-once evidence, per-run summary, layouts, latest readiness, events of jobs."""

import datetime as dt

from skillgrid.operators import ingest, ops, publish, requirements, student
from skillgrid.plans import run


def test_dataset_is_registered_once(spark):
    files = spark.createDataFrame([("a.csv", "x"), ("a.csv", "x"), ("b.csv", "y"), (None, "z")], "path string, source string")
    first = ops.new_datasets(files.where("path = 'a.csv'"), ops.register_datasets(files).limit(0))
    assert first.count() == 1
    again = ops.new_datasets(files.where("path is not null"), first)
    assert [r.path for r in again.collect()] == ["b.csv"]


def test_evidence_is_written_once(spark):
    cols = "pipeline_job_id string, role_id string, skill_id string, evidence_count bigint"
    stored = spark.createDataFrame([("j1", "r", "s", 4)], cols)
    new = spark.createDataFrame([("j1", "r", "s", 5), ("j2", "r", "s", 4), ("j1", "r", "t", 1)], cols)
    assert [tuple(r) for r in requirements.stored_already(new, stored).collect()] == [("j1", "r", "s", 5)]
    assert requirements.stored_already(new.limit(0), stored).count() == 0


def test_evidence_summary_counts_both_sides_of_the_threshold(spark):
    prior = spark.createDataFrame([("r", "s", 3), ("r", "s", 1)], "role_id string, skill_id string, evidence_count bigint")
    now = spark.createDataFrame([("j", "r", "s", 1), ("j", "r", "t", 4), ("j", "r", "u", 5)],
                                "job string, role_id string, skill_id string, evidence_count bigint")
    got = requirements.evidence_summary(requirements.evidence_against_prior(now, prior), run="job").first()
    assert tuple(got) == ("j", 3, 10, 2, 1)


def test_given_totals_replace_found_ones_and_drop_empty_roles(spark):
    ev = spark.createDataFrame([(r, p, "s", 500000000, 1) for r in ("a", "b", "c") for p in range(5)],
                               "role_id string, job_posting_id long, skill_id string, depth_sum long, depth_n long")
    totals = spark.createDataFrame([("a", 10), ("b", 0)], "role_id string, role_total bigint")
    got = {r.role_id: (r.role_total, r.demand_weight) for r in
           requirements.requirements_from_evidence(ev, role_totals=totals).collect()}
    assert got == {"a": (10, 0.5), "c": (5, 1.0)}


def test_validation_report_names_missing_columns(spark):
    row = {"posting_id": "1", "platform": "p", "posted_date": "2024-01", "job_title": "t", "company_name": "c",
           "location": "l", "description": "d"}
    df = spark.createDataFrame([row]).selectExpr("1L as source_row_number", "*")
    assert tuple(ingest.validation_report(df, "x").first()) == ("x", 7, "url", 1, 0, 1)
    full = df.selectExpr("*", "'http://u' as url")
    assert tuple(ingest.validation_report(full, "x").first()) == ("x", 8, "", 1, 1, 0)
    assert tuple(ingest.validation_report(full.limit(0), "x").first()) == ("x", 8, "", 0, 0, 0)


def test_readiness_summary_takes_the_latest_result(spark):
    results = spark.createDataFrame(
        [(1, "r", "v1", dt.date(2024, 1, 1), "k1"), (1, "r", "v2", dt.date(2024, 2, 1), "k2"),
         (2, "none", "v1", dt.date(2024, 1, 1), "k3")],
        "student_id int, role_id string, profile_version string, created_at date, result_key string")
    req = spark.createDataFrame([("r", "a", 0.8, 1.0), ("r", "b", 0.5, 0.5)],
                                "role_id string, skill_id string, required_depth double, demand_weight double")
    profile = spark.createDataFrame([(1, "b", 0.5)], "student_id int, skill_id string, depth double")
    gaps = student.skill_gaps(results.select("student_id", "role_id").distinct(), req, profile)
    got = [tuple(r) for r in student.readiness_summary(results, gaps).collect()]
    assert got == [(1, "r", "k2", 0.3333, 1, "v2", dt.date(2024, 2, 1))]


def test_completed_event_is_seen_with_the_ledger_row(spark, tmp_path):
    root = str(tmp_path / "w")
    run._emit(spark, root, "bad", ops.EVENT_FAILED, {"a": 1}, False)
    seen = lambda: sorted(r.aggregate_id for r in publish.read_visible(spark, root, "app_events").collect())
    assert seen() == ["bad"]
    run._emit(spark, root, "good", ops.EVENT_COMPLETED, {"a": 1}, False)
    assert seen() == ["bad"]
    run._log(spark, root, "good", "d", "complete", False)
    assert seen() == ["bad", "good"]
    run._emit(spark, root, "good", ops.EVENT_COMPLETED, {"a": 1}, False)
    assert seen() == ["bad", "good"]


def test_dry_run_writes_no_event(spark, tmp_path):
    run._emit(spark, str(tmp_path / "w"), "j", ops.EVENT_COMPLETED, {}, True)
    assert publish.read_table(spark, str(tmp_path / "w"), "app_events") is None


def test_full_report_counts_every_stage_and_absent_ones_as_zero(spark):
    rows = spark.createDataFrame([("read", True), ("read", False), ("adapted", True), ("deduplicated", True),
                                  ("posting", True), ("posting", False), ("posting", True), ("evidence", False)],
                                 "stage string, flag boolean")
    r = ops.full_run_report(rows).first()
    assert len(ops.RUN_COUNTERS) == 17
    assert (r.rows_read_from_source, r.rows_passing_validation, r.rows_rejected_by_validation) == (2, 1, 1)
    assert (r.job_postings_inserted, r.job_postings_reused_existing) == (2, 1)
    assert (r.evidence_rows_written, r.pairs_meeting_threshold, r.sdi_snapshots_rows_published) == (1, 0, 0)
    assert (r.validation_pass_rate, r.role_match_rate) == (0.5, 1.0)
