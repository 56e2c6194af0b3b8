"""Whole chain on two small CSV files, as the reference's end-to-end test does."""

import csv
import os

import pytest

from skillgrid.plans.run import run_ingestion

HEADER = ["external_id", "source", "title", "company", "location", "posted_at", "description", "url"]


def _rows(month: str):
    out = []
    for i in range(10):
        desc = "python3" if i < 5 else "sql queries"
        out.append([f"ext-{month}-{i}", "board", "Data Analyst", f"Company {i}", "Manila",
                    f"2026-{month}-{i + 1:02d}", desc, f"https://jobs.example/{month}/{i}"])
    return out


def _write(folder, name, rows):
    path = os.path.join(folder, name)
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(HEADER)
        w.writerows(rows)
    return path


def _dims(spark):
    skills = spark.createDataFrame([("K-PY", "Python", True), ("K-SQL", "SQL", True)],
                                   "skill_id string, name string, is_active boolean")
    aliases = spark.createDataFrame([("python3", "K-PY", "python3"), ("sql queries", "K-SQL", "sql queries")],
                                    "alias string, skill_id string, normalized_alias string")
    roles = spark.createDataFrame([("data analyst", "R1", True, "data analyst")],
                                  "alias string, role_id string, reviewed boolean, normalized_alias string")
    return dict(skills=skills, skill_aliases=aliases, role_aliases=roles)


def test_two_runs(spark, scratch):
    root = os.path.join(scratch, "warehouse")
    valid = _write(scratch, "valid_postings.csv", _rows("05"))
    mixed_rows = _rows("06") + [
        ["ext-bad-1", "board", "Data Analyst", "", "Manila", "2026-06-20", "python3", "https://jobs.example/b1"],
        ["ext-bad-2", "board", "Data Analyst", "Other", "Manila", "2026-06-21", "python3", ""],
    ]
    mixed = _write(scratch, "mixed_postings.csv", mixed_rows)

    r1 = run_ingestion(spark, valid, root, **_dims(spark))
    assert r1["terminal_status"] == "complete" and r1["output_version"] == 1
    assert r1["rows_surviving_deduplication"] == 10 and r1["rows_matched_to_canonical_role"] == 10
    assert r1["role_skill_requirements_rows_published"] == 2
    ev = spark.read.parquet(f"{root}/pipeline_skill_evidence_summary")
    assert sorted((r["skill_id"], r["evidence_count"]) for r in ev.collect()) == [("K-PY", 5), ("K-SQL", 5)]
    snaps = spark.read.parquet(f"{root}/sdi_snapshots").collect()
    assert sorted(r["demand_index"] for r in snaps) == [0.65, 0.65]

    r2 = run_ingestion(spark, mixed, root, **_dims(spark))
    assert r2["terminal_status"] == "partial" and r2["output_version"] == 2
    assert r2["rows_passing_validation"] == 10
    assert r2["rejected"] == {"EMPTY_REQUIRED_FIELD:company": 1, "EMPTY_REQUIRED_FIELD:url": 1}
    reqs = spark.read.parquet(f"{root}/role_skill_requirements").where("requirement_version = 2")
    assert sorted((r["skill_id"], r["evidence_count"]) for r in reqs.collect()) == [("K-PY", 10), ("K-SQL", 10)]
    from skillgrid.operators import publish
    m = {r["version"]: r["is_current"] for r in publish.read_manifest(spark, root).collect()}
    assert m == {1: True, 2: True}  # different months, both current
    events = spark.read.parquet(f"{root}/app_events").collect()
    assert len(events) == 2 and {e["event_type"] for e in events} == {"ingestion.completed"}
    quarantine = spark.read.parquet(f"{root}/pipeline_rejected_rows").collect()
    assert sorted(r["row_number"] for r in quarantine) == [11, 12]


def test_rerun_same_file_counts_evidence_again(spark, scratch):
    root = os.path.join(scratch, "warehouse")
    valid = _write(scratch, "valid_postings.csv", _rows("05"))
    run_ingestion(spark, valid, root, **_dims(spark))
    r = run_ingestion(spark, valid, root, **_dims(spark))
    posts = spark.read.parquet(f"{root}/job_postings")
    assert posts.count() == 10  # postings reused on the natural key
    assert (r["job_postings_inserted"], r["job_postings_reused_existing"]) == (0, 10)
    assert (r["job_posting_skills_inserted"], r["job_posting_skills_reused_existing"]) == (0, 10)
    assert r["rows_passing_adapter_mapping"] == r["rows_read_from_source"] == r["skill_matches_produced"] == 10
    log = spark.read.parquet(f"{root}/pipeline_job_log").where("action = 'complete'").collect()
    assert [x["processed_rows"] for x in log] == [10, 10]
    reqs = spark.read.parquet(f"{root}/role_skill_requirements").where(f"requirement_version = {r['output_version']}")
    assert sorted(x["evidence_count"] for x in reqs.collect()) == [10, 10]


def test_report_holds_all_counters_of_what_was_written(spark, scratch):
    root = os.path.join(scratch, "warehouse")
    rows = _rows("05")
    rows += [rows[0], rows[1][:3] + [""] + rows[1][4:]]  # a copy, and one without company
    r = run_ingestion(spark, _write(scratch, "some.csv", rows), root, **_dims(spark))
    written = {c: spark.read.parquet(f"{root}/{t}").count() for c, t in (
        ("job_postings_inserted", "job_postings"), ("job_posting_skills_inserted", "job_posting_skills"),
        ("evidence_rows_written", "pipeline_skill_evidence_summary"), ("sdi_snapshots_rows_published", "sdi_snapshots"),
        ("role_skill_requirements_rows_published", "role_skill_requirements"),
        ("rows_rejected_by_validation", "pipeline_rejected_rows"))}
    assert {c: r[c] for c in written} == written
    assert (r["rows_read_from_source"], r["rows_passing_validation"], r["rows_surviving_deduplication"]) == (12, 11, 10)
    assert (r["rows_matched_to_canonical_role"], r["rows_unmatched_to_any_role"]) == (10, 0)
    assert r["pairs_meeting_threshold"] == 2 and r["skill_decay_signals_rows_published"] == 0
    assert r["validation_pass_rate"] == 0.9167


def test_counts_of_empty_steps_are_zero(spark, scratch):
    """No row matches a role: every later step is empty, and its counters are zero."""
    rows = [x[:2] + ["Unknown Trade"] + x[3:] for x in _rows("05")]
    r = run_ingestion(spark, _write(scratch, "none.csv", rows), os.path.join(scratch, "w"), **_dims(spark))
    assert (r["rows_unmatched_to_any_role"], r["rows_matched_to_canonical_role"]) == (10, 0)
    assert r["job_postings_inserted"] == r["evidence_rows_written"] == r["sdi_snapshots_rows_published"] == 0


def test_dry_run_writes_nothing(spark, scratch):
    root = os.path.join(scratch, "dry")
    valid = _write(scratch, "valid_postings.csv", _rows("05"))
    r = run_ingestion(spark, valid, root, dry_run=True, **_dims(spark))
    assert r["role_skill_requirements_rows_published"] == 2
    assert not os.path.exists(root)


def test_foreign_layout_run(spark, scratch):
    root = os.path.join(scratch, "warehouse")
    header = ["posting_id", "platform", "posted_date", "job_title", "company_name", "location",
              "job_description", "job_url", "work_type"]
    rows = [[f"js-{i}", "jobs", "2026-07", "Data Analyst", f"Firm {i}", "Cebu",
             "python3" if i % 2 else "sql queries", f"https://jobs.example/js/{i}", ""] for i in range(12)]
    rows.append(["js-bad", "jobs", "2026-13", "Data Analyst", "Firm X", "Cebu", "python3", "https://x", ""])
    path = _write_any(scratch, "foreign.csv", header, rows)
    r = run_ingestion(spark, path, root, layout="foreign", **_dims(spark))
    assert r["rejected"] == {"INVALID_SOURCE_DATE:posted_date": 1}
    assert r["terminal_status"] == "partial" and r["rows_passing_validation"] == 12
    reqs = spark.read.parquet(f"{root}/role_skill_requirements").collect()
    assert sorted((x["skill_id"], x["evidence_count"]) for x in reqs) == [("K-PY", 6), ("K-SQL", 6)]
    q = spark.read.parquet(f"{root}/pipeline_rejected_rows").first()
    assert '"posted_date":"2026-13"' in q["raw_payload"]


def _write_any(folder, name, header, rows):
    path = os.path.join(folder, name)
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)
    return path


def test_sql_views_over_published_tables(spark, scratch):
    from skillgrid.operators import publish
    root = os.path.join(scratch, "warehouse")
    run_ingestion(spark, _write(scratch, "valid_postings.csv", _rows("05")), root, **_dims(spark))
    views = publish.register_views(spark, root)
    assert "current_monthly_role_requirements" in views
    got = spark.sql("SELECT skill_id, evidence_count FROM current_monthly_role_requirements ORDER BY skill_id").collect()
    assert [(r[0], r[1]) for r in got] == [("K-PY", 5), ("K-SQL", 5)]
    assert spark.sql("SELECT count(*) FROM current_monthly_sdi_snapshots").first()[0] == 2


FAIL_AT = ["materialize", "publish_requirements", "detect_decay"]


@pytest.mark.parametrize("step", FAIL_AT)
def test_failed_run_leaves_nothing_visible(spark, scratch, monkeypatch, step):
    """A run that fails at any step and is repeated gives what one clean run gives."""
    from skillgrid.operators import ops, publish, trend
    from skillgrid.plans import run as run_module
    few = [r[:6] + ["python3" if i < 3 else "sql queries", r[7]] for i, r in enumerate(_rows("05"))]
    path = _write(scratch, "few.csv", few)
    root = "file:" + os.path.join(scratch, "warehouse")  # a root that only Spark resolves
    home = {"materialize": run_module, "run_report": ops, "detect_decay": trend}.get(step, publish)
    real, calls = getattr(home, step), []

    def broken(*args, **kwargs):
        calls.append(1)
        if step != "materialize" or len(calls) == 6:  # after the evidence was written
            if step == "publish_requirements":
                real(*args, **kwargs)
            raise RuntimeError("planned failure")
        return real(*args, **kwargs)

    with monkeypatch.context() as m:
        m.setattr(home, step, broken)
        with pytest.raises(RuntimeError, match="planned failure"):
            run_ingestion(spark, path, root, **_dims(spark))
    assert publish.read_manifest(spark, root).count() == 0
    dry = run_ingestion(spark, path, root, dry_run=True, **_dims(spark))
    live = run_ingestion(spark, path, root, **_dims(spark))
    same = [k for k in live if k not in ("job_id", "report_id")]
    assert {k: dry[k] for k in same} == {k: live[k] for k in same}
    assert live["output_version"] == 1 and live["role_skill_requirements_rows_published"] == 1
    reqs = publish.read_visible(spark, root, publish.REQUIREMENTS).collect()
    assert [(r["skill_id"], r["evidence_count"]) for r in reqs] == [("K-SQL", 7)]
    evidence = publish.read_visible(spark, root, "pipeline_skill_evidence_summary").collect()
    assert sorted((r["skill_id"], r["evidence_count"]) for r in evidence) == [("K-PY", 3), ("K-SQL", 7)]
    assert publish.read_visible(spark, root, "job_postings").count() == 10
    assert publish.read_visible(spark, root, publish.SNAPSHOTS).count() == 1
