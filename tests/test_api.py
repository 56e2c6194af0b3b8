"""Library calls that the registered queries do not use directly."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from skillgrid.operators import dedup, demand, ingest, ops, publish, requirements, resolve, student


def test_reads_and_retention(spark, scratch):
    m = publish.derive_current(spark.createDataFrame(
        [(1, "a", dt.date(2026, 6, 1)), (2, "b", dt.date(2026, 5, 1))], "version int, dataset_id string, period_month date"))
    assert publish.current_version(m).first()["version"] == 2          # highest current version (B9)
    assert publish.latest_month_version(m).first()["version"] == 1     # newest month instead
    sig = spark.createDataFrame([("r1", "s", True), ("r2", "s", True), ("r1", "t", False)],
                                "role_id string, skill_id string, is_active boolean")
    assert publish.active_signals_by_role(sig, "r1").count() == 1      # S13
    rej = spark.createDataFrame([(1, dt.date(2026, 1, 1)), (2, dt.date(2026, 6, 1))], "row_number int, created_at date")
    keep = {r["row_number"]: r["keep"] for r in publish.rejected_row_retention(rej, dt.date(2026, 7, 1)).collect()}
    assert keep == {1: False, 2: True}                                  # X9, 180 days


def test_small_helpers(spark, scratch):
    df = spark.createDataFrame([("r", "s"), ("r", "s"), ("r", "t")], "role_id string, skill_id string")
    assert dedup.distinct_pairs(df).count() == 2                        # U2
    totals = spark.createDataFrame([("r", 0), ("q", 3)], "role_id string, role_total bigint")
    assert [r["role_id"] for r in requirements.skipped_roles(totals).collect()] == ["r"]  # P11 side output
    posts = spark.createDataFrame([("d1", dt.date(2026, 5, 20)), ("d1", dt.date(2026, 6, 3))],
                                  "dataset_id string, posted_at date")
    assert demand.dataset_period_month(posts).first()["period_month"] == dt.date(2026, 6, 1)  # A9
    reg = ops.register_datasets(spark.createDataFrame([("/x.csv", "csv")], "path string, source string")).first()
    assert reg["dataset_id"] == hashlib.sha256(b"/x.csv").hexdigest() and reg["status"] == "uploaded"  # K1
    ex = spark.createDataFrame([(1, " a "), (2, ""), (3, "a"), (4, "b")], "n int, v string")
    assert [r["example"] for r in ops.blank_examples(ex, "v", "n").collect()] == ["a", "b"]  # A14
    req = spark.createDataFrame([("k1",), ("k2",)], "result_key string")
    have = spark.createDataFrame([("k1",)], "result_key string")
    assert [r[0] for r in student.results_to_compute(req, have).collect()] == ["k2"]  # X7


def test_quarantine_sink_and_boundary_pattern(spark, scratch):
    rows = spark.createDataFrame([(1, "x", "EMPTY_REQUIRED_FIELD:url")], "source_row_number int, url string, reason string")
    path = f"{scratch}/rejected"
    ingest.write_quarantine(ingest.quarantine_rows(rows, "job-1"), path)
    assert spark.read.parquet(path).where("pipeline_job_id = 'job-1'").count() == 1  # K2, partitioned by job
    p = resolve.boundary_pattern("c++")
    t = spark.createDataFrame([("c++ dev",), ("abc++",), ("c++.",)], "t string")
    assert [r[0] for r in t.select(F.col("t").rlike(p)).collect()] == [True, False, False]
    hits = spark.createDataFrame([(1, "s", 2, "b"), (1, "t", 0, "a")], "doc_id int, skill_id string, signal_pos int, match_key string")
    assert [r["skill_id"] for r in resolve.hits_in_row_order(hits, posting="doc_id").collect()] == ["t", "s"]  # W8
