import datetime as dt
import re

from skillgrid.operators import publish
from skillgrid.plans import publish_plans
from skillgrid.sources import materialize
from tests.conftest import SF


def _req(spark):
    return spark.createDataFrame([("r", "s", 0.6, 0.375, 5)],
                                 "role_id string, skill_id string, required_depth double, demand_weight double, "
                                 "evidence_count bigint")


def test_month_scoped_versions(spark, scratch):
    may, june = dt.date(2026, 5, 1), dt.date(2026, 6, 1)
    v1 = publish.publish_requirements(spark, scratch, _req(spark), dataset_id="d-may", period_month=may,
                                      extra_dataset_ids=["d-extra", "d-may"])
    v2 = publish.publish_requirements(spark, scratch, _req(spark), dataset_id="d-june", period_month=june)
    v3 = publish.publish_requirements(spark, scratch, _req(spark), dataset_id="d-may2", period_month=may)
    assert (v1, v2, v3) == (1, 2, 3)
    m = {r["version"]: r for r in publish.read_manifest(spark, scratch).collect()}
    assert [m[v]["is_current"] for v in (1, 2, 3)] == [False, True, True]
    assert [m[v]["period_revision"] for v in (1, 2, 3)] == [1, 1, 2]
    cur = publish.current_version(publish.read_manifest(spark, scratch)).first()
    assert cur["version"] == 3
    lineage = spark.read.parquet(f"{scratch}/{publish.LINEAGE}").where("requirement_version = 1")
    assert sorted((r["lineage_position"], r["dataset_id"]) for r in lineage.collect()) == [(1, "d-may"), (2, "d-extra")]
    reqs = spark.read.parquet(f"{scratch}/{publish.REQUIREMENTS}")
    view = publish.current_rows(reqs, publish.read_manifest(spark, scratch))
    assert sorted(r["requirement_version"] for r in view.collect()) == [2, 3]


def test_month_start_rule(spark, scratch):
    try:
        publish.publish_requirements(spark, scratch, _req(spark), dataset_id="d", period_month=dt.date(2026, 5, 2))
        raise AssertionError("expected an error")
    except ValueError:
        pass


def test_snapshot_publish_plan(spark):
    manifest = spark.createDataFrame([(1, "d", dt.date(2026, 5, 1), 1, True)],
                                     "version int, dataset_id string, period_month date, period_revision int, "
                                     "is_current boolean")
    schema = "role_id string, skill_id string, snapshot_date date, requirement_version int, demand_index double"
    stored = spark.createDataFrame([("r", "a", dt.date(2026, 5, 1), 1, 0.6), ("r", "b", dt.date(2026, 5, 1), 1, 0.5)],
                                   schema)
    incoming = spark.createDataFrame([("r", "a", dt.date(2026, 5, 1), 1, 0.7), ("r", "b", dt.date(2026, 5, 1), 1, 0.5),
                                      ("r", "c", dt.date(2026, 5, 1), 1, 0.2), ("r", "d", dt.date(2026, 6, 1), 1, 0.2)],
                                     schema)
    plan = {r["skill_id"]: r["publish_status"] for r in publish.snapshot_publish_plan(incoming, stored, manifest).collect()}
    assert plan == {"a": "conflict", "b": "same", "c": "new", "d": "off_month"}
    try:
        publish.assert_publishable(publish.snapshot_publish_plan(incoming, stored, manifest))
        raise AssertionError("expected a conflict")
    except ValueError:
        pass


def test_active_signal_flag(spark):
    manifest = spark.createDataFrame([(1, dt.date(2026, 5, 1)), (2, dt.date(2026, 5, 1)), (3, dt.date(2026, 6, 1))],
                                     "version int, period_month date")
    sig = spark.createDataFrame([("r", "s", 0.25, 0.9, 1), ("r", "s", -0.3, 0.9, 2), ("r", "s", -0.2, 0.8, 3)],
                                "role_id string, skill_id string, decay_rate double, confidence double, "
                                "requirement_version int")
    got = {r["requirement_version"]: (r["is_active"], r["decay_rate"])
           for r in publish.active_signals(sig, manifest).collect()}
    assert got == {1: (False, -0.25), 2: (True, -0.3), 3: (True, -0.2)}


def test_insert_or_get(spark):
    stored = spark.createDataFrame([("s", "t", "c", "r1", "id-1")],
                                   "source string, title string, company string, role_id string, posting_id string")
    inc = spark.createDataFrame([("s", "t", "c", "r1"), ("s", "t", "d", "r1")],
                                "source string, title string, company string, role_id string")
    got = {r["company"]: r for r in publish.insert_or_get(inc, stored, keys=["source", "title", "company"]).collect()}
    assert got["c"]["posting_id"] == "id-1" and not got["c"]["inserted"]
    assert got["d"]["inserted"] and len(got["d"]["posting_id"]) == 64
    bad = spark.createDataFrame([("s", "t", "c", "r2")], "source string, title string, company string, role_id string")
    assert publish.insert_or_get(bad, stored, keys=["source", "title", "company"]).first()["role_mismatch"]


def _plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_prepared_reads_open_one_version_and_no_raw_table(spark):
    for name in ("prepared_requirements", "prepared_snapshots", "prepared_role_requirements", "prepared_role_snapshots"):
        df = getattr(publish_plans, name)(spark, SF)
        plan = _plan(df)
        assert re.search(r"PartitionFilters: \[.*version_folder#\d+ = Subquery", plan), name
        assert not re.search(r"(lineitem|orders|customer|part)\.parquet", plan), name
        if "role_" in name.removeprefix("prepared"):
            assert re.search(r"PushedFilters: \[.*role_id", plan), name
        versions = {r.requirement_version for r in df.collect()}
        assert len(versions) <= 1
    for name in ("current_requirements", "current_snapshots", "current_signals"):
        plan = _plan(getattr(publish_plans, name)(spark, SF))
        assert "dynamicpruning" in plan and not re.search(r"(lineitem|orders|customer|part)\.parquet", plan), name


def test_read_of_one_version_reads_one_folder(spark, scratch):
    rows = [(v, r, f"s{v}", 0.5) for v in (1, 20, 33) for r in (7, 8)]
    df = spark.createDataFrame(rows, "requirement_version int, role_id long, skill_id string, required_depth double")
    stored = materialize.write_by_version(df, f"{scratch}/t")
    assert stored.columns == [*df.columns, materialize.FOLDER] and stored.count() == 6
    manifest = spark.createDataFrame([(1, True), (20, True), (33, False)], "version int, is_current boolean")
    got = publish.rows_of_version(stored, publish.current_version(manifest), role_id=7)
    assert [tuple(r) for r in got.collect()] == [(20, 7, "s20", 0.5)] and len(got.inputFiles()) == 3
    none = publish.rows_of_version(stored, publish.current_version(manifest.where("version > 50")))
    assert none.count() == 0
    assert materialize.write_by_version(df.limit(0), f"{scratch}/e").count() == 0


def test_versions_are_numbered_without_a_window_over_all(spark):
    runs = [(f"d{i % 3}-{i}", dt.date(2020 + i // 12, i % 12 + 1, 1), "FOP"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(runs, "dataset_id string, period_month date, status string").repartition(7)
    out = publish.allocate_versions(df, ["period_month", "status"], base_version=10)
    got = {r.dataset_id: (r.version, r.period_revision, r.is_current) for r in out.collect()}
    want = sorted(runs, key=lambda r: (r[1], r[2]))
    assert got == {r[0]: (11 + i, 1, True) for i, r in enumerate(want)}
    assert "SinglePartition" not in out._jdf.queryExecution().toString()


def test_retention_is_one_rule(spark):
    rows = [(v, dt.date(2026, 1 + v // 4, 1), v % 4 == 3) for v in range(1, 12)]
    m = spark.createDataFrame(rows, "version int, period_month date, is_current boolean")
    kept = {r.version for r in publish.retention_plan(m).where("keep_online").collect()}
    assert kept == {3, 7, 8, 9, 10, 11}
