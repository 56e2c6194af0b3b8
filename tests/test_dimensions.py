import os

from skillgrid.operators import publish
from skillgrid.sources import dimensions as D


def test_load_dimension_and_size_check(spark, scratch):
    path = os.path.join(scratch, "skills.csv")
    with open(path, "w") as f:
        f.write("skill_id,name,is_active\nK1,Python,true\nK2,SQL,false\n")
    df = D.load_dimension(spark, path, "csv", "skill_id string, name string, is_active boolean")
    assert sorted(r["skill_id"] for r in df.collect()) == ["K1", "K2"]
    assert D.check_dimension_size(df, max_rows=5) is df
    try:
        D.check_dimension_size(df, max_rows=1, name="skills")
        raise AssertionError("expected a size error")
    except ValueError as e:
        assert "skills" in str(e)


def test_dimension_upsert_inserts_new_keys_only(spark):
    stored = spark.createDataFrame([("python", "K1")], "normalized_alias string, skill_id string")
    incoming = spark.createDataFrame([("python", "K9"), ("sql", "K2")], "normalized_alias string, skill_id string")
    new = publish.new_rows(incoming, stored, ["normalized_alias"]).collect()
    assert [(r["normalized_alias"], r["skill_id"]) for r in new] == [("sql", "K2")]


def test_sql_values_matches_literals():
    sql = D.sql_values([("a'b", None, True, 2)], ["x", "y", "z", "n"])
    assert sql == "(VALUES ('a''b', NULL, TRUE, 2)) AS t(x, y, z, n)"


def test_lineage_and_retention(spark):
    import datetime as dt
    m = publish.derive_current(spark.createDataFrame(
        [(1, "a", dt.date(2026, 5, 1)), (2, "b", dt.date(2026, 5, 1)), (3, "c", dt.date(2026, 6, 1)),
         (4, "d", dt.date(2026, 5, 1))], "version int, dataset_id string, period_month date"))
    lin = sorted((r["requirement_version"], r["lineage_position"], r["dataset_id"])
                 for r in publish.lineage_from_revisions(m).collect())
    assert lin == [(1, 1, "a"), (2, 1, "b"), (2, 2, "a"), (3, 1, "c"), (4, 1, "d"), (4, 2, "b")]
    keep = {r["version"]: r["keep_online"] for r in publish.retention_plan(m, keep_previous=1).collect()}
    assert keep == {1: False, 2: False, 3: True, 4: True}
