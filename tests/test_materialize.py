from skillgrid.sources.materialize import PlanContext
from skillgrid.sources.tables import mapped_fact, table
from tests.conftest import SF


def test_shared_fact_is_written_and_derived_side_is_lazy(spark):
    ctx = PlanContext(spark, SF)
    build = lambda: mapped_fact(spark, SF).groupBy("role_id").count()
    written, lazy = ctx.table("t", build), ctx.derived("d", build)
    assert sorted(lazy.collect()) == sorted(written.collect())
    assert ctx.table("t", build) is written and ctx.derived("d", build) is lazy
    assert "Relation" in written._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" not in written._jdf.queryExecution().analyzed().toString()


def test_table_adds_no_exchange(spark):
    df = table(spark, SF, "lineitem", "l_orderkey")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_shuffles_of_a_written_fact_are_freed(spark):
    """The files of a table's shuffles go when it is written, not at some garbage collection (F1)."""
    import time

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    plan = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    before = shuffles()
    written = PlanContext(spark, SF).table("freed", lambda: plan)
    for _ in range(20):
        left = shuffles() - before
        if not left:
            break
        time.sleep(0.5)
    assert not left and written.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
