import datetime as dt

from pyspark.sql import functions as F

from skillgrid.operators import demand, requirements, trend
from skillgrid.plans import demand_plans
from skillgrid.sources.materialize import PlanContext
from tests.conftest import rows


def test_golden_aggregation(spark):
    # 8 postings of the role; the pair (r, s1) has depths 0.4/0.6/0.8 on 3 postings, prior evidence 2
    rows = [(f"p{i}", "r", "s1", d) for i, d in enumerate([0.4, 0.6, 0.8])]
    rows += [(f"p{i}", "r", "s2", None) for i in range(3, 5)]
    rows += [(f"p{i}", "r", "s3", 0.5) for i in range(5, 8)]
    mapped = spark.createDataFrame(rows, "job_posting_id string, role_id string, skill_id string, normalized_depth double")
    agg = {r["skill_id"]: r for r in requirements.aggregate_role_requirements(mapped).collect()}
    assert set(agg) == {"s1", "s3"}  # the all-null-depth pair writes nothing
    assert agg["s1"]["required_depth"] == 0.6 and agg["s1"]["demand_weight"] == 0.375
    assert agg["s1"]["role_total"] == 8
    prior = spark.createDataFrame([("r", "s1", 2), ("r", "s3", 1)], "role_id string, skill_id string, evidence_count bigint")
    cur = spark.createDataFrame([(r["role_id"], r["skill_id"], r["skill_posting_count"]) for r in agg.values()],
                                "role_id string, skill_id string, evidence_count bigint")
    ev = {r["skill_id"]: r for r in requirements.evidence_against_prior(cur, prior).collect()}
    assert ev["s1"]["cumulative_evidence"] == 5 and ev["s1"]["threshold_met"]
    assert ev["s3"]["cumulative_evidence"] == 4 and not ev["s3"]["threshold_met"]
    pub = requirements.publishable(requirements.aggregate_role_requirements(mapped),
                                   requirements.evidence_against_prior(cur, prior))
    assert [(r["skill_id"], r["evidence_count"]) for r in pub.collect()] == [("s1", 5)]


def test_role_total_override_and_zero_total(spark):
    mapped = spark.createDataFrame([("p1", "r1", "s", 0.5), ("p2", "r2", "s", 0.5)],
                                   "job_posting_id string, role_id string, skill_id string, normalized_depth double")
    totals = spark.createDataFrame([("r1", 4), ("r2", 0)], "role_id string, role_total bigint")
    got = requirements.aggregate_role_requirements(mapped, role_totals=totals).collect()
    assert [(r["role_id"], r["role_total"], r["demand_weight"]) for r in got] == [("r1", 4, 0.25)]


def test_demand_index_formula(spark):
    inputs = spark.createDataFrame(
        [("p1", "r", "s", dt.date(2026, 5, 1)), ("p2", "r", "s", dt.date(2026, 3, 2)),
         ("p3", "r", "t", dt.date(2026, 5, 10)), ("p4", "r", "t", dt.date(2026, 5, 10))],
        "job_posting_id string, role_id string, skill_id string, posted_at date")
    out = {r["skill_id"]: r for r in demand.compute_demand_index(inputs, dt.date(2026, 5, 1)).collect()}
    # s: share 2/4, recency mean(1, 1 - 60/90) = 2/3, growth 0.5 -> 0.25 + 0.2 + 0.1
    assert out["s"]["frequency_share"] == 0.5 and out["s"]["recency_score"] == 0.6667
    assert out["s"]["demand_index"] == 0.55
    prev = spark.createDataFrame([("r", "s", 0.9)], "role_id string, skill_id string, previous_share double")
    g = {r["skill_id"]: r for r in demand.compute_demand_index(inputs, dt.date(2026, 5, 1),
                                                               previous_shares=prev).collect()}
    assert g["s"]["growth_score"] == 0.3 and g["t"]["growth_score"] == 0.5


def test_previous_window():
    assert demand.previous_window(dt.date(2026, 5, 1), dt.date(2026, 5, 31)) == (dt.date(2026, 3, 31), dt.date(2026, 4, 30))


def _snaps(spark, values, start=3):
    rows = [("r", "s", v, dt.date(2026, start + i, 1), i + 1) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "role_id string, skill_id string, demand_index double, snapshot_date date, "
                                       "requirement_version int")


def test_decay_thresholds(spark):
    assert trend.detect_decay(_snaps(spark, [0.9, 0.65])).count() == 0
    assert trend.detect_decay(_snaps(spark, [0.70, 0.65, 0.61])).count() == 0
    got = trend.detect_decay(_snaps(spark, [0.90, 0.65, 0.40])).collect()
    assert [(r["decay_rate"], r["confidence"], r["requirement_version"]) for r in got] == [(-0.25, 1.0, 3)]
    # only the newest three points count
    got = trend.detect_decay(_snaps(spark, [0.1, 0.2, 0.90, 0.65, 0.40], start=1)).collect()
    assert [r["decay_rate"] for r in got] == [-0.25]


def test_rolling_decay_matches_point_in_time(spark):
    s = _snaps(spark, [0.95, 0.90, 0.65, 0.40], start=2)
    got = sorted((r["requirement_version"], r["decay_rate"]) for r in trend.rolling_decay(s).collect())
    assert got == [(3, -0.15), (4, -0.25)]


def test_flagship_plan_on_small_tables(spark):
    from tests.conftest import SF
    df = demand_plans.demand_index(spark, SF)
    rows = df.collect()
    assert rows and all(0.0 <= r["demand_index"] <= 1.0 for r in rows)


def test_evidence_partitions_grow_with_the_hits(spark):
    """A task collapses a fixed number of hits, so its groups stay small at any size."""
    n = 3_000
    hits = spark.range(n).select(
        (F.col("id") % 700).alias("job_posting_id"), (F.col("id") % 7).alias("role_id"),
        (F.col("id") % 11).alias("skill_id"), F.lit(0.5).alias("normalized_depth"),
        F.lit(dt.date(2026, 1, 1)).alias("posted_at"))
    laid_out = requirements.posting_skill_evidence(hits, n_hits=4 * requirements.HITS_PER_TASK - 1)
    assert laid_out.rdd.getNumPartitions() == 4
    assert rows(laid_out) == rows(requirements.posting_skill_evidence(hits))
    assert requirements.posting_skill_evidence(hits, n_hits=0).count() == len(rows(laid_out))


def test_evidence_of_the_tables_counts_its_lines(spark, scratch):
    """The plan hands the lines' number on: every line's hit is in the evidence, in as many partitions as they ask for."""
    def write(name, data, schema):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{scratch}/{name}.parquet")

    day = dt.datetime(1996, 1, 1)
    write("customer", [(1, 3)], "c_custkey long, c_nationkey int")
    write("orders", [(k, 1, "F", day) for k in range(40)],
          "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp")
    write("lineitem", [(k, p, 5.0, "R") for k in range(40) for p in (1, 2)],
          "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string")
    write("part", [(1, "B1"), (2, "B2")], "p_partkey long, p_brand string")
    seen = []
    old = requirements.posting_skill_evidence

    def spy(mapped, **given):
        seen.append(given["n_hits"])
        return old(mapped, **given)

    requirements.posting_skill_evidence = spy
    try:
        got = demand_plans.evidence(PlanContext(spark, scratch))
    finally:
        requirements.posting_skill_evidence = old
    assert seen == [80] and got.count() == 80
