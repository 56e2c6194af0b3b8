"""Query plans over stored records: dataset registry, evidence of runs, review
actions, version checks, validation summaries and the student's latest results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.functions.text import name_based_id
from skillgrid.operators import ingest, ops, quality, requirements, resolve, student, trend
from skillgrid.plans import demand_plans, ops_plans, publish_plans
from skillgrid.sources import dimensions as D
from skillgrid.sources.materialize import PlanContext
from skillgrid.sources.tables import foreign_postings, table

REGISTERED_BEFORE = dt.date(1996, 1, 1)
RUN_MONTH = dt.date(1995, 6, 1)
STORED_UNTIL = dt.date(1995, 9, 1)
CHECKED_VERSION = 199506
RESULTS_BEFORE = dt.date(1997, 1, 1)


def dataset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q36: files (a status and month of orders each) not yet registered, each once (K1)."""
    o = table(spark, sf_dir, "orders", "o_orderstatus", "o_orderdate")
    files = o.select(
        F.concat_ws("/", F.lit("postings"), "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM")).alias("path"),
        F.col("o_orderstatus").alias("source"), "o_orderdate")
    stored = ops.register_datasets(files.where(F.col("o_orderdate") < F.lit(REGISTERED_BEFORE))).distinct()
    return ops.new_datasets(files, stored)


def decaying_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q37: every snapshot of the pairs with a decay signal."""
    series = demand_plans.series_of(PlanContext(spark, sf_dir))
    return trend.snapshot_history(series, trend.detect_decay(series)).select(
        "role_id", "skill_id", "snapshot_date", "requirement_version", "demand_index")


def _evidence_of_runs(ctx: PlanContext) -> DataFrame:
    """One row per (month, role, skill): a run is a posting month."""
    return requirements.requirements_from_evidence(demand_plans.evidence(ctx), by=("period_month",)).select(
        "period_month", "role_id", "skill_id", F.col("skill_posting_count").cast("bigint").alias("evidence_count"))


def run_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q38: one run's evidence against the stored rows of the runs before it, 0 where there is none."""
    runs = _evidence_of_runs(PlanContext(spark, sf_dir))
    return requirements.evidence_against_prior(
        runs.where(F.col("period_month") == F.lit(RUN_MONTH)).drop("period_month"),
        runs.where(F.col("period_month") < F.lit(RUN_MONTH)))


def evidence_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the runs from one month on that is stored already and must not be written again (K5)."""
    runs = _evidence_of_runs(PlanContext(spark, sf_dir))
    return requirements.stored_already(runs.where(F.col("period_month") >= F.lit(RUN_MONTH)),
                                       runs.where(F.col("period_month") < F.lit(STORED_UNTIL)),
                                       keys=("period_month", "role_id", "skill_id"))


def job_evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run the evidence rows, postings behind them, and pairs at and below the threshold."""
    return requirements.evidence_summary(demand_plans.cumulative_evidence(spark, sf_dir), run="period_month")


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q38d: the report of a run with all its counters.

    Rows up to the role come from the documents, postings from the insert-or-get
    of the orders, and what is written from the evidence of one posting month;
    a posting's skill is stored already when the posting came by file F."""
    ctx = PlanContext(spark, sf_dir)
    validated, _, resolved, hits = ops_plans._document_run(spark, sf_dir)
    ok = F.col("reason").isNull()
    month = demand_plans.evidence(ctx).where(F.col("period_month") == F.lit(RUN_MONTH))
    runs = requirements.cumulative_evidence(
        requirements.requirements_from_evidence(demand_plans.evidence(ctx), by=("period_month",)), run="period_month")
    evidence = runs.where(F.col("period_month") == F.lit(RUN_MONTH))
    series = demand_plans.series_of(ctx)
    stages = [
        ("read", validated, ok), ("adapted", ingest.adapt_foreign(foreign_postings(spark, sf_dir)), ok),
        ("deduplicated", resolved, F.col("role_id").isNotNull()), ("skill_match", hits, None),
        ("posting", publish_plans.insert_or_get(spark, sf_dir), F.col("inserted")),
        ("posting_skill", month, F.col("dataset_id") != "F"),
        ("evidence", evidence, F.col("threshold_met")), ("requirement", evidence.where("threshold_met"), None),
        ("snapshot", series.where(F.col("snapshot_date") == F.lit(RUN_MONTH)), None),
        ("signal", trend.detect_decay(series), None),
    ]
    out = None
    for name, rows, flag in stages:
        counted = ops.stage_counter(rows, name, flag)
        out = counted if out is None else out.unionByName(counted)
    return ops.full_run_report(out)


def requirements_with_given_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q39: requirements by totals given for some roles (A2); roles given none are left out."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    orders = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("role_id")).agg(
        F.count(F.lit(1)).alias("n"))
    given = orders.where(F.col("role_id") % 2 == 0).select(
        "role_id", F.when(F.col("role_id") % 5 == 0, F.lit(0)).otherwise(F.col("n")).cast("bigint").alias("role_total"))
    return requirements.requirements_from_evidence(demand_plans.evidence(PlanContext(spark, sf_dir)), role_totals=given)


def version_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q40: publish rules of the monthly snapshots when one version is asked for (P10)."""
    series = demand_plans.series_of(PlanContext(spark, sf_dir))
    return quality.publish_rules(series, "sdi_snapshots", version=CHECKED_VERSION)


def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q41: review actions asked for on part-name aliases, and whether each is allowed."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    asked = p.select("p_partkey", resolve.normalize_key("p_name").alias("normalized_alias"),
                     F.element_at(F.array(*[F.lit(a) for a in ("approve", "dismiss", "reopen")]),
                                  (F.col("p_size") % 3 + 1).cast("int")).alias("action"))
    known = D.role_aliases_df(spark).select("normalized_alias", "role_id", "reviewed")
    j = asked.join(known, "normalized_alias", "left")
    return j.select("p_partkey", "normalized_alias", "action", "role_id",
                    quality.review_state("reviewed", "role_id").alias("review_state"),
                    quality.review_action_valid("action", "role_id").alias("action_valid"))


def dataset_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q42: per layout the required columns found and missing, and rows valid and rejected."""
    parts = [ingest.validation_report(foreign_postings(spark, sf_dir, with_url=url), name)
             for name, url in (("with_url", True), ("without_url", False))]
    return parts[0].unionByName(parts[1])


def _results(ctx: PlanContext) -> DataFrame:
    """One analysis result per student, target role and order date (the profile's version)."""
    o = table(ctx.spark, ctx.sf_dir, "orders", "o_custkey", "o_orderdate")
    days = o.select(F.col("o_custkey").alias("student_id"), F.col("o_orderdate").cast("date").alias("created_at")).distinct()
    targets = ops_plans._student_inputs(ctx)[0]
    version = F.date_format("created_at", "yyyyMMdd")
    return targets.join(days, "student_id").select(
        "student_id", "role_id", version.alias("profile_version"), "created_at",
        student.result_key("student_id", "role_id", version, F.lit("1")).alias("result_key"))


def results_to_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q43: results asked for that are not stored yet."""
    r = _results(PlanContext(spark, sf_dir))
    return student.results_to_compute(r, r.where(F.col("created_at") < F.lit(RESULTS_BEFORE)))


def readiness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q44: per student and target role the latest result, its readiness and the number of top gaps."""
    ctx = PlanContext(spark, sf_dir)
    return student.readiness_summary(_results(ctx), ops_plans._gaps(ctx))
