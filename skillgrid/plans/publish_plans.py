"""Query plans for the publish chain over all runs at once (Q17-Q22).

A *run* is one dataset file: here the orders of one status in one month
(``dataset_id`` = ``F-1996-03``).  Runs are published in month order, so the
snapshot history stored when a version is published is exactly the rows that
come before it in (snapshot_date, version) order, and the decay trend at
publish time is a sliding frame over that history.

The whole chain - evidence, cumulative threshold, version manifest,
snapshots, decay signals - is one set of DataFrame jobs over every run,
instead of one run at a time.  The chain ends in published tables, in
folders by version, and a manifest of one row per publish.  The reads below it
(current, prepared, active) see only those tables: a read of one version opens
its folder, a read of the monthly currents those of the current versions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillgrid.functions.scores import EVIDENCE_THRESHOLD
from skillgrid.operators import dedup, demand, publish, requirements, trend
from skillgrid.plans import demand_plans
from skillgrid.sources.materialize import FOLDER, PlanContext
from skillgrid.sources.tables import posting_rows

STORED_BEFORE = dt.date(1998, 1, 1)
INCOMING_FROM = dt.date(1997, 1, 1)
PREPARED_ROLE = 8  # of the reads for one role


def _run_dataset(status: str = "dataset_id", month: str = "period_month"):
    return F.concat(F.col(status), F.lit("-"), F.date_format(F.col(month), "yyyy-MM"))


# ---------------------------------------------------------------- shared pieces

def manifest_of(ctx: PlanContext) -> DataFrame:
    def build():
        posts = posting_rows(ctx.spark, ctx.sf_dir).withColumn("run_dataset", _run_dataset())
        runs = posts.groupBy("run_dataset", F.col("dataset_id").alias("status")).agg(
            F.count(F.lit(1)).alias("n_postings"),
            F.trunc(F.max("posted_at"), "month").alias("period_month"))
        return publish.allocate_versions(runs.withColumnRenamed("run_dataset", "dataset_id"),
                                         order=["period_month", "status"])
    return ctx.table("manifest", build)


def versioned_evidence(ctx: PlanContext) -> DataFrame:
    mf = manifest_of(ctx).select(F.col("dataset_id").alias("run_dataset"),
                                 F.col("version").alias("requirement_version"))
    ev = demand_plans.evidence(ctx)
    return ev.withColumn("run_dataset", _run_dataset()).join(mf, "run_dataset")


def published_requirements_of(ctx: PlanContext) -> DataFrame:
    def build():
        per_run = requirements.requirements_from_evidence(versioned_evidence(ctx), by=("requirement_version",))
        w = (Window.partitionBy("role_id", "skill_id").orderBy("requirement_version")
             .rowsBetween(Window.unboundedPreceding, 0))
        cum = per_run.withColumn("evidence_count", F.sum("skill_posting_count").over(w).cast("bigint"))
        return cum.where(F.col("evidence_count") >= EVIDENCE_THRESHOLD).select(
            "requirement_version", "role_id", "skill_id", "required_depth", "demand_weight", "evidence_count")
    return ctx.published(publish.REQUIREMENTS, build)


def snapshots_for(ctx: PlanContext, pairs: DataFrame) -> DataFrame:
    by = ("requirement_version", "period_month")
    inputs = demand.inputs_from_evidence(versioned_evidence(ctx), pairs, by=by)
    snap = demand.compute_demand_index(inputs, "period_month", by=by)
    return snap.select("role_id", "skill_id", F.col("period_month").alias("snapshot_date"), "requirement_version",
                       "frequency_share", "recency_score", "growth_score", "demand_index")


def published_snapshots_of(ctx: PlanContext) -> DataFrame:
    def build():
        pairs = ctx.derived("published-pairs", lambda: published_requirements_of(ctx).select(
            "requirement_version", "role_id", "skill_id"))
        return snapshots_for(ctx, pairs)
    return ctx.published(publish.SNAPSHOTS, build)


def published_signals_of(ctx: PlanContext) -> DataFrame:
    """Decay signals as each version was published (sliding trend, W3-W5)."""
    return ctx.published(publish.SIGNALS, lambda: trend.rolling_decay(published_snapshots_of(ctx).drop(FOLDER)))


# ---------------------------------------------------------------- registered plans

def version_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q17: one version per run, revisions within a month, current flag."""
    return manifest_of(PlanContext(spark, sf_dir))


def published_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirement rows of every version: per-run aggregates whose cumulative
    evidence over earlier versions reaches the threshold (A1-A4, K5, P12)."""
    return published_requirements_of(PlanContext(spark, sf_dir)).drop(FOLDER)


def published_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of every version, for that version's published pairs."""
    return published_snapshots_of(PlanContext(spark, sf_dir)).drop(FOLDER)


def published_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decay signals of every version, as published."""
    return published_signals_of(PlanContext(spark, sf_dir)).drop(FOLDER)


def lineage_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q18: versions each dataset contributed to."""
    manifest = manifest_of(PlanContext(spark, sf_dir))
    return publish.versions_by_dataset(manifest, publish.lineage_from_revisions(manifest))


def current_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements of the current version of every month."""
    ctx = PlanContext(spark, sf_dir)
    return publish.current_rows(published_requirements_of(ctx), manifest_of(ctx))


def current_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q19 R2: snapshots of the current version of every month."""
    ctx = PlanContext(spark, sf_dir)
    return publish.current_rows(published_snapshots_of(ctx), manifest_of(ctx))


def current_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active decay signals of the current version of every month."""
    ctx = PlanContext(spark, sf_dir)
    manifest = manifest_of(ctx)
    # the current version is the newest of its month, so the flag is decided among the rows it leaves
    rows = publish.current_rows(published_signals_of(ctx), manifest)
    flagged = publish.active_signals(rows.drop("period_month"), manifest).where("is_active")
    return flagged.select("role_id", "skill_id", "requirement_version", "decay_rate", "confidence", "detected_at",
                          "is_active", "period_month", "period_revision")


def current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest version flagged current (one row)."""
    return publish.current_version(manifest_of(PlanContext(spark, sf_dir))).select(
        "version", "dataset_id", "period_month", "period_revision")


def prepared_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirement rows of the current version, all roles."""
    ctx = PlanContext(spark, sf_dir)
    return publish.rows_of_version(published_requirements_of(ctx), publish.current_version(manifest_of(ctx)))


def prepared_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot rows of the current version, all roles."""
    ctx = PlanContext(spark, sf_dir)
    return publish.rows_of_version(published_snapshots_of(ctx), publish.current_version(manifest_of(ctx)))


def prepared_role_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirement rows of the current version for one role."""
    ctx = PlanContext(spark, sf_dir)
    return publish.rows_of_version(published_requirements_of(ctx), publish.current_version(manifest_of(ctx)),
                                   role_id=PREPARED_ROLE)


def prepared_role_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot rows of the current version for one role."""
    ctx = PlanContext(spark, sf_dir)
    return publish.rows_of_version(published_snapshots_of(ctx), publish.current_version(manifest_of(ctx)),
                                   role_id=PREPARED_ROLE)


def active_role_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active decay signals of one role, every month; inactive ones stay out."""
    ctx = PlanContext(spark, sf_dir)
    flagged = publish.active_signals(published_signals_of(ctx), manifest_of(ctx))
    return publish.active_signals_by_role(flagged, PREPARED_ROLE).select(
        "role_id", "skill_id", "requirement_version", "period_month", "decay_rate", "confidence", "detected_at")


def active_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q21: every published signal with its derived active flag."""
    ctx = PlanContext(spark, sf_dir)
    return publish.active_signals(published_signals_of(ctx), manifest_of(ctx)).select(
        "role_id", "skill_id", "requirement_version", "period_month", "decay_rate", "confidence",
        "detected_at", "is_active")


def snapshot_publish_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q20: republishing every version's snapshots with the whole-table pair set
    against the stored snapshots: new / same / conflict (K8)."""
    ctx = PlanContext(spark, sf_dir)
    incoming = snapshots_for(ctx, demand_plans.pairs_of(ctx))
    return publish.snapshot_publish_plan(incoming, published_snapshots_of(ctx).drop(FOLDER), manifest_of(ctx))


def insert_or_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q22: postings from 1997 on against postings stored before 1998 on the
    natural key (K3, K4, J10, U1)."""
    posts = posting_rows(spark, sf_dir).select(
        F.col("dataset_id").alias("source"), "title", F.col("company_key").cast("string").alias("company"),
        "posted_at", "role_id", "job_posting_id")
    keys = ["source", "title", "company", "posted_at"]
    stored = dedup.first_per_key(posts.where(F.col("posted_at") < F.lit(STORED_BEFORE)), keys, "job_posting_id")
    stored = stored.withColumn("posting_id", publish.name_based_id(*keys))
    incoming = dedup.first_per_key(posts.where(F.col("posted_at") >= F.lit(INCOMING_FROM)), keys, "job_posting_id")
    return publish.insert_or_get(incoming, stored, keys=keys).drop("job_posting_id")
