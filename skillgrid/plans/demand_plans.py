"""Query plans over the mapped posting fact: requirements, evidence, demand, trend.

Each registered plan takes ``(spark, sf_dir)`` and returns a DataFrame.  The
posting fact (lineitem ⋈ orders ⋈ customer ⋈ part) is collapsed once per query
into the evidence table - one row per (role, posting, skill) with its dataset,
month, depth sums and date - written under the shared checkpoint folder.
Every aggregate below reads that table, so the four-way join and its shuffle
happen once however many branches the plan has.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.functions.scores import EVIDENCE_THRESHOLD
from skillgrid.operators import demand, requirements, trend
from skillgrid.sources.materialize import PlanContext
from skillgrid.sources.tables import mapped_fact, table

SNAPSHOT_DATE = dt.date(1995, 6, 1)
CURRENT_WINDOW = (dt.date(1997, 1, 1), dt.date(1997, 12, 31))
# dataset and month depend only on the posting, so they ride along in the
# evidence key without changing its grain
EVIDENCE_BY = ("dataset_id", "period_month")


def version_of_month(month_col: str = "period_month"):
    """Version number of a monthly publish: yyyymm as an integer."""
    return F.date_format(F.col(month_col), "yyyyMM").cast("int")


# ---------------------------------------------------------------- shared pieces

def evidence(ctx: PlanContext) -> DataFrame:
    """The evidence table; a hit is a line, and lines are counted from the file footers."""
    return ctx.table("posting-skill-evidence", lambda: requirements.posting_skill_evidence(
        mapped_fact(ctx.spark, ctx.sf_dir), by=EVIDENCE_BY, n_hits=table(ctx.spark, ctx.sf_dir, "lineitem").count()))


def requirements_of(ctx: PlanContext) -> DataFrame:
    return requirements.requirements_from_evidence(evidence(ctx))


def pairs_of(ctx: PlanContext) -> DataFrame:
    """Pairs meeting the evidence threshold in the whole-table run (bounded by
    roles x skills).  The same pairs as the published requirement rows: a pair
    with a non-null mean depth and enough postings; a role that has evidence
    always has a positive total, so no per-role branch is needed."""
    def build():
        return (evidence(ctx).groupBy("role_id", "skill_id")
                .agg(F.count(F.lit(1)).alias("n"), F.sum("depth_n").alias("depth_n"))
                .where((F.col("n") >= EVIDENCE_THRESHOLD) & (F.col("depth_n") > 0))
                .select("role_id", "skill_id"))
    return ctx.derived("required-pairs", build)


def series_of(ctx: PlanContext) -> DataFrame:
    inputs = demand.inputs_from_evidence(evidence(ctx), pairs_of(ctx), by=("period_month",))
    prev = demand.previous_month_shares(demand.pair_shares(inputs, by=("period_month",)))
    out = demand.compute_demand_index(inputs, "period_month", by=("period_month",), previous_shares=prev)
    return out.select(
        "role_id", "skill_id",
        F.col("period_month").alias("snapshot_date"),
        version_of_month().alias("requirement_version"),
        "skill_posting_count", "role_required_total",
        "frequency_share", "recency_score", "growth_score", "demand_index",
    )


# ---------------------------------------------------------------- registered plans

def role_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11: mean depth, distinct postings and demand weight per (role, skill)."""
    return requirements_of(PlanContext(spark, sf_dir))


def required_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(PlanContext(spark, sf_dir))


def cumulative_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12: runs are posting months; evidence accumulates per pair over months."""
    per_month = requirements.requirements_from_evidence(evidence(PlanContext(spark, sf_dir)), by=("period_month",))
    return requirements.cumulative_evidence(per_month, run="period_month")


def demand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13 (flagship): demand index of the required pairs at one snapshot date."""
    ctx = PlanContext(spark, sf_dir)
    inputs = demand.inputs_from_evidence(evidence(ctx), pairs_of(ctx))
    return demand.compute_demand_index(inputs, SNAPSHOT_DATE)


def demand_index_with_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q14: current window against the equally long window before it."""
    ctx = PlanContext(spark, sf_dir)
    start, end = CURRENT_WINDOW
    prev_start, prev_end = demand.previous_window(start, end)
    ev, pairs = evidence(ctx), pairs_of(ctx)
    between = lambda a, b: (F.col("posted_at") >= F.lit(a)) & (F.col("posted_at") <= F.lit(b))
    current = demand.inputs_from_evidence(ev.where(between(start, end)), pairs)
    previous = demand.inputs_from_evidence(ev.where(between(prev_start, prev_end)), pairs)
    prev_shares = demand.pair_shares(previous).select(
        "role_id", "skill_id", F.col("frequency_share").alias("previous_share"))
    return demand.compute_demand_index(current, end, previous_shares=prev_shares)


def monthly_demand_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q15: one snapshot per month; growth against the previous calendar month."""
    return series_of(PlanContext(spark, sf_dir))


def trend_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of the newest three monthly snapshots of every pair."""
    return trend.trend_slopes(series_of(PlanContext(spark, sf_dir)))


def decay_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decay signals with the default thresholds."""
    return trend.detect_decay(series_of(PlanContext(spark, sf_dir)))
