"""Role requirement aggregation.

Input is the *mapped* fact: one row per (posting, role, skill) hit with an
optional depth in [0, 1].  It is first collapsed to one evidence row per
(role, posting, skill); requirements, shares and totals are all aggregates of
that evidence table, which callers may materialise once and reuse.  Per-pair
sums are exact (decimal depth sums, integer counts) and divided once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.functions.scores import EVIDENCE_THRESHOLD, clip, demand_weight, ratio4

# Depths (at most 1) are summed as whole units of 10^-9, a bigint: independent
# of order and on Spark's fast long arithmetic (a wide decimal sum would fall
# back to BigDecimal).  The unit is far below the 4 places that are published.
DEPTH_UNITS = 1_000_000_000

# Hits one task collapses.  Nearly every hit is a group of its own, so what a
# task holds grows with its rows, some 0.5 kB each.
HITS_PER_TASK = 200_000


def posting_skill_evidence(mapped: DataFrame, *, by: tuple[str, ...] = (),
                           posting: str = "job_posting_id", role: str = "role_id",
                           skill: str = "skill_id", depth: str = "normalized_depth",
                           posted_at: str | None = "posted_at", n_hits: int | None = None) -> DataFrame:
    """Collapse hits to one row per (by, role, posting, skill): exact depth sums
    (in units), depth count and the posting date.

    With ``n_hits``, about the number of hits, they are first laid out by
    posting in partitions of ``HITS_PER_TASK``: the groups of one task then stay
    as small however many hits there are, and the aggregate needs no other
    shuffle.  Else a task holds the groups of as many hits as Spark gives it.
    """
    if n_hits is not None:
        mapped = mapped.repartition(max(1, math.ceil(n_hits / HITS_PER_TASK)), posting)
    units = F.round(F.col(depth) * F.lit(float(DEPTH_UNITS))).cast("bigint")
    aggs = [F.sum(units).alias("depth_sum"), F.count(depth).alias("depth_n")]
    if posted_at and posted_at in mapped.columns:
        aggs.append(F.min(posted_at).alias(posted_at))
    return mapped.groupBy(*by, role, posting, skill).agg(*aggs)


def role_posting_totals(evidence: DataFrame, *, by: tuple[str, ...] = (),
                        posting: str = "job_posting_id", role: str = "role_id",
                        name: str = "role_total") -> DataFrame:
    """Distinct postings per role (A2 default)."""
    return (
        evidence.select(*by, role, posting).distinct()
        .groupBy(*by, role).agg(F.count(F.lit(1)).alias(name))
    )


def requirements_from_evidence(ev: DataFrame, *, by: tuple[str, ...] = (), role_totals: DataFrame | None = None,
                               posting: str = "job_posting_id", role: str = "role_id",
                               skill: str = "skill_id") -> DataFrame:
    """Per (by, role, skill): mean depth (nulls ignored), distinct postings, demand weight.

    ``ev`` has one row per (role, posting, skill) within ``by`` (columns that
    depend only on the posting may ride along).  ``role_totals`` (columns
    ``by..., role, role_total``) overrides the per-role totals found in ``ev``
    (A2).  Roles with a non-positive total are left out (P11); pairs whose mean
    depth is null are left out (P13).
    """
    found = role_posting_totals(ev, by=by, posting=posting, role=role, name="found_total")
    if role_totals is not None:
        totals = (
            found.join(role_totals.withColumnRenamed("role_total", "given_total"), [*by, role], "full")
            .select(*by, role, F.coalesce("given_total", "found_total").alias("role_total"))
        )
    else:
        totals = found.withColumnRenamed("found_total", "role_total")
    pairs = ev.groupBy(*by, role, skill).agg(
        F.sum("depth_sum").alias("depth_sum"),
        F.sum("depth_n").alias("depth_n"),
        F.count(F.lit(1)).alias("skill_posting_count"),
    )
    mean_depth = ratio4("depth_sum", F.col("depth_n").cast("decimal(18,0)") * F.lit(DEPTH_UNITS).cast("decimal(10,0)"))
    return (
        pairs.join(totals.where(F.col("role_total") > 0), [*by, role], "inner")
        .where(F.col("depth_n") > 0)
        .select(
            *by, role, skill,
            clip(mean_depth).alias("required_depth"),
            F.col("skill_posting_count"),
            F.col("role_total").cast("bigint").alias("role_total"),
            demand_weight("skill_posting_count", "role_total").alias("demand_weight"),
        )
    )


def aggregate_role_requirements(mapped: DataFrame, *, by: tuple[str, ...] = (),
                                role_totals: DataFrame | None = None,
                                posting: str = "job_posting_id", role: str = "role_id",
                                skill: str = "skill_id", depth: str = "normalized_depth") -> DataFrame:
    """Requirement aggregates straight from mapped hits."""
    ev = posting_skill_evidence(mapped, by=by, posting=posting, role=role, skill=skill, depth=depth)
    return requirements_from_evidence(ev, by=by, role_totals=role_totals, posting=posting, role=role, skill=skill)


def skipped_roles(role_totals: DataFrame, role: str = "role_id") -> DataFrame:
    """Roles dropped by P11 (non-positive total), as a side output for logging."""
    return role_totals.where(F.col("role_total") <= 0).select(role, "role_total")


def cumulative_evidence(per_run: DataFrame, *, run: str, role: str = "role_id",
                        skill: str = "skill_id", count: str = "skill_posting_count",
                        threshold: int = EVIDENCE_THRESHOLD) -> DataFrame:
    """Running evidence per pair over ordered runs.

    ``prior_evidence`` is the sum over earlier runs (J8's default-0 lookup),
    ``cumulative_evidence`` includes the current run; ``threshold_met`` marks
    pairs that may be published in that run.  The window holds one row per run
    for one pair, so its size grows with the number of runs, not with the data.
    """
    w = Window.partitionBy(role, skill).orderBy(run).rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum(F.col(count)).over(w)
    return per_run.select(
        run, role, skill,
        F.col(count).cast("bigint").alias("evidence_count"),
        (cum - F.col(count)).cast("bigint").alias("prior_evidence"),
        cum.cast("bigint").alias("cumulative_evidence"),
        (cum >= threshold).alias("threshold_met"),
    )


def evidence_against_prior(current: DataFrame, prior_summary: DataFrame, *,
                           role: str = "role_id", skill: str = "skill_id",
                           threshold: int = EVIDENCE_THRESHOLD) -> DataFrame:
    """One run against stored summaries: prior sum per pair (0 when none) + current."""
    prior = prior_summary.groupBy(role, skill).agg(F.sum("evidence_count").alias("prior_evidence"))
    out = current.join(prior, [role, skill], "left").select(
        *current.columns,
        F.coalesce(F.col("prior_evidence"), F.lit(0)).cast("bigint").alias("prior_evidence"),
    )
    total = F.col("prior_evidence") + F.col("evidence_count")
    return out.withColumn("cumulative_evidence", total.cast("bigint")).withColumn(
        "threshold_met", total >= threshold)


def stored_already(evidence: DataFrame, stored: DataFrame, *,
                   keys: tuple[str, ...] = ("pipeline_job_id", "role_id", "skill_id")) -> DataFrame:
    """Evidence rows whose key has a stored row: summaries are written once, so a run with any must stop (K5)."""
    return evidence.join(stored.select(*keys), list(keys), "left_semi")


def evidence_summary(evidence: DataFrame, *, run: str) -> DataFrame:
    """Per run: evidence rows, postings behind them, and pairs that meet the threshold or stay below."""
    return evidence.groupBy(run).agg(
        F.count(F.lit(1)).alias("evidence_rows"),
        F.sum("evidence_count").alias("evidence_count"),
        F.count_if("threshold_met").alias("pairs_meeting_threshold"),
        F.count_if(~F.col("threshold_met")).alias("pairs_below_threshold"))


def publishable(requirements: DataFrame, evidence: DataFrame, *, keys: tuple[str, ...] = ("role_id", "skill_id"),
                threshold: int = EVIDENCE_THRESHOLD) -> DataFrame:
    """Requirement rows whose cumulative evidence reaches the threshold."""
    ev = evidence.select(*keys, F.col("cumulative_evidence").alias("evidence_count"))
    return (
        requirements.drop("evidence_count").join(ev, list(keys), "inner")
        .where(F.col("evidence_count") >= threshold)
    )
