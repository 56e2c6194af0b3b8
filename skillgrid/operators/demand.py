"""Skill demand index.

demand_index = clip(0.50 * share + 0.30 * recency + 0.20 * growth)

* share    = distinct postings with the skill / distinct postings of the role,
             both inside the filtered input (the *required* pairs only)
* recency  = mean over postings of clip(1 - max(age_days, 0) / window)
* growth   = 0.5 without a previous share, else clip((share - prev + 1) / 2)
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.functions.scores import (
    DEFAULT_WINDOW_DAYS, clip, demand_index, growth_score, recency_numerator, round4,
)


def required_pairs(requirements: DataFrame, version: int | None = None, *,
                   version_col: str = "requirement_version") -> DataFrame:
    """(role, skill) pairs of one published version."""
    src = requirements if version is None else requirements.where(F.col(version_col) == version)
    return src.select("role_id", "skill_id").distinct()


def demand_inputs(mapped: DataFrame, pairs: DataFrame, *, by: tuple[str, ...] = (),
                  posting: str = "job_posting_id", role: str = "role_id", skill: str = "skill_id",
                  posted_at: str = "posted_at", window_start: dt.date | None = None,
                  window_end: dt.date | None = None) -> DataFrame:
    """Mapped rows of required pairs, one per (posting, role, skill).

    Pairs are matched on (role, skill) plus any ``by`` column they carry (e.g.
    the requirement version).  Optional date bounds are plain filters, so
    they reach the Parquet scan.
    A missing posting date fails the job inside the tasks (no driver check).
    """
    src = mapped
    if window_start is not None:
        src = src.where(F.col(posted_at) >= F.lit(window_start))
    if window_end is not None:
        src = src.where(F.col(posted_at) <= F.lit(window_end))
    keys = [*by, role, posting]
    pair_keys = [c for c in by if c in pairs.columns] + [role, skill]
    return (
        src.join(pairs, pair_keys, "left_semi")
        .groupBy(*keys, skill)
        .agg(F.min(posted_at).alias(posted_at))
        .withColumn(posted_at, F.when(F.col(posted_at).isNull(),
                                      F.raise_error(F.lit("posted_at is missing for a required posting")))
                    .otherwise(F.col(posted_at)))
    )


def inputs_from_evidence(ev: DataFrame, pairs: DataFrame, *, by: tuple[str, ...] = (),
                         posting: str = "job_posting_id", role: str = "role_id", skill: str = "skill_id",
                         posted_at: str = "posted_at") -> DataFrame:
    """Demand inputs from an evidence table (already one row per posting, role,
    skill): keep required pairs; a missing posting date fails the job (J6)."""
    pair_keys = [c for c in by if c in pairs.columns] + [role, skill]
    checked = F.when(F.col(posted_at).isNull(),
                     F.raise_error(F.lit("posted_at is missing for a required posting"))).otherwise(F.col(posted_at))
    return ev.join(pairs, pair_keys, "left_semi").select(*by, role, posting, skill, checked.alias(posted_at))


def pair_shares(inputs: DataFrame, *, by: tuple[str, ...] = (), posting: str = "job_posting_id",
                role: str = "role_id", skill: str = "skill_id") -> DataFrame:
    """share per pair inside ``inputs`` (A5); used for the previous window too."""
    per_pair = inputs.groupBy(*by, role, skill).agg(F.count(F.lit(1)).alias("skill_posting_count"))
    totals = (inputs.select(*by, role, posting).distinct()
              .groupBy(*by, role).agg(F.count(F.lit(1)).alias("role_required_total")))
    return per_pair.join(totals, [*by, role]).withColumn(
        "frequency_share",
        clip(F.col("skill_posting_count").cast("double") / F.col("role_required_total").cast("double")))


def compute_demand_index(inputs: DataFrame, snapshot_date: dt.date | Column | str, *,
                         by: tuple[str, ...] = (), previous_shares: DataFrame | None = None,
                         window_days: int = DEFAULT_WINDOW_DAYS, posting: str = "job_posting_id",
                         role: str = "role_id", skill: str = "skill_id",
                         posted_at: str = "posted_at") -> DataFrame:
    """Demand index per (by..., role, skill).

    ``snapshot_date`` is a date or a column (e.g. the period month of each row).
    ``previous_shares`` has (by..., role, skill, previous_share); pairs without
    one get the neutral growth 0.5 (J9).
    """
    snap = F.lit(snapshot_date) if isinstance(snapshot_date, dt.date) else (
        F.col(snapshot_date) if isinstance(snapshot_date, str) else snapshot_date)
    w = max(int(window_days), 1)
    with_age = inputs.withColumn("_rec", recency_numerator(F.datediff(snap, F.col(posted_at)), w))
    per_pair = with_age.groupBy(*by, role, skill).agg(
        F.count(F.lit(1)).alias("skill_posting_count"),
        F.sum("_rec").alias("_rec_sum"),
    )
    totals = (inputs.select(*by, role, posting).distinct()
              .groupBy(*by, role).agg(F.count(F.lit(1)).alias("role_required_total")))
    out = per_pair.join(totals, [*by, role])
    share = clip(F.col("skill_posting_count").cast("double") / F.col("role_required_total").cast("double"))
    recency = clip(F.col("_rec_sum").cast("double") / (F.lit(float(w)) * F.col("skill_posting_count")))
    out = out.withColumn("_share", share).withColumn("_recency", recency)
    if previous_shares is not None:
        out = out.join(previous_shares.select(*by, role, skill, "previous_share"), [*by, role, skill], "left")
    else:
        out = out.withColumn("previous_share", F.lit(None).cast("double"))
    out = out.withColumn("_growth", growth_score("_share", "previous_share"))
    return out.select(
        *by, role, skill,
        F.col("skill_posting_count").cast("bigint").alias("skill_posting_count"),
        F.col("role_required_total").cast("bigint").alias("role_required_total"),
        round4("_share").alias("frequency_share"),
        round4("_recency").alias("recency_score"),
        round4("_growth").alias("growth_score"),
        round4(demand_index("_share", "_recency", "_growth")).alias("demand_index"),
    )


def previous_window(window_start: dt.date, window_end: dt.date) -> tuple[dt.date, dt.date]:
    """The equally long window that ends the day before ``window_start``."""
    span = (window_end - window_start).days + 1
    prev_end = window_start - dt.timedelta(days=1)
    return prev_end - dt.timedelta(days=span - 1), prev_end


def previous_month_shares(shares: DataFrame, *, month: str = "period_month",
                          role: str = "role_id", skill: str = "skill_id") -> DataFrame:
    """Shift monthly shares one calendar month forward so they join as 'previous'."""
    return shares.select(
        F.add_months(F.col(month), 1).alias(month), role, skill,
        F.col("frequency_share").alias("previous_share"))


def dataset_period_month(postings: DataFrame, *, dataset: str = "dataset_id",
                         posted_at: str = "posted_at") -> DataFrame:
    """Month of the latest posting of each dataset."""
    return postings.groupBy(dataset).agg(F.trunc(F.max(posted_at), "month").alias("period_month"))
