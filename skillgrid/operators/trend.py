"""Decay detection over snapshot history.

The slope is the least-squares slope over positions 0..n-1 of the last ``n``
snapshots of a pair (positions, not dates).  Values are the published 4-place
demand indexes, so they are summed as whole ten-thousandths and the slope is
one division of two exact integers.

``row_number() <= n`` lets Spark apply a per-partition group limit before the
shuffle, so a pair with a long history sends at most ``n`` rows per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.functions.scores import (
    DECAY_CONFIDENCE_SCALE, DECAY_SLOPE_THRESHOLD, MIN_CONFIDENCE, MIN_SNAPSHOTS, clip, round4,
)

_SCALE = 10000


def snapshot_history(snapshots: DataFrame, pairs: DataFrame) -> DataFrame:
    """History rows of the given pairs, all versions (S8): one semi join."""
    return snapshots.join(pairs.select("role_id", "skill_id").distinct(), ["role_id", "skill_id"], "left_semi")


def last_n(snapshots: DataFrame, n: int = MIN_SNAPSHOTS, *, keys: tuple[str, ...] = ("role_id", "skill_id"),
           date: str = "snapshot_date", version: str = "requirement_version") -> DataFrame:
    """Newest ``n`` snapshots per pair by (date, version); ``rn`` = 1 is the newest."""
    w = Window.partitionBy(*keys).orderBy(F.col(date).desc(), F.col(version).desc())
    return snapshots.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def trend_slopes(snapshots: DataFrame, n: int = MIN_SNAPSHOTS, *,
                 keys: tuple[str, ...] = ("role_id", "skill_id"), value: str = "demand_index",
                 date: str = "snapshot_date", version: str = "requirement_version") -> DataFrame:
    """Slope over the newest ``n`` points of every pair.

    Position of a row is ``-rn`` (oldest smallest); a shift of x does not change
    a least-squares slope.  Fewer than two points give slope 0.
    """
    last = last_n(snapshots, n, keys=keys, date=date, version=version)
    x = -F.col("rn").cast("bigint")
    y = F.round(F.col(value) * _SCALE).cast("bigint")
    agg = last.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"),
        F.max(F.when(F.col("rn") == 1, F.col(version))).alias("latest_version"),
        F.max(F.when(F.col("rn") == 1, F.col(date))).alias("latest_snapshot_date"),
    )
    num = F.col("n_points") * F.col("sxy") - F.col("sx") * F.col("sy")
    den = F.col("n_points") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(den == 0, F.lit(0.0)).otherwise(
        num.cast("double") / den.cast("double") / F.lit(float(_SCALE)))
    return agg.select(*keys, "n_points", slope.alias("slope"), "latest_version", "latest_snapshot_date")


def detect_decay(snapshots: DataFrame, *, min_snapshots: int = MIN_SNAPSHOTS,
                 slope_threshold: float = DECAY_SLOPE_THRESHOLD, min_confidence: float = MIN_CONFIDENCE,
                 keys: tuple[str, ...] = ("role_id", "skill_id")) -> DataFrame:
    """Decay signals (W5): full history of ``min_snapshots`` points, slope below the
    threshold and confidence = clip(|slope| / 0.20) at least ``min_confidence``."""
    t = trend_slopes(snapshots, min_snapshots, keys=keys)
    confidence = clip(F.abs(F.col("slope")) / F.lit(DECAY_CONFIDENCE_SCALE))
    return (
        t.where((F.col("n_points") == min_snapshots) & (F.col("slope") < F.lit(slope_threshold))
                & (confidence >= F.lit(min_confidence)))
        .select(
            *keys,
            round4(clip("slope", -1.0, 0.0)).alias("decay_rate"),
            round4(confidence).alias("confidence"),
            F.col("latest_version").alias("requirement_version"),
            F.col("latest_snapshot_date").cast("timestamp").alias("detected_at"),
        )
    )


def rolling_decay(snapshots: DataFrame, *, min_snapshots: int = MIN_SNAPSHOTS,
                  slope_threshold: float = DECAY_SLOPE_THRESHOLD, min_confidence: float = MIN_CONFIDENCE,
                  keys: tuple[str, ...] = ("role_id", "skill_id"), value: str = "demand_index",
                  date: str = "snapshot_date", version: str = "requirement_version") -> DataFrame:
    """Decay signal as each snapshot was published: the trend of the newest
    ``min_snapshots`` rows up to and including that snapshot (a sliding frame)."""
    w = (Window.partitionBy(*keys).orderBy(F.col(date), F.col(version))
         .rowsBetween(-(min_snapshots - 1), 0))
    pos = Window.partitionBy(*keys).orderBy(F.col(date), F.col(version))
    x = F.row_number().over(pos).cast("bigint")
    y = F.round(F.col(value) * _SCALE).cast("bigint")
    framed = snapshots.withColumn("_x", x).withColumn("_y", y)
    framed = framed.select(
        *keys, date, version,
        F.count(F.lit(1)).over(w).alias("n_points"),
        F.sum("_x").over(w).alias("sx"), F.sum("_y").over(w).alias("sy"),
        F.sum(F.col("_x") * F.col("_y")).over(w).alias("sxy"),
        F.sum(F.col("_x") * F.col("_x")).over(w).alias("sxx"),
    )
    num = F.col("n_points") * F.col("sxy") - F.col("sx") * F.col("sy")
    den = F.col("n_points") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(den == 0, F.lit(0.0)).otherwise(
        num.cast("double") / den.cast("double") / F.lit(float(_SCALE)))
    confidence = clip(F.abs(slope) / F.lit(DECAY_CONFIDENCE_SCALE))
    return (
        framed.where((F.col("n_points") == min_snapshots) & (slope < F.lit(slope_threshold))
                     & (confidence >= F.lit(min_confidence)))
        .select(
            *keys,
            round4(clip(slope, -1.0, 0.0)).alias("decay_rate"),
            round4(confidence).alias("confidence"),
            F.col(version).alias("requirement_version"),
            F.col(date).cast("timestamp").alias("detected_at"),
        )
    )
