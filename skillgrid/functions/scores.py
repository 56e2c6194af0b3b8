"""Score arithmetic as column expressions.

Scores are published with 4 decimal places, half-up (Spark ``round``).
Ratios are formed from exact integer sums and divided once, so the result does
not depend on partition order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
PERSISTED_PRECISION = 4
DEMAND_WEIGHT_FLOOR = 0.1
SHARE_WEIGHT = 0.50
RECENCY_WEIGHT = 0.30
GROWTH_WEIGHT = 0.20
NEUTRAL_GROWTH = 0.5
DEFAULT_WINDOW_DAYS = 90
EVIDENCE_THRESHOLD = 5
MIN_SNAPSHOTS = 3
DECAY_SLOPE_THRESHOLD = -0.10
DECAY_CONFIDENCE_SCALE = 0.20
MIN_CONFIDENCE = 0.70
REPORT_WEIGHTS = {"validation_pass_rate": 0.35, "role_match_rate": 0.35, "skill_match_rate": 0.30}
MANUAL_REVIEW_BELOW = 0.80
# --- end of fixed values ----------------------------------------------------


def _col(c: Column | str | float) -> Column:
    if isinstance(c, Column):
        return c
    if isinstance(c, str):
        return F.col(c)
    return F.lit(c)


def clip(c: Column | str, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Clamp to [lo, hi]."""
    return F.least(F.greatest(_col(c), F.lit(float(lo))), F.lit(float(hi)))


def round4(c: Column | str) -> Column:
    """Half-up to 4 places, through an 12-place decimal.

    For values that are doubles already; the intermediate decimal absorbs
    binary noise (0.48125 computed as 0.48124999999999996 rounds to 0.4813).
    Ratios of whole numbers are rounded exactly by ``ratio4`` instead.
    """
    return F.round(_col(c).cast("decimal(24,12)"), PERSISTED_PRECISION).cast("double")


def ratio4(num: Column | str, den: Column | str) -> Column:
    """num / den for whole numbers >= 0 and den > 0, rounded half-up to 4 places once, in whole-number arithmetic."""
    n, d = _col(num).cast("decimal(28,0)"), _col(den).cast("decimal(28,0)")
    units = F.call_function("div", n * F.lit(20000).cast("decimal(6,0)") + d, d * F.lit(2).cast("decimal(1,0)"))
    return units / F.lit(10000.0)


def clip_round(c: Column | str, lo: float = 0.0, hi: float = 1.0) -> Column:
    return round4(clip(c, lo, hi))


def safe_rate(num: Column | str, den: Column | str) -> Column:
    """num/den rounded to 4 places; a non-positive denominator gives 0."""
    n, d = _col(num), _col(den)
    return F.when(d <= 0, F.lit(0.0)).otherwise(ratio4(n, d))


def demand_weight(skill_count: Column | str, role_total: Column | str) -> Column:
    return clip(ratio4(skill_count, role_total), DEMAND_WEIGHT_FLOOR, 1.0)


def recency_numerator(days: Column | str, window_days: int = DEFAULT_WINDOW_DAYS) -> Column:
    """Whole-day recency numerator: the row's score times the window length.

    score = clip(1 - max(days, 0) / window) = max(window - max(days, 0), 0) / window
    """
    w = max(int(window_days), 1)
    return F.greatest(F.lit(w) - F.greatest(_col(days), F.lit(0)), F.lit(0)).cast("bigint")


def demand_index(share: Column | str, recency: Column | str, growth: Column | str) -> Column:
    """Weighted sum in a fixed operation order, clipped to [0, 1] (unrounded)."""
    return clip(
        (F.lit(SHARE_WEIGHT) * _col(share))
        + (F.lit(RECENCY_WEIGHT) * _col(recency))
        + (F.lit(GROWTH_WEIGHT) * _col(growth))
    )


def growth_score(share: Column | str, previous_share: Column | str) -> Column:
    prev = _col(previous_share)
    return F.when(prev.isNull(), F.lit(NEUTRAL_GROWTH)).otherwise(
        clip((_col(share) - prev + F.lit(1.0)) / F.lit(2.0))
    )
