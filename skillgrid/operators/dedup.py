"""Duplicate handling.

Survivor selection is an aggregate, not a window: ``min_by(struct, order)``
is combined map-side, so a key holding a third of all rows is reduced inside
each map task before the shuffle instead of landing whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSTING_DEDUP_KEY = ("normalized_source", "normalized_title", "normalized_company", "posted_at")


def first_per_key(df: DataFrame, keys: list[str | Column], order: str,
                  payload: list[str] | None = None, count_as: str | None = None) -> DataFrame:
    """One row per key: the row with the lowest ``order`` value.

    ``payload`` columns travel with the survivor; ``count_as`` adds the group size.
    """
    key_cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    key_names = [k if isinstance(k, str) else f"_k{i}" for i, k in enumerate(keys)]
    cols = payload if payload is not None else [c for c in df.columns if c not in key_names]
    if order not in cols:
        cols = [order, *cols]
    aggs = [F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order)).alias("_s")]
    if count_as:
        aggs.append(F.count(F.lit(1)).alias(count_as))
    grouped = df.groupBy(*[c.alias(n) for c, n in zip(key_cols, key_names)]).agg(*aggs)
    out = [F.col(n) for n in key_names if not n.startswith("_k")] + [F.col(f"_s.{c}").alias(c) for c in cols]
    if count_as:
        out.append(F.col(count_as))
    return grouped.select(*out)


def dedup_postings(normalized: DataFrame, keys: tuple[str, ...] = POSTING_DEDUP_KEY,
                   order: str = "source_row_number") -> DataFrame:
    """Keep the lowest row number per (source, title, company, posted_at)."""
    return first_per_key(normalized, list(keys), order)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def assert_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Raise when a lookup key is duplicated (A16); checked before broadcasting."""
    dup = duplicate_keys(df, keys).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate {'/'.join(keys)} in {name}: {dup[0][keys[0]]}")
    return df


def distinct_pairs(df: DataFrame, keys: tuple[str, ...] = ("role_id", "skill_id")) -> DataFrame:
    return df.select(*keys).distinct()


def missing_from(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Set difference on keys."""
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_anti")
