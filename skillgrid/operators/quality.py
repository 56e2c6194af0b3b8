"""Data-quality rules as one audit job.

Parquet has no constraints, so the reference's CHECK / UNIQUE / FOREIGN KEY
rules become counted rules.  Rules on one table are evaluated in a single
aggregate over that table (one scan), then unpivoted to
``(rule_name, table_name, violations)`` rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.functions.text import is_blank, normalize_key

# --- fixed values -----------------------------------------------------------
ALLOWED_COURSE_WEIGHTS = (0.25, 0.50, 0.75, 1.00)
PUBLISH_RULES = {
    "required_depth_range": ("required_depth", 0.0, 1.0),
    "demand_weight_range": ("demand_weight", 0.1, 1.0),
    "demand_index_range": ("demand_index", 0.0, 1.0),
    "decay_rate_range": ("decay_rate", -1.0, 0.0),
    "confidence_range": ("confidence", 0.0, 1.0),
}
MIN_PUBLISHED_EVIDENCE = 5
# --- end of fixed values ----------------------------------------------------


def in_range(c: str, lo: float, hi: float) -> Column:
    """Finite and inside [lo, hi]."""
    x = F.col(c)
    return x.isNotNull() & ~F.isnan(x) & (x >= lo) & (x <= hi)


def table_rules(df: DataFrame, table_name: str, rules: dict[str, Column]) -> DataFrame:
    """Count violations of several row rules over one table in one pass.

    ``rules`` maps a rule name to the condition a *good* row satisfies.
    """
    agg = df.agg(*[F.count_if(~F.coalesce(cond, F.lit(False))).cast("bigint").alias(name)
                   for name, cond in rules.items()])
    return agg.unpivot([], list(rules), "rule_name", "violations").select(
        "rule_name", F.lit(table_name).alias("table_name"), "violations")


def duplicate_rule(df: DataFrame, keys: list[str], table_name: str, rule_name: str | None = None) -> DataFrame:
    """Number of key values that occur more than once."""
    n = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
         .agg(F.count(F.lit(1)).cast("bigint").alias("violations")))
    return n.select(F.lit(rule_name or f"unique_{'_'.join(keys)}").alias("rule_name"),
                    F.lit(table_name).alias("table_name"), "violations")


def orphan_rule(child: DataFrame, child_keys: list[str], parent: DataFrame, parent_keys: list[str],
                table_name: str, rule_name: str) -> DataFrame:
    """Child rows whose key is absent from the parent."""
    p = parent.select(*[F.col(a).alias(b) for a, b in zip(parent_keys, child_keys)]).distinct()
    n = child.select(*child_keys).join(p, child_keys, "left_anti").agg(
        F.count(F.lit(1)).cast("bigint").alias("violations"))
    return n.select(F.lit(rule_name).alias("rule_name"), F.lit(table_name).alias("table_name"), "violations")


def orphan_keys(child: DataFrame, child_keys: list[str], parent: DataFrame, parent_keys: list[str],
                relation: str) -> DataFrame:
    """The orphan key values themselves."""
    p = parent.select(*[F.col(a).alias(b) for a, b in zip(parent_keys, child_keys)]).distinct()
    return (child.select(*child_keys).distinct().join(p, child_keys, "left_anti")
            .select(F.lit(relation).alias("relation"), *child_keys))


def publish_rules(df: DataFrame, table_name: str, *, version: int | None = None) -> DataFrame:
    """Range and finiteness rules for a publish frame."""
    rules = {name: in_range(c, lo, hi) for name, (c, lo, hi) in PUBLISH_RULES.items() if c in df.columns}
    if "evidence_count" in df.columns:
        rules["evidence_minimum"] = F.col("evidence_count") >= MIN_PUBLISHED_EVIDENCE
    if "requirement_version" in df.columns:
        rules["version_positive"] = F.col("requirement_version") > 0
        if version is not None:
            rules["version_matches_request"] = F.col("requirement_version") == version
    return table_rules(df, table_name, rules)


def assert_rules(audit: DataFrame) -> None:
    """Raise before a write when any rule has violations."""
    bad = audit.where(F.col("violations") > 0).limit(1).collect()
    if bad:
        r = bad[0]
        raise ValueError(f"rule {r['rule_name']} on {r['table_name']}: {r['violations']} violations")


def non_blank_rules(columns: Iterable[str]) -> dict[str, Column]:
    return {f"non_blank_{c}": ~is_blank(c) for c in columns}


def alias_key_rule(aliases: DataFrame, table_name: str) -> DataFrame:
    """The stored key equals the normalised alias."""
    return table_rules(aliases, table_name,
                       {"alias_key_normalized": F.col("normalized_alias") == normalize_key("alias")})


def one_current_per_month(manifest: DataFrame) -> DataFrame:
    """Months whose current-row count is not one, plus month-start and revision rules."""
    per_month = manifest.groupBy("period_month").agg(F.count_if("is_current").alias("n_current"))
    a = per_month.agg(F.count_if(F.col("n_current") != 1).cast("bigint").alias("violations")).select(
        F.lit("one_current_per_month").alias("rule_name"), F.lit("role_requirement_versions").alias("table_name"),
        "violations")
    b = table_rules(manifest, "role_requirement_versions", {
        "period_month_is_month_start": F.col("period_month") == F.trunc("period_month", "month"),
        "period_revision_positive": F.col("period_revision") > 0,
    })
    return a.unionByName(b)


def allowed_values_rule(df: DataFrame, col: str, allowed: Iterable, table_name: str, rule_name: str) -> DataFrame:
    """Rows whose value is outside a fixed set (D8: course weights 0.25/0.50/0.75/1.00)."""
    return table_rules(df, table_name, {rule_name: F.col(col).isin(*allowed)})


def review_state(reviewed: Column | str, target_id: Column | str) -> Column:
    """Alias review state: pending until reviewed; then approved with a target,
    dismissed without one (P15)."""
    r = F.col(reviewed) if isinstance(reviewed, str) else reviewed
    t = F.col(target_id) if isinstance(target_id, str) else target_id
    return F.when(~F.coalesce(r, F.lit(False)), F.lit("pending")).when(t.isNotNull(), F.lit("approved")) \
        .otherwise(F.lit("dismissed"))


def review_action_valid(action: Column | str, target_id: Column | str) -> Column:
    """approve needs a target; dismiss must not carry one."""
    a = F.col(action) if isinstance(action, str) else action
    t = F.col(target_id) if isinstance(target_id, str) else target_id
    return F.when(a == "approve", t.isNotNull()).when(a == "dismiss", t.isNull()).otherwise(F.lit(False))
