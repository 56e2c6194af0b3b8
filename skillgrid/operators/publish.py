"""Versioned publishing and prepared reads (K3, K4, K6-K9, K12, A10, W6, W7, W9,
F13, F17, J10, J11, J13, J14, U1, R1-R3, S9-S13, X9).

Nothing is updated in place.  A version is published by writing its rows
under ``requirement_version=N`` and then appending one manifest row; readers
always join the manifest, so an unfinished version is invisible.  Flags that
the reference flips with UPDATE are derived when read:

* ``period_revision`` = order of the version inside its month
* ``is_current``      = newest revision of its month
* ``is_active``       = newest decay signal of a pair inside a month

The manifest holds one row per publish, so the windows over it are small no
matter how large the published tables grow.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillgrid.functions.text import name_based_id
from skillgrid.operators.numbering import number_rows
from skillgrid.sources.materialize import FOLDER, folder_of

MANIFEST = "role_requirement_versions"
LINEAGE = "role_requirement_version_datasets"
REQUIREMENTS = "role_skill_requirements"
SNAPSHOTS = "sdi_snapshots"
SIGNALS = "skill_decay_signals"
JOB_LOG = "pipeline_job_log"
JOB = "pipeline_job_id"


# ---------------------------------------------------------------- versions

def month_start_rule(c: Column | str) -> Column:
    """period_month must be the first day of a month."""
    col = F.col(c) if isinstance(c, str) else c
    return col == F.trunc(col, "month")


def allocate_versions(publishes: DataFrame, order: list[str], *, base_version: int = 0) -> DataFrame:
    """Versions in publish order (max + 1 each time), revisions within a month
    and the derived current flag (A10, W6, W7).  Numbers come in two passes
    (ranges, then range counts), without a window over all publishes."""
    checked = publishes.withColumn(
        "period_month", F.when(month_start_rule("period_month"), F.col("period_month"))
        .otherwise(F.raise_error(F.lit("period_month must be the first day of a month"))))
    numbered = number_rows(checked, order, "version", first=base_version + 1, name="versions")
    return derive_current(numbered.withColumn("version", F.col("version").cast("int")))


def derive_current(manifest: DataFrame) -> DataFrame:
    """period_revision and is_current from (period_month, version)."""
    w_month = Window.partitionBy("period_month").orderBy("version")
    w_last = Window.partitionBy("period_month")
    rev = F.row_number().over(w_month).cast("int")
    out = manifest.withColumn("period_revision", rev)
    return out.withColumn("is_current", F.col("period_revision") == F.max("period_revision").over(w_last))


def next_version(manifest: DataFrame, period_month: dt.date) -> tuple[int, int]:
    """(version, period_revision) for a new publish: max + 1 overall and in the month (A10)."""
    row = manifest.agg(
        F.coalesce(F.max("version"), F.lit(0)).alias("v"),
        F.coalesce(F.max(F.when(F.col("period_month") == F.lit(period_month), F.col("period_revision"))),
                   F.lit(0)).alias("r"),
    ).first()
    return int(row["v"]) + 1, int(row["r"]) + 1


def lineage_rows(version: int, dataset_id: str, extra_dataset_ids: list[str] | None = None) -> list[tuple]:
    """Lineage of one publish: triggering dataset first, then extras, unique in order (K7)."""
    seen: list[str] = []
    for d in [dataset_id, *(extra_dataset_ids or [])]:
        if d not in seen:
            seen.append(d)
    return [(version, d, i + 1) for i, d in enumerate(seen)]


def publish_requirements(spark: SparkSession, root: str, requirements: DataFrame, *, dataset_id: str,
                         period_month: dt.date, extra_dataset_ids: list[str] | None = None,
                         job_id: str | None = None) -> int:
    """Publish one requirement version under ``root`` (K6).

    Rows and lineage are written first, the manifest row last; each goes to a
    folder of its version with overwrite, so a version that a failed publish
    left half-written is replaced when its number is used again.  With
    ``job_id`` the version is visible only once that job is complete.  Single
    writer.
    """
    if period_month != period_month.replace(day=1):
        raise ValueError("period_month must be the first day of a month")
    version, revision = next_version(read_manifest(spark, root), period_month)
    (requirements.drop("requirement_version").write.mode("overwrite")
     .parquet(f"{root}/{REQUIREMENTS}/requirement_version={version}"))
    spark.createDataFrame(lineage_rows(version, dataset_id, extra_dataset_ids),
                          "requirement_version int, dataset_id string, lineage_position int") \
        .drop("requirement_version").write.mode("overwrite").parquet(f"{root}/{LINEAGE}/requirement_version={version}")
    spark.createDataFrame([(dataset_id, period_month, revision, job_id)],
                          "dataset_id string, period_month date, period_revision int, pipeline_job_id string") \
        .write.mode("overwrite").parquet(f"{root}/{MANIFEST}/version={version}")
    return version


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A stored table, or None if it does not exist; works on any path that Spark reads."""
    try:
        return spark.read.parquet(f"{root}/{name}")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def of_complete_jobs(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """Rows of jobs whose ledger says complete, and rows written outside of any job.

    A job's rows, in whatever tables, become visible together by the one
    ledger row that completes it; those of a failed job never do.
    """
    if JOB not in rows.columns:
        return rows
    log = read_table(spark, root, JOB_LOG)
    outside = rows.where(F.col(JOB).isNull())
    if log is None:
        return outside
    done = log.where("action = 'complete'").select(F.col("job_id").alias(JOB)).distinct()
    return rows.join(done, JOB, "left_semi").select(*rows.columns).unionByName(outside)


def read_visible(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    t = read_table(spark, root, name)
    return None if t is None else of_complete_jobs(spark, root, t)


def read_manifest(spark: SparkSession, root: str, own: tuple | None = None) -> DataFrame:
    """Visible versions; ``own`` = (version, dataset_id, period_month) adds a run's unfinished one."""
    m = read_visible(spark, root, MANIFEST)
    rows = spark.createDataFrame([own] if own else [], "version int, dataset_id string, period_month date")
    if m is not None:
        rows = m.select("version", "dataset_id", "period_month").unionByName(rows)
    return derive_current(rows)


# ---------------------------------------------------------------- lineage

def lineage_from_revisions(manifest: DataFrame) -> DataFrame:
    """Lineage when a republish carries the month's previous dataset along: the
    triggering dataset first, then the dataset of the revision it supersedes."""
    w = Window.partitionBy("period_month").orderBy("version")
    prev = F.lag("dataset_id").over(w)
    rows = manifest.select("version", "dataset_id", prev.alias("prev_dataset"))
    own = rows.select(F.col("version").alias("requirement_version"), "dataset_id", F.lit(1).alias("lineage_position"))
    carried = rows.where(F.col("prev_dataset").isNotNull() & (F.col("prev_dataset") != F.col("dataset_id"))).select(
        F.col("version").alias("requirement_version"), F.col("prev_dataset").alias("dataset_id"),
        F.lit(2).alias("lineage_position"))
    return own.unionByName(carried)


def versions_by_dataset(manifest: DataFrame, lineage: DataFrame) -> DataFrame:
    """Lineage lookup: every version a dataset contributed to, with its month,
    revision and current flag (J14)."""
    return lineage.join(manifest.withColumnRenamed("version", "requirement_version")
                        .withColumnRenamed("dataset_id", "triggering_dataset_id"),
                        "requirement_version").select(
        "dataset_id", "requirement_version", "period_month", "period_revision", "is_current",
        "lineage_position", "triggering_dataset_id")


# ---------------------------------------------------------------- prepared reads

def current_rows(published: DataFrame, manifest: DataFrame, *, version_col: str = "requirement_version") -> DataFrame:
    """Published rows of current versions only: the three monthly views.

    The current versions prune the folders of ``published`` while the query
    runs.  The comparison is always true; Spark derives partition pruning from
    a filter with a comparison, not from a flag alone.
    """
    cur = manifest.where("is_current AND version >= 1").select(
        F.col("version").alias(version_col), folder_of("version").alias(FOLDER), "period_month", "period_revision")
    if FOLDER not in published.columns:
        return published.join(cur.drop(FOLDER), version_col)
    return published.join(cur, [FOLDER, version_col]).drop(FOLDER)


def current_version(manifest: DataFrame) -> DataFrame:
    """Highest version flagged current, one row."""
    return manifest.where("is_current").orderBy(F.col("version").desc()).limit(1)


def latest_month_version(manifest: DataFrame) -> DataFrame:
    """Current version of the newest month (the B9 variant)."""
    return manifest.where("is_current").orderBy(F.col("period_month").desc(), F.col("version").desc()).limit(1)


def rows_of_version(published: DataFrame, version: DataFrame, *, role_id=None,
                    version_col: str = "requirement_version") -> DataFrame:
    """Rows of one version (and optionally one role).

    ``version`` is a frame of one row, or none: then there are no rows.  It is
    a scalar subquery in the filter, so a published table opens the folder of
    that version alone, and the role filter reaches its files.
    """
    out = published.where(F.col(version_col) == version.select("version").scalar())
    if FOLDER in published.columns:
        out = out.where(F.col(FOLDER) == version.select(folder_of("version")).scalar()).drop(FOLDER)
    return out if role_id is None else out.where(F.col("role_id") == F.lit(role_id))


def active_signals(signals: DataFrame, manifest: DataFrame) -> DataFrame:
    """Decay signals with ``is_active`` derived: newest version per pair and
    month (K9, J11).  Stored rates keep the [-1, 0] sign rule (F17)."""
    months = manifest.select(F.col("version").alias("requirement_version"), "period_month")
    w = Window.partitionBy("role_id", "skill_id", "period_month").orderBy(F.col("requirement_version").desc())
    return (signals.join(months, "requirement_version")
            .withColumn("decay_rate", -F.abs(F.col("decay_rate")))
            .withColumn("is_active", F.row_number().over(w) == 1))


def active_signals_by_role(signals_with_flag: DataFrame, role_id=None) -> DataFrame:
    """Active signals from the base table, every month."""
    out = signals_with_flag.where("is_active")
    return out if role_id is None else out.where(F.col("role_id") == F.lit(role_id))


def register_views(spark: SparkSession, root: str) -> list[str]:
    """Temp views over a published warehouse folder, so the monthly reads can be
    written in SQL: ``role_requirement_versions`` (with derived flags),
    ``current_monthly_role_requirements``, ``current_monthly_sdi_snapshots``,
    ``current_monthly_skill_decay_signals`` and ``active_skill_decay_signals``
    (R1-R3, S13).  Tables not published yet are skipped."""
    manifest = read_manifest(spark, root)
    manifest.createOrReplaceTempView("role_requirement_versions")
    made = ["role_requirement_versions"]
    for table_name, view in ((REQUIREMENTS, "current_monthly_role_requirements"),
                             (SNAPSHOTS, "current_monthly_sdi_snapshots")):
        t = read_visible(spark, root, table_name)
        if t is not None:
            current_rows(t, manifest).createOrReplaceTempView(view)
            made.append(view)
    sig = read_visible(spark, root, SIGNALS)
    if sig is not None:
        flagged = active_signals(sig, manifest)
        flagged.where("is_active").createOrReplaceTempView("active_skill_decay_signals")
        current_rows(flagged.where("is_active").drop("period_month"), manifest) \
            .createOrReplaceTempView("current_monthly_skill_decay_signals")
        made += ["active_skill_decay_signals", "current_monthly_skill_decay_signals"]
    return made


# ---------------------------------------------------------------- idempotent sinks

def snapshot_publish_plan(incoming: DataFrame, stored: DataFrame, manifest: DataFrame, *,
                          keys: tuple[str, ...] = ("role_id", "skill_id", "snapshot_date", "requirement_version"),
                          value: str = "demand_index") -> DataFrame:
    """Classify incoming snapshot rows against stored ones (K8, P10).

    new      - key not stored: append
    same     - stored with the same 4-place value: skip
    conflict - stored with a different value: the publish must fail
    off_month- snapshot_date differs from the version's period month: must fail
    """
    months = manifest.select(F.col("version").alias("requirement_version"), F.col("period_month").alias("_pm"))
    st = stored.select(*keys, F.col(value).alias("stored_value"))
    j = incoming.join(st, list(keys), "left").join(months, "requirement_version", "left")
    status = (F.when(F.col("_pm").isNull() | (F.col("snapshot_date") != F.col("_pm")), F.lit("off_month"))
              .when(F.col("stored_value").isNull(), F.lit("new"))
              .when(F.round(F.col("stored_value"), 4) == F.round(F.col(value), 4), F.lit("same"))
              .otherwise(F.lit("conflict")))
    return j.select(*keys, F.col(value).alias("incoming_value"), "stored_value", status.alias("publish_status"))


def assert_publishable(plan: DataFrame) -> None:
    bad = plan.where(F.col("publish_status").isin("conflict", "off_month")).limit(1).collect()
    if bad:
        raise ValueError(f"snapshot publish refused: {bad[0]['publish_status']}")


def insert_or_get(incoming: DataFrame, stored: DataFrame, *, keys: list[str], role: str = "role_id",
                  id_col: str = "posting_id") -> DataFrame:
    """Insert-or-get on a natural key with deterministic ids.

    Returns every incoming row with its id, whether it is new, and whether the
    stored role differs (the reference fails the run on that).
    """
    st = stored.select(*keys, F.col(id_col).alias("stored_id"), F.col(role).alias("stored_role"))
    j = incoming.join(st, keys, "left")
    return j.select(
        *incoming.columns,
        F.coalesce(F.col("stored_id"), name_based_id(*keys)).alias(id_col),
        F.col("stored_id").isNull().alias("inserted"),
        (F.col("stored_id").isNotNull() & (F.col("stored_role") != F.col(role))).alias("role_mismatch"),
    )


def new_rows(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet: what an insert-if-absent appends."""
    return incoming.join(stored.select(*keys), keys, "left_anti")


def retention_plan(manifest: DataFrame, keep_previous: int = 3) -> DataFrame:
    """The versions kept online (X9): the newest and the ``keep_previous`` before it,
    and whatever is the current version of a month, since the monthly reads need it."""
    newest = (manifest.select(F.col("version").alias("_v")).orderBy(F.col("_v").desc()).limit(keep_previous + 1)
              .withColumn("_new", F.lit(True)))
    return manifest.join(F.broadcast(newest), F.col("version") == F.col("_v"), "left").select(
        *manifest.columns, (F.col("is_current") | F.coalesce("_new", F.lit(False))).alias("keep_online"))


def rejected_row_retention(rejected: DataFrame, today: dt.date, days: int = 180,
                           ts: str = "created_at") -> DataFrame:
    """Rejected rows younger than ``days`` days are kept."""
    return rejected.withColumn("keep", F.col(ts) >= F.date_sub(F.lit(today), days))
