"""Posting ingestion: CSV read, validation, reasons, normalisation, quarantine
(S1-S3, P1-P8, F10, K2).

Rows stay all-string until validated.  The rejection reason is one column
built with ``coalesce(when(...), ...)`` in the fixed check order, so valid and
rejected rows come from one pass over the input.  Which columns are missing
is known from the header when the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgrid.functions.text import blank_to_null, clean_text, is_blank, strip_ws

# --- fixed values -----------------------------------------------------------
REQUIRED_COLUMNS = ("external_id", "source", "title", "company", "location", "posted_at", "description", "url")
OPTIONAL_COLUMNS = ("employment_type", "salary_min", "salary_max", "currency", "experience_level")
NON_BLANK_COLUMNS = ("external_id", "source", "title", "company", "url")
# Foreign layout: target field -> candidate source columns, first present wins.
FOREIGN_REQUIRED_CANDIDATES = {
    "external_id": ("posting_id",),
    "source": ("platform", "source_dataset"),
    "posted_at": ("posted_date",),
    "title": ("job_title", "title"),
    "company": ("company_name", "company"),
    "location": ("location",),
    "description": ("description", "job_description"),
    "url": ("url", "job_url"),
}
FOREIGN_OPTIONAL_CANDIDATES = {
    "employment_type": ("employment_type", "work_type"),
    "salary_min": ("salary_min",),
    "salary_max": ("salary_max",),
    "currency": ("currency",),
    "experience_level": ("experience_level",),
}
MSG_NOT_STRING = "Input should be a valid string"
MSG_NOT_DECIMAL = "Input should be a valid decimal"
# --- end of fixed values ----------------------------------------------------

# ISO date, or ISO date-time (trailing Z or numeric offset allowed) cut to its date.
DATE_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DATETIME_SHAPE = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]([01][0-9]|2[0-3])(:[0-5][0-9](:[0-5][0-9]([.][0-9]{1,6})?)?)?"
    r"(Z|[+-]([01][0-9]|2[0-3]):?[0-5][0-9])?$"
)
SALARY_TYPE = "decimal(18,2)"


SURPLUS = "surplus_fields"
_RECORD = "_corrupt_record"
_SURPLUS_REASON = "MALFORMED_ROW:surplus_fields"


def _surplus(df: DataFrame) -> Column:
    return F.when(F.col(SURPLUS), F.lit(_SURPLUS_REASON)) if SURPLUS in df.columns else F.lit(None).cast("string")


def read_posting_csv(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Header CSV, every column a string, blank stays ``""``.

    ``source_row_number`` is the 1-based row within each file.  It is computed
    without a global sort: rows are numbered inside each input split, and the
    split offsets (one small row per split) are summed per file.

    ``multi_line`` allows quoted newlines inside fields; such a file cannot be
    split, so it is read by one task.  Large feeds without embedded newlines
    should pass ``multi_line=False``: files then split across tasks and the
    row numbers stay exact.

    ``surplus_fields`` marks a row with more fields than the header, which a
    reader would cut without a word; both validators refuse it.  A row with
    fewer has blanks.  The mark is taken from the record as it stands in the file:
    separators outside quotes are counted.
    """
    reader = (spark.read.option("header", True).option("inferSchema", False).option("multiLine", multi_line)
              .option("escape", '"').option("mode", "PERMISSIVE").option("columnPruning", False))
    cols = reader.csv(path).columns
    fields = [T.StructField(c, T.StringType()) for c in (*cols, _RECORD)]
    raw = reader.option("columnNameOfCorruptRecord", _RECORD).schema(T.StructType(fields)).csv(path)
    bare = F.regexp_replace(F.coalesce(F.col(_RECORD), F.lit("")), '"([^"]|"")*"', "")
    df = raw.select(
        *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in cols],
        # the last term holds always: Spark reads the record of a row only beside a column of it
        ((F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) >= len(cols))
         & (F.length(F.coalesce(F.col(f"`{cols[0]}`"), F.lit(""))) >= 0)).alias(SURPLUS),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    blocks = df.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_min_mid"))
    w = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_file", "_block", "_min_mid",
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    return (
        df.join(offsets, ["_file", "_block"])
        .select(*[F.col(f"`{c}`") for c in cols], SURPLUS,
                (F.col("_offset") + F.col("_mid") - F.col("_min_mid") + 1).alias("source_row_number"),
                F.col("_file").alias("source_file"))
    )


def posted_at_valid(c: Column | str) -> Column:
    """ISO date or ISO date-time with a real calendar date."""
    s = strip_ws(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    day = F.substring(s, 1, 10).try_cast("date")
    return (s.rlike(DATE_SHAPE) | s.rlike(DATETIME_SHAPE)) & day.isNotNull()


def parse_posted_at(c: Column | str) -> Column:
    s = strip_ws(F.col(c) if isinstance(c, str) else c)
    return F.when(posted_at_valid(s), F.substring(s, 1, 10).try_cast("date"))


def _salary_bad(c: str) -> Column:
    v = blank_to_null(F.col(c))
    return v.isNotNull() & v.try_cast(SALARY_TYPE).isNull()


def rejection_reason(df: DataFrame) -> Column:
    """First rejection reason of a canonical row, null when the row is valid.

    Order: missing column, surplus fields, blank required field, bad date, contract failures
    (blank location/description, unparsable salary), empty after cleaning.
    """
    for c in REQUIRED_COLUMNS:
        if c not in df.columns:
            return F.lit(f"MISSING_REQUIRED_FIELD:{c}")
    checks: list[Column] = [_surplus(df)]
    for c in NON_BLANK_COLUMNS:
        checks.append(F.when(is_blank(c), F.lit(f"EMPTY_REQUIRED_FIELD:{c}")))
    checks.append(F.when(~posted_at_valid("posted_at"), F.lit("INVALID_DATE:posted_at")))
    for c in ("location", "description"):
        checks.append(F.when(is_blank(c), F.lit(f"CANONICAL_VALIDATION:{c}")))
    for c in ("salary_min", "salary_max"):
        if c in df.columns:
            checks.append(F.when(_salary_bad(c), F.lit(f"CANONICAL_VALIDATION:{c}")))
    for c in ("source", "title", "company"):
        checks.append(F.when(clean_text(c) == F.lit(""), F.lit(f"EMPTY_AFTER_NORMALIZATION:{c}")))
    return F.coalesce(*checks)


def validate_postings(df: DataFrame) -> DataFrame:
    """Add ``reason`` (null = valid) to canonical all-string rows."""
    return df.withColumn("reason", rejection_reason(df))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) from one validated DataFrame."""
    return validated.where(F.col("reason").isNull()), validated.where(F.col("reason").isNotNull())


def to_raw_posting(valid: DataFrame) -> DataFrame:
    """Typed row contract: stripped text (blank -> null), date, decimal salaries."""
    out = [F.col("source_row_number")]
    for c in REQUIRED_COLUMNS:
        out.append((parse_posted_at(c) if c == "posted_at" else blank_to_null(F.col(c))).alias(c))
    for c in OPTIONAL_COLUMNS:
        if c in valid.columns:
            v = blank_to_null(F.col(c))
            out.append((v.try_cast(SALARY_TYPE) if c.startswith("salary") else v).alias(c))
        else:
            out.append(F.lit(None).cast(SALARY_TYPE if c.startswith("salary") else "string").alias(c))
    keep = [c for c in valid.columns if c not in REQUIRED_COLUMNS + OPTIONAL_COLUMNS + ("source_row_number", "reason", SURPLUS)]
    return valid.select(*out, *keep)


def normalize_postings(raw: DataFrame) -> DataFrame:
    """Cleaned columns and the default role hint."""
    return raw.select(
        "*",
        clean_text("source").alias("normalized_source"),
        clean_text("title").alias("normalized_title"),
        clean_text("company").alias("normalized_company"),
        clean_text("location").alias("normalized_location"),
        clean_text("description").alias("normalized_description"),
        clean_text("title").alias("normalized_role_hint"),
    )


def quarantine_rows(rejected: DataFrame, job_id: str | Column, raw_columns: list[str] | None = None,
                    row_number: str = "source_row_number") -> DataFrame:
    """Rejected-row sink rows: job, row number, raw payload as JSON, reason."""
    cols = raw_columns or [c for c in rejected.columns if c not in (row_number, "reason", "source_file", SURPLUS)]
    job = F.lit(job_id) if isinstance(job_id, str) else job_id
    return rejected.select(
        job.alias("pipeline_job_id"),
        F.col(row_number).cast("bigint").alias("row_number"),
        F.to_json(F.struct(*[F.col(c) for c in cols])).alias("raw_payload"),
        F.col("reason"),
    )


def write_quarantine(rows: DataFrame, path: str) -> None:
    """Append rejected rows, partitioned by job."""
    rows.write.mode("append").partitionBy("pipeline_job_id").parquet(path)


def validation_report(df: DataFrame, layout: str) -> DataFrame:
    """One row for a frame in the foreign layout: required columns found and missing, rows valid and rejected."""
    missing = [c for c, names in FOREIGN_REQUIRED_CANDIDATES.items() if not set(names) & set(df.columns)]
    return adapt_foreign(df).agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(F.col("reason").isNull()).alias("rows_valid"),
        F.count_if(F.col("reason").isNotNull()).alias("rows_rejected"),
    ).select(F.lit(layout).alias("layout"), F.lit(len(FOREIGN_REQUIRED_CANDIDATES) - len(missing)).alias("required_found"),
             F.lit(",".join(missing)).alias("required_missing"), "rows_read", "rows_valid", "rows_rejected")


def adapt_foreign(df: DataFrame) -> DataFrame:
    """Map a foreign-layout frame onto the canonical columns.

    Candidate columns are resolved against the header once.  The result has
    the canonical columns (posted_at as ISO text) plus ``reason`` (null when the
    row adapted and passed the row contract).
    """
    present = set(df.columns)
    staged: dict[str, Column] = {}
    ordered_checks: list[Column] = [_surplus(df)]
    missing_reason: str | None = None
    for target, candidates in FOREIGN_REQUIRED_CANDIDATES.items():
        src = next((c for c in candidates if c in present), None)
        if src is None:
            missing_reason = f"MISSING_SOURCE_COLUMN:{target}:{'|'.join(candidates)}"
            break
        value = F.col(src)
        if target == "posted_at":
            s = strip_ws(F.coalesce(value, F.lit("")))
            month = F.concat(s, F.lit("-01"))
            as_date = F.when(F.length(s) == 7,
                             F.when(month.rlike(DATE_SHAPE), month.try_cast("date")))\
                .otherwise(F.when(s.rlike(DATE_SHAPE), s.try_cast("date")))
            ordered_checks.append(F.when(as_date.isNull(), F.lit("INVALID_SOURCE_DATE:posted_date")))
            staged[target] = F.date_format(as_date, "yyyy-MM-dd")
        else:
            staged[target] = value
    for target, candidates in FOREIGN_OPTIONAL_CANDIDATES.items():
        src = next((c for c in candidates if c in present), None)
        staged[target] = F.lit(None).cast("string") if src is None else F.when(~is_blank(src), F.col(src))
    if missing_reason is not None:
        # checks of fields before the missing one still come first
        reason = F.coalesce(*ordered_checks, F.lit(missing_reason))
    else:
        contract = []
        for field in ("external_id", "source", "title", "company", "location", "description", "url"):
            contract.append(F.when(is_blank(staged[field]), F.lit(f"CANONICAL_VALIDATION:{field}:{MSG_NOT_STRING}")))
        for field in ("salary_min", "salary_max"):
            v = blank_to_null(staged[field])
            contract.append(F.when(v.isNotNull() & v.try_cast(SALARY_TYPE).isNull(),
                                   F.lit(f"CANONICAL_VALIDATION:{field}:{MSG_NOT_DECIMAL}")))
        joined = F.concat_ws(";", *contract)
        empty = [F.when(clean_text(staged[c]) == F.lit(""), F.lit(f"EMPTY_AFTER_NORMALIZATION:{c}"))
                 for c in ("source", "title", "company")]
        reason = F.coalesce(*ordered_checks, F.when(joined != F.lit(""), joined), *empty)
    canon = [staged.get(c, F.lit(None).cast("string")).alias(c) for c in REQUIRED_COLUMNS + OPTIONAL_COLUMNS]
    extra = [F.col("source_row_number")] if "source_row_number" in present else []
    return df.select(*extra, *canon, reason.alias("reason"))
