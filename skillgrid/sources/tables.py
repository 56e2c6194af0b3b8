"""Readers for the shared Parquet tables and the domain views derived from them.

The operators take column names, so the driver's TPC-H-like tables stand in
for the posting domain:

* posting           = ``orders`` row (id ``o_orderkey``, date ``o_orderdate``)
* dataset           = ``o_orderstatus`` (F / O / P)
* role              = the customer's nation (``c_nationkey``)
* skill             = ``part.p_brand`` reached through ``lineitem``
* depth             = ``l_quantity / 50``, null when ``l_returnflag = 'N'``
* posting text      = ``documents.text``; role hint = ``documents.lang``
* outbox / ledger   = ``events``

Every reader selects only the columns it needs so the scan is pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.functions.text import first_line

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, *cols) -> DataFrame:
    """Read one shared table, pruned to ``cols`` when given."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def mapped_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting x role x skill hits with depth: lineitem ⋈ orders ⋈ customer ⋈ part.

    Columns: job_posting_id, dataset_id, role_id, skill_id, normalized_depth,
    posted_at (date), period_month (date).
    """
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand")
    posted = F.to_date("o_orderdate")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .join(p, li.l_partkey == p.p_partkey)
        .select(
            F.col("o_orderkey").alias("job_posting_id"),
            F.col("o_orderstatus").alias("dataset_id"),
            F.col("c_nationkey").alias("role_id"),
            F.col("p_brand").alias("skill_id"),
            F.when(F.col("l_returnflag") == "N", F.lit(None).cast("double"))
            .otherwise(F.col("l_quantity") / F.lit(50.0)).alias("normalized_depth"),
            posted.alias("posted_at"),
            F.trunc(posted, "month").alias("period_month"),
        )
    )


def posting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per posting (orders) with its role, dataset and month."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    posted = F.to_date("o_orderdate")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("job_posting_id"),
        F.col("o_orderstatus").alias("dataset_id"),
        F.col("c_nationkey").alias("role_id"),
        F.col("o_custkey").alias("company_key"),
        F.col("o_orderpriority").alias("title"),
        posted.alias("posted_at"),
        F.trunc(posted, "month").alias("period_month"),
    )


def document_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out as canonical posting rows (all strings), with dirt
    derived by arithmetic on the key so every engine sees the same input.

    source_row_number is ``doc_id + 1`` (documents are keyed densely from 0).
    """
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    k = F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 365).cast("int"))
    posted = (
        F.when(k % 11 == 3, F.lit("not-a-date"))
        .when(k % 5 == 0, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T09:30:00Z")))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    return d.select(
        (k + 1).alias("source_row_number"),
        k.cast("string").alias("external_id"),
        F.when(k % 7 == 1, F.lit("")).otherwise(F.col("source")).alias("source"),
        F.when(k % 19 == 2, F.lit("!!!")).otherwise(first_line("text")).alias("title"),
        F.when(k % 13 == 4, F.lit("   ")).otherwise(F.concat(F.lit("publisher "), F.col("lang"))).alias("company"),
        F.col("lang").alias("location"),
        posted.alias("posted_at"),
        F.col("text").alias("description"),
        F.when(k % 17 == 5, F.lit("")).otherwise(
            F.concat(F.lit("https://example.com/doc/"), k.cast("string"))).alias("url"),
        F.col("lang").alias("role"),
    )


def foreign_postings(spark: SparkSession, sf_dir: str, *, with_url: bool = True) -> DataFrame:
    """Events laid out in the foreign posting layout (month-only and bad dates included)."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    k = F.col("event_id")
    posted = (
        F.when(k % 10 == 1, F.lit("2024-13"))
        .when(k % 10 == 2, F.lit("bad-date"))
        .when(k % 3 == 0, F.date_format("ts", "yyyy-MM"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
    )
    cols = [
        (k + 1).alias("source_row_number"),
        k.cast("string").alias("posting_id"),
        F.col("event_type").alias("platform"),
        posted.alias("posted_date"),
        F.concat(F.lit("job "), F.col("event_type")).alias("job_title"),
        F.when(k % 9 == 4, F.lit(" ")).when(k % 9 == 5, F.lit("!?!")).otherwise(
            F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("company_name"),
        F.lit("remote").alias("location"),
        F.col("props").alias("job_description"),
        F.when(k % 4 == 0, F.lit("full time")).otherwise(F.lit("")).alias("work_type"),
        F.when(k % 6 == 5, F.lit("12x")).otherwise(F.lit("1000")).alias("salary_min"),
    ]
    if with_url:
        cols.append(F.concat(F.lit("https://example.com/e/"), k.cast("string")).alias("job_url"))
    return e.select(*cols)
