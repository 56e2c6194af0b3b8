"""Streaming query plans (Q31): the input lands as files of bounded row count, in
its own partitioning, and is processed in a few micro-batches of as many files
as the size needs; the result tables are read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.operators import dedup
from skillgrid.sources.tables import document_postings, table
from skillgrid.streaming import evidence as S

BATCHES = 4  # micro-batches a table arrives in
FILE_ROWS = 1_000_000  # most rows of one file
REPEAT_AFTER = "1 hour"  # a repeated event carries a later time


def _landed(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a stream of files."""
    per_file, files = S.arrival_batches(rows.count(), BATCHES, FILE_ROWS)
    folder = S.stage_files(rows, S.scratch_folder(spark, name), per_file)
    return S.file_stream(spark, folder, rows.schema, files)


def _landed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(spark, table(spark, sf_dir, "events"), "landing-events")


def evidence_threshold_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q31: running evidence per (user, event type) over micro-batches."""
    out = S.scratch_folder(spark, "evidence-out")
    stream = S.running_evidence(_landed_events(spark, sf_dir), ["user_id", "event_type"])
    S.run_available_now(stream, out, S.scratch_folder(spark, "evidence-ckpt"), "update")
    return S.latest_per_key(spark, out, ["user_id", "event_type"])


def outbox_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outbox built incrementally; equals the batch outbox."""
    out = S.scratch_folder(spark, "outbox-out")
    stream = S.first_event_per_key(_landed_events(spark, sf_dir), aggregate_id="user_id",
                                   event_type="event_type", ts="ts", seq="event_id", payload="props")
    S.run_available_now(stream, out, S.scratch_folder(spark, "outbox-ckpt"), "update")
    return S.latest_per_key(spark, out, ["aggregate_id", "event_type"])


def ingest_stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document postings ingested as a stream; quarantined rows read back."""
    rows = document_postings(spark, sf_dir)
    quarantine, valid = S.scratch_folder(spark, "quarantine"), S.scratch_folder(spark, "valid")
    S.ingest_stream(_landed(spark, rows, "landing-docs"), quarantine, valid,
                    S.scratch_folder(spark, "ingest-ckpt"))
    return spark.read.parquet(quarantine).select("row_number", "reason")


def due_outbox_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q31d: stateless pick-up of due events as a stream (T4)."""
    out = S.scratch_folder(spark, "due-out")
    stream = S.due_events(_landed_events(spark, sf_dir), dt.datetime(2024, 1, 10)).select(
        "event_id", "user_id", "event_type", "ts")
    S.run_available_now(stream, out, S.scratch_folder(spark, "due-ckpt"), "append")
    return spark.read.parquet(out).drop("_batch")


def posting_survivors_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q31e: postings deduplicated over all batches by keyed state; equals the batch survivors."""
    out = S.scratch_folder(spark, "survivors-out")
    stream = _landed(spark, document_postings(spark, sf_dir), "landing-docs")
    S.run_available_now(S.posting_survivors(stream), out, S.scratch_folder(spark, "survivors-ckpt"), "update")
    return S.latest_per_key(spark, out, list(dedup.POSTING_DEDUP_KEY)).select(
        "source_row_number", "external_id", "normalized_source", "normalized_title", "normalized_company", "posted_at")


def event_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q31f: every fifth event arrives again with a later time; repeats go, state expires by watermark."""
    events = table(spark, sf_dir, "events")
    again = F.when(F.col("event_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sent = events.withColumn("_n", F.explode(again)).withColumn(
        "ts", (F.col("ts").cast("timestamp") + F.col("_n") * F.expr(f"INTERVAL {REPEAT_AFTER}"))).drop("_n")
    folder = S.scratch_folder(spark, "landing-repeats")
    per_file, files = S.arrival_batches(sent.count(), BATCHES, FILE_ROWS)
    late = S.land_by_time(sent, folder, "ts", BATCHES, per_file)
    stream = S.dedup_within_watermark(S.file_stream(spark, folder, sent.schema, files), ["event_id"], "ts",
                                      f"{int(late.total_seconds()) + 7200} seconds")
    out = S.scratch_folder(spark, "repeats-out")
    S.run_available_now(stream.select("event_id", "user_id", "event_type"), out,
                        S.scratch_folder(spark, "repeats-ckpt"), "append")
    return spark.read.parquet(out).drop("_batch")
