"""Structured Streaming versions of the incremental parts.

* T1 incremental ingest: a file-source stream whose micro-batches run the batch
  operators through ``foreachBatch``; survivors of duplicate postings are kept
  over all batches as keyed state.
* T2 outbox: at most one row per (aggregate, event type); the streaming state
  is one row per key holding the earliest event (``min_by``), so the result does
  not depend on the order files or rows arrive in.
* T3 running evidence per pair with the threshold flag (update mode).
* T4 due outbox rows: a stateless filter.

Every sink writes each micro-batch to its own ``_batch=<id>`` folder with
overwrite, so a retried batch replaces its own output (idempotent).  All
folders live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.functions.scores import EVIDENCE_THRESHOLD
from skillgrid.operators import dedup, ingest
from skillgrid.session import ensure_checkpoint_dir


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint directory."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def stage_files(df: DataFrame, folder: str, rows_per_file: int) -> str:
    """Write ``df`` as Parquet files of at most ``rows_per_file`` rows (a landing
    folder); the number of files follows the input, and nothing is shuffled."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(folder)
    return folder


def arrival_batches(rows: int, batches: int, file_rows: int) -> tuple[int, int]:
    """(rows a file, files a trigger) for a table of ``rows`` rows to arrive in about ``batches``
    micro-batches: small tables in small files, large ones in many files of ``file_rows`` a trigger."""
    per_batch = max(1, -(-rows // batches))
    return min(file_rows, per_batch), max(1, per_batch // file_rows)


def land_by_time(df: DataFrame, folder: str, ts: str, waves: int, rows_per_file: int) -> dt.timedelta:
    """Write ``df`` to ``folder`` in ``waves`` equal slices of time, one after the other, so files
    arrive in order of time; returns the length of a slice, which bounds how late a row can be."""
    first, last = df.agg(F.min(ts), F.max(ts)).first()
    if first is None:
        df.write.mode("append").parquet(folder)
        return dt.timedelta(seconds=1)
    length = (last - first) / waves + dt.timedelta(microseconds=1)
    for i in range(waves):
        (df.where((F.col(ts) >= F.lit(first + i * length)) & (F.col(ts) < F.lit(first + (i + 1) * length)))
         .write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(folder))
    return length


def file_stream(spark: SparkSession, folder: str, schema, max_files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(folder))


def _batch_writer(out_dir: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/_batch={batch_id}")
    return write


def run_available_now(stream: DataFrame, out_dir: str, checkpoint: str, output_mode: str = "update") -> int:
    """Process everything available, in micro-batches, then stop; returns batches run."""
    q = (stream.writeStream.outputMode(output_mode).foreachBatch(_batch_writer(out_dir))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return len(q.recentProgress)


def latest_per_key(spark: SparkSession, out_dir: str, keys: list[str]) -> DataFrame:
    """Final value per key from update-mode batch outputs: the row of the last batch."""
    rows = spark.read.parquet(out_dir)
    values = [c for c in rows.columns if c not in keys and c != "_batch"]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("_batch")).alias("_v"))
            .select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values]))


def running_evidence(stream: DataFrame, keys: list[str], threshold: int = EVIDENCE_THRESHOLD) -> DataFrame:
    """Running count per pair and whether it has reached the threshold."""
    return (stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("evidence_count"))
            .withColumn("threshold_met", F.col("evidence_count") >= threshold))


def first_event_per_key(stream: DataFrame, *, aggregate_id: str, event_type: str, ts: str, seq: str,
                        payload: str) -> DataFrame:
    """Earliest event per (aggregate, type) as streaming state."""
    return stream.groupBy(aggregate_id, event_type).agg(
        F.min_by(F.struct(F.col(seq).alias("event_seq"), F.col(ts).alias("available_at"),
                          F.col(payload).alias("payload")), F.struct(F.col(ts), F.col(seq))).alias("_e"),
        F.count(F.lit(1)).alias("attempts"),
    ).select(F.col(aggregate_id).alias("aggregate_id"), F.col(event_type).alias("event_type"),
             "_e.event_seq", "_e.available_at", "_e.payload", F.lit("pending").alias("status"), "attempts")


def dedup_within_watermark(stream: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """Drop repeats of a key that arrive within ``delay`` of each other.

    For key sets that grow without bound: state per key is dropped once the
    watermark passes, so memory stays bounded.  ``first_event_per_key`` is the
    exact variant when the key set itself is bounded.
    """
    from pyspark.sql.types import TimestampNTZType
    if isinstance(stream.schema[ts].dataType, TimestampNTZType):
        # event time must be a TIMESTAMP; the session zone is pinned to UTC
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def due_events(stream: DataFrame, now, ts: str = "ts") -> DataFrame:
    """Stateless pick-up filter for due rows (T4)."""
    return stream.where(F.col(ts) <= F.lit(now))


def posting_survivors(stream: DataFrame) -> DataFrame:
    """Survivors of canonical posting rows over all batches, as keyed state.

    One state row per dedup key holds the valid row of lowest number seen so
    far, without its long texts.  A repeat in a later batch changes nothing, an
    earlier row that arrives late replaces its successor, so the final rows
    equal the batch query in any order of arrival.
    """
    valid, _ = ingest.split_valid(ingest.validate_postings(stream))
    normalized = ingest.normalize_postings(ingest.to_raw_posting(valid))
    return dedup.dedup_postings(normalized.select(*dedup.POSTING_DEDUP_KEY, "source_row_number", "external_id"))


def ingest_stream(stream: DataFrame, quarantine_dir: str, valid_dir: str, checkpoint: str,
                  job_id: str = "stream") -> int:
    """Validate each arriving batch of canonical rows; valid rows and quarantined
    rows are written per batch (T1, P1-P8, K2)."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        validated = ingest.validate_postings(batch)
        valid, rejected = ingest.split_valid(validated)
        ingest.to_raw_posting(valid).write.mode("overwrite").parquet(f"{valid_dir}/_batch={batch_id}")
        ingest.quarantine_rows(rejected, F.concat(F.lit(job_id + "-"), F.lit(str(batch_id)))) \
            .write.mode("overwrite").parquet(f"{quarantine_dir}/_batch={batch_id}")
    q = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return len(q.recentProgress)
