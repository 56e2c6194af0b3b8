"""Streaming operators end equal to their batch twins."""

import datetime as dt

from pyspark.sql import functions as F

from skillgrid.operators import dedup, ops
from skillgrid.plans import stream_plans, text_plans
from skillgrid.sources.tables import document_postings, table
from skillgrid.streaming import evidence as S
from tests.conftest import SF


def test_running_evidence_equals_batch(spark):
    got = {(r["user_id"], r["event_type"]): (r["evidence_count"], r["threshold_met"])
           for r in stream_plans.evidence_threshold_stream(spark, SF).collect()}
    batch = table(spark, SF, "events").groupBy("user_id", "event_type").count().collect()
    assert got == {(r["user_id"], r["event_type"]): (r["count"], r["count"] >= 5) for r in batch}


def test_outbox_stream_equals_batch(spark):
    cols = ["aggregate_id", "event_type", "event_seq", "payload", "attempts"]
    s = sorted(tuple(r[c] for c in cols) for r in stream_plans.outbox_stream(spark, SF).collect())
    e = table(spark, SF, "events")
    b = ops.outbox_first(e, aggregate_id="user_id", event_type="event_type", ts="ts", seq="event_id",
                         payload="props")
    assert s == sorted(tuple(r[c] for c in cols) for r in b.collect())


def test_stream_runs_several_batches_and_is_idempotent_per_batch(spark):
    events = table(spark, SF, "events")
    folder = S.stage_files(events, S.scratch_folder(spark, "t-landing"), 300)
    out, ckpt = S.scratch_folder(spark, "t-out"), S.scratch_folder(spark, "t-ckpt")
    stream = S.running_evidence(S.file_stream(spark, folder, events.schema), ["event_type"])
    batches = S.run_available_now(stream, out, ckpt)
    assert batches >= 3
    # a rerun of the finished query processes nothing new and keeps the result
    S.run_available_now(S.running_evidence(S.file_stream(spark, folder, events.schema), ["event_type"]), out, ckpt)
    final = {r["event_type"]: r["evidence_count"] for r in S.latest_per_key(spark, out, ["event_type"]).collect()}
    assert final == {r["event_type"]: r["count"] for r in events.groupBy("event_type").count().collect()}


def test_due_events_filter(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 2, 1))], "id int, ts timestamp")
    assert [r["id"] for r in S.due_events(df, dt.datetime(2024, 1, 15)).collect()] == [1]
    assert F is not None


def test_dedup_within_watermark(spark):
    events = table(spark, SF, "events")
    doubled = events.unionByName(events)
    folder = S.stage_files(doubled, S.scratch_folder(spark, "t-dup"), 300)
    out, ckpt = S.scratch_folder(spark, "t-dup-out"), S.scratch_folder(spark, "t-dup-ckpt")
    stream = S.dedup_within_watermark(S.file_stream(spark, folder, doubled.schema), ["event_id"], "ts", "30 days")
    S.run_available_now(stream.select("event_id"), out, ckpt, "append")
    got = spark.read.parquet(out)
    assert got.count() == events.count() == got.select("event_id").distinct().count()


def test_arrival_batches():
    assert S.arrival_batches(10, 4, 1000) == (3, 1)
    assert S.arrival_batches(40_000, 4, 1000) == (1000, 10)
    assert S.arrival_batches(0, 4, 1000) == (1, 1)


def test_survivors_over_batches_equal_the_batch_query(spark):
    """Copies arrive in other batches and before the row that survives; a rerun changes nothing."""
    rows = document_postings(spark, SF)
    copies = rows.withColumn("source_row_number", F.col("source_row_number") + 100_000)
    order = copies.unionByName(rows).orderBy(F.col("source_row_number").desc()).coalesce(1)
    folder = S.stage_files(order, S.scratch_folder(spark, "t-postings"), 120)
    out, ckpt = S.scratch_folder(spark, "t-surv"), S.scratch_folder(spark, "t-surv-ckpt")

    def run():
        n = S.run_available_now(S.posting_survivors(S.file_stream(spark, folder, rows.schema)), out, ckpt)
        return n, sorted(map(str, S.latest_per_key(spark, out, list(dedup.POSTING_DEDUP_KEY)).select(
            "source_row_number", "external_id", "posted_at").collect()))
    batches, got = run()
    want = sorted(map(str, text_plans.posting_survivors(spark, SF).select(
        "source_row_number", "external_id", "posted_at").collect()))
    assert batches >= 3 and got == want and run()[1] == got


def test_event_dedup_state_expires_and_late_rows_go(spark):
    t0 = dt.datetime(2026, 5, 1)
    folder = S.scratch_folder(spark, "t-late")
    for hours in ([0, 1, 1], [1, 30], [60, 31], [2]):  # the last is a new event, but older than the watermark
        spark.createDataFrame([(h if h != 31 else 30, t0 + dt.timedelta(hours=h)) for h in hours],
                              "id int, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
    stream = S.dedup_within_watermark(S.file_stream(spark, folder, "id int, ts timestamp"), ["id"], "ts", "10 hours")
    out = S.scratch_folder(spark, "t-late-out")
    q = (stream.writeStream.foreachBatch(S._batch_writer(out)).option("checkpointLocation", S.scratch_folder(spark, "t-late-c"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [0, 1, 30, 60]
    state = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    assert max(x["numRowsTotal"] for x in state) <= 3 and sum(x["numRowsDroppedByWatermark"] for x in state) == 1
