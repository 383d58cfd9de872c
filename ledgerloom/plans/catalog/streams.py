"""Streaming jobs run to the end of the event log; their final state is checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...session import scratch_path
from ...sources import fixtures
from ...streaming import live
from ..registry import query


#: Files that the event table is dealt to, out of order of time; a micro-batch reads two of them.
FILES, FILES_PER_BATCH = 8, 2


def _log_stream(ctx):
    """The decision log as a stream over the events in several micro-batches, each with rows of all times."""
    events = ctx.view("events")
    path = scratch_path(ctx.spark, "events")
    events.repartition(FILES, *[F.col(c) for c in events.columns]).write.parquet(path)
    events = ctx.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path)
    text = fixtures.view_sql("decision_log", fixtures.SPARK).replace("from events", "from {events}")
    return ctx.spark.sql(text, events=events).withColumn("ts", F.timestamp_micros("ts_us"))


def _finish(ctx, start, label: str) -> str:
    path, checkpoint = scratch_path(ctx.spark, label), scratch_path(ctx.spark, f"{label}-checkpoint")
    started = start(_log_stream(ctx), path, checkpoint, available_now=True)
    started.awaitTermination()
    return path


@query("t1_live_latest", "decision_log", check="""
select row_idx, seq, phase, classification, n - 1 as superseded from (
 select *, count(*) over (partition by row_idx) as n, row_number() over (partition by row_idx order by store_ord desc, seq desc) as rn from decision_log) t where rn = 1""")
def live_latest(ctx):
    path = _finish(ctx, live.stream_latest, "live-latest")
    return live.read_latest(ctx.spark, path).select("row_idx", "seq", "phase", "classification", "superseded")


@query("t2_live_tally", "decision_log", check="""
select ts_us // 60000000 * 60000000 as window_us, classification, phase, count(*) as n from decision_log group by all""")
def live_tally(ctx):
    return live.read_tally(ctx.spark, _finish(ctx, live.stream_tally, "live-tally"))


@query("t3_live_usage", "decision_log", check="""
select (ts_us // 10000000 - k) * 10000000 as window_us, model, count(*) as requests, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens
from decision_log cross join (select unnest(range(0, 6)) as k) s group by 1, 2""")
def live_usage(ctx):
    return live.read_usage(ctx.spark, _finish(ctx, live.stream_usage, "live-usage"))
