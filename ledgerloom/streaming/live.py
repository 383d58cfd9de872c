"""Live views of append-only logs.

Each micro-batch writes its own small folder, named by batch id and overwritten on replay, so a restart changes nothing.
Readers fold the folders; `compact` merges them from time to time. No batch ever rewrites the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.log import latest_per_row


def _start(stream: DataFrame, write, checkpoint: str, mode: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _batch_writer(path: str, fold=None):
    def write(batch: DataFrame, batch_id: int) -> None:
        out = fold(batch) if fold else batch
        out.withColumn("batch_no", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _within(log: DataFrame, watermark: str | None) -> DataFrame:
    return log if watermark is None else log.withWatermark("ts", watermark)


def stream_latest(log: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keep the latest decision per row. `log`: row_idx, store_ord, seq and the record.

    A batch is folded before it is written. The greater (store_ord, seq) wins whenever it arrives, so the order of
    arrival does not matter and no watermark is needed.
    """
    return _start(log, _batch_writer(path, latest_per_row), checkpoint, "append", available_now)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The current table: the last decision of each row over all batches, and the log lines behind it."""
    parts = spark.read.option("basePath", path).parquet(path).drop("batch", "batch_no")
    order = F.struct("store_ord", "seq")
    rest = F.struct(*[c for c in parts.columns if c not in ("row_idx", "superseded")])
    return parts.groupBy("row_idx").agg(
        F.max_by(rest, order).alias("last"), (F.sum(F.col("superseded") + 1) - 1).alias("superseded")
    ).select("row_idx", "last.*", "superseded")


def compact_latest(spark: SparkSession, path: str, target: str) -> None:
    """Fold the batches of `path` into one batch of a new table at `target`."""
    folded = read_latest(spark, path).withColumn("batch_no", F.lit(0).cast("bigint"))
    folded.write.mode("overwrite").parquet(f"{target}/batch=0")


def stream_tally(
    log: DataFrame, path: str, checkpoint: str, watermark: str | None = None, window: str = "1 minute",
    available_now: bool = False,
) -> StreamingQuery:
    """Decisions per window, label and phase. `log`: ts, classification, phase.

    Every change to a window is written as it happens (update mode), so open windows are visible too. Without a watermark
    no row is ever too late, and the state keeps one small row per window, label and phase. With one, windows older than
    it leave the state and rows that are later than that are not counted: give it only where the log is known to be in
    order within that time.
    """
    counted = _within(log, watermark).groupBy(F.window("ts", window).alias("w"), "classification", "phase").agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.unix_micros("w.start").alias("window_us"), "classification", "phase", "n")
    return _start(counted, _batch_writer(path), checkpoint, "update", available_now)


def read_tally(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.option("basePath", path).parquet(path)
    return parts.groupBy("window_us", "classification", "phase").agg(F.max_by("n", "batch_no").alias("n"))


def compact_tally(spark: SparkSession, path: str, target: str) -> None:
    """As `compact_latest`. Readers of `path` move to `target` once it is written."""
    read_tally(spark, path).withColumn("batch_no", F.lit(0).cast("bigint")).write.mode("overwrite").parquet(f"{target}/batch=0")


def stream_usage(
    log: DataFrame, path: str, checkpoint: str, watermark: str | None = None, length: str = "60 seconds",
    slide: str = "10 seconds", available_now: bool = False,
) -> StreamingQuery:
    """Requests and tokens per model in sliding windows. `log`: ts, model, input_tokens, output_tokens.

    `watermark` as for `stream_tally`: the default loses nothing.
    """
    used = _within(log, watermark).groupBy(F.window("ts", length, slide).alias("w"), "model").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    ).select(F.unix_micros("w.start").alias("window_us"), "model", "requests", "input_tokens", "output_tokens")
    return _start(used, _batch_writer(path), checkpoint, "update", available_now)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.option("basePath", path).parquet(path)
    values = F.struct("requests", "input_tokens", "output_tokens")
    return parts.groupBy("window_us", "model").agg(F.max_by(values, "batch_no").alias("v")).select("window_us", "model", "v.*")


def compact_usage(spark: SparkSession, path: str, target: str) -> None:
    """As `compact_latest`. Readers of `path` move to `target` once it is written."""
    read_usage(spark, path).withColumn("batch_no", F.lit(0).cast("bigint")).write.mode("overwrite").parquet(f"{target}/batch=0")
