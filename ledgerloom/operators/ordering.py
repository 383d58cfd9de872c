"""Total order without a single-task window: global positions and running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_IN_PARTITION_BITS = 33
CHUNK = 65_536


def global_positions(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """0-based rank of every row under `order`, which must be unique.

    The rows are range-partitioned on the whole order, so equal leading values (a hot account, a hot vendor) spread
    over tasks. The written table fixes each row's partition; only one count per partition is then added up.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    written = materialize(ranged, "positions").withColumn("_part", F.shiftright("_id", _IN_PARTITION_BITS))
    # One row per shuffle partition: `parts` rows at most.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    inside = F.col("_id").bitwiseAND((1 << _IN_PARTITION_BITS) - 1)
    return (
        written.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + inside).cast("bigint"))
        .drop("_part", "_id", "_before")
    )


def running_totals(df: DataFrame, seq: str, value: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """Running sum of `value` in order of the unique, non-negative integer `seq`.

    Sums are taken per chunk of `chunk` sequence numbers and per chunk of chunks, so that no window holds more than
    `chunk` rows (the top level holds max(seq) / chunk^2 rows).
    """
    low = F.floor(F.col(seq) / chunk).cast("bigint")
    high = F.floor(F.col("_low") / chunk).cast("bigint")
    lows = df.groupBy(low.alias("_low")).agg(F.sum(value).alias("_sum")).withColumn("_high", high)
    highs = lows.groupBy("_high").agg(F.sum("_sum").alias("_sum"))

    def before(order: str, *by: str) -> Column:
        window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.sum("_sum").over(window)

    zero = F.lit(0)
    high_offsets = highs.select("_high", F.coalesce(before("_high"), zero).alias("_b2"))
    offsets = lows.withColumn("_b1", F.coalesce(before("_low", "_high"), zero)).join(high_offsets, "_high").select(
        "_low", (F.col("_b1") + F.col("_b2")).alias("_before")
    )
    inside = Window.partitionBy("_low").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.withColumn("_low", low).withColumn("_inside", F.sum(value).over(inside)).join(offsets, "_low")
        .withColumn(name, F.col("_before") + F.col("_inside")).drop("_low", "_inside", "_before")
    )
