"""Token-budget batches over the whole ledger, and what is reported per batch.

The greedy fill is sequential: where one batch ends decides where the next starts. It is made parallel by noting that a
batch holds few rows. Every row costs at least `floor` tokens, so a batch that is open at the start of a chunk can only
continue into its first target/floor rows. Each chunk of rows therefore answers a small question on its own: "if a
batch starts at my row s, for each such s, where does the first batch of the next chunk start, and how many batches
began here?" Chaining these short answers gives every chunk its true entry point, and each chunk then marks its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.tokens import cost_micros, model_for
from ..session import materialize
from .ordering import CHUNK, global_positions, running_totals

# Chunk answers chained in one task; one more level covers FAN_IN * FAN_IN * CHUNK rows (4e12).
FAN_IN = 1024 * 8


def batch_order() -> list[Column]:
    """Account, category, description (missing text first), then row."""
    return [F.col("acctnum"), F.coalesce("category", F.lit("")), F.coalesce("descrptn", F.lit("")), F.col("row_idx")]


def _next_starts(cost: np.ndarray, solo: np.ndarray, target: int) -> np.ndarray:
    """For a batch starting at each row: the row where the following batch starts."""
    n = len(cost)
    total = np.cumsum(cost)
    before = total - cost
    full = np.searchsorted(total, before + target, side="right")
    solo_at = np.where(solo, np.arange(n), n)
    next_solo = np.minimum.accumulate(solo_at[::-1])[::-1]
    return np.where(solo, np.arange(1, n + 1), np.minimum(full, next_solo))


def _chunk_answer(frame: pd.DataFrame, chunk: int, rows: int, reach: int, target: int) -> pd.DataFrame:
    frame = frame.sort_values("pos")
    cost, solo = frame["cost"].to_numpy(), frame["solo"].to_numpy(dtype=bool)
    own = int((frame["pos"] < (chunk + 1) * rows).sum())
    nxt = _next_starts(cost, solo, target)
    exits, begun = np.arange(len(cost) + 1), np.zeros(len(cost) + 1, dtype=np.int64)
    inside = np.arange(own)
    exits[inside], begun[inside] = nxt[inside], 1
    # Follow the starts by doubling until every one has left the chunk.
    while (moving := exits[inside] < own).any():
        at = inside[moving]
        hop = exits[at]
        begun[at] += begun[hop]
        exits[at] = exits[hop]
    width = min(reach, own)
    return pd.DataFrame({
        "chunk": [chunk], "exits": [(exits[:width] - own).tolist()], "begun": [begun[:width].tolist()],
    })


def _chain(frame: pd.DataFrame, entry: int, number: int) -> list[tuple[int, int, int]]:
    """(chunk, entry row, batches before) for consecutive chunks."""
    out = []
    for chunk, exits, begun in frame.sort_values("chunk")[["chunk", "exits", "begun"]].itertuples(index=False):
        out.append((int(chunk), entry, number))
        if entry < len(exits):
            entry, number = int(exits[entry]), number + int(begun[entry])
        else:
            entry -= len(exits)  # a last chunk shorter than the batch that runs into it
    return out


def size_batches(
    items: DataFrame, target: int = vocab.CLASSIFY_TARGET_TOKENS, floor: int = vocab.ROW_OVERHEAD_TOKENS,
    chunk_rows: int = CHUNK, fan_in: int = FAN_IN,
) -> DataFrame:
    """`row_idx`, `pos`, `batch_id` of every item.

    Rows are taken in account, category, description order; a batch is closed when the next row would exceed `target`.
    A page-image item, or one above `target` by itself, is alone in its batch and closes the open one. Needs `acctnum`,
    `category`, `descrptn`, `row_idx`, `est_input_tokens` (at least `floor`) and `is_vision`.
    """
    reach = target // floor + 1
    if chunk_rows < reach:
        raise ValueError(f"chunk_rows must be at least {reach}")
    cost = F.when(F.col("est_input_tokens") >= floor, F.col("est_input_tokens")).otherwise(
        F.raise_error(F.lit(f"an item costs less than floor={floor} tokens"))
    )
    solo = F.col("is_vision") | (F.col("est_input_tokens") > target)
    narrow = items.select("acctnum", "category", "descrptn", "row_idx", cost.alias("cost"), solo.alias("solo"))
    ordered = global_positions(narrow, batch_order()).select(
        "row_idx", "pos", "cost", "solo", F.floor(F.col("pos") / chunk_rows).cast("bigint").alias("chunk")
    )

    # A chunk also sees the first rows of the next one, into which its last batch may run.
    leading = (F.pmod("pos", F.lit(chunk_rows)) < reach) & (F.col("chunk") > 0)
    seen = ordered.select("pos", "cost", "solo", F.explode(
        F.when(leading, F.array(F.col("chunk"), F.col("chunk") - 1)).otherwise(F.array("chunk"))
    ).alias("chunk"))

    def answer(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        return _chunk_answer(frame, int(key[0]), chunk_rows, reach, target)

    answers = materialize(
        seen.groupBy("chunk").applyInPandas(answer, "chunk long, exits array<long>, begun array<long>"), "chunk-answers"
    ).withColumn("span", F.floor(F.col("chunk") / fan_in).cast("bigint"))

    def summarise(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        """The answer of a whole span of chunks, for each entry row."""
        width = len(frame.sort_values("chunk")["exits"].iloc[0])
        exits, begun = [], []
        for entry in range(width):
            last_chunk, at, number = _chain(frame, entry, 0)[-1]
            final = frame.loc[frame["chunk"] == last_chunk].iloc[0]
            exits.append(int(final["exits"][at]) if at < len(final["exits"]) else at - len(final["exits"]))
            begun.append(number + (int(final["begun"][at]) if at < len(final["begun"]) else 0))
        return pd.DataFrame({"chunk": [int(key[0])], "exits": [exits], "begun": [begun]})

    def enter_spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if parts := list(frames):
            yield pd.DataFrame(_chain(pd.concat(parts), 0, 0), columns=["span", "span_entry", "span_number"])

    # One row per span: rows / (fan_in * chunk_rows) of them.
    spans = answers.groupBy("span").applyInPandas(summarise, "chunk long, exits array<long>, begun array<long>")
    entered = spans.coalesce(1).mapInPandas(enter_spans, "span long, span_entry long, span_number long")

    def enter_chunks(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        rows = _chain(frame, int(first["span_entry"]), int(first["span_number"]))
        return pd.DataFrame(rows, columns=["chunk", "entry", "number"])

    entries = answers.join(entered, "span").groupBy("span").applyInPandas(enter_chunks, "chunk long, entry long, number long")

    def mark(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        starts = np.zeros(len(frame), dtype=np.int64)
        nxt = _next_starts(frame["cost"].to_numpy(), frame["solo"].to_numpy(dtype=bool), target)
        at = int(frame["entry"].iloc[0])
        while at < len(frame):
            starts[at] = 1
            at = int(nxt[at])
        batch = int(frame["number"].iloc[0]) - 1 + np.cumsum(starts)
        return pd.DataFrame({"row_idx": frame["row_idx"], "pos": frame["pos"], "batch_id": batch})

    return ordered.join(entries, "chunk").groupBy("chunk").applyInPandas(mark, "row_idx long, pos long, batch_id long")


def batch_models(items: DataFrame, batches: DataFrame, floor_model: str = vocab.FLOOR_MODEL) -> DataFrame:
    """Rows, tokens and model per batch: any readable document lifts the whole batch to the invoice model."""
    readable = F.coalesce(F.col("invoice.kind").isin(*vocab.READABLE_KINDS), F.lit(False))
    return items.join(batches.select("row_idx", "batch_id"), "row_idx").groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("batch_rows"), F.sum("est_input_tokens").alias("input_tokens"),
        model_for(F.bool_or(readable), floor_model).alias("model"),
    )


def attribute_usage(rows: DataFrame, usage: DataFrame) -> DataFrame:
    """Batch usage goes to the first row of the batch (by `pos`), zero to the others.

    `usage`: batch_id, input_tokens, output_tokens. The first row is found by a plain minimum, so a batch of any size
    needs no window.
    """
    size = rows.groupBy("batch_id").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("batch_rows"))
    per_batch = size.join(usage, "batch_id", "left")
    leads = F.col("pos") == F.col("first_pos")
    spent = lambda c: F.when(leads, F.coalesce(F.col(c), F.lit(0))).otherwise(0).cast("bigint").alias(c)
    scope = F.when(leads, F.concat(F.lit("batch_of_"), F.col("batch_rows").cast("string"))).alias("usage_scope")
    kept = [c for c in rows.columns if c not in ("input_tokens", "output_tokens", "usage_scope")]
    return rows.select(kept).join(per_batch, "batch_id").select(*kept, spent("input_tokens"), spent("output_tokens"), scope)


def budget_crossing(log: DataFrame, cap_usd: float) -> DataFrame:
    """Completed batches with their running cost; `crossing` marks the first one that lifts it above the cap.

    `log`: seq (unique completion number), model, input_tokens, output_tokens. Costs are exact millionths of a USD.
    """
    cost = cost_micros(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    priced = log.select("seq", "model", cost.alias("cost_micros"))
    totals = running_totals(priced, "seq", "cost_micros", "running_micros")
    cap = F.lit(cap_usd * 1_000_000).cast("decimal(30,2)")
    above = F.col("running_micros") > cap
    crossing = above & (F.col("running_micros") - F.col("cost_micros") <= cap)
    return totals.select("seq", "cost_micros", "running_micros", above.alias("over_cap"), crossing.alias("crossing"))


def halve_batches(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows of failed batches in two halves (`half` 0 and 1, the left one smaller if odd); single rows stay at half 0.

    A batch never exceeds the row limit that the token target implies, which bounds the window per batch.
    """
    order = Window.partitionBy("batch_id").orderBy("pos")
    whole = Window.partitionBy("batch_id")
    size, at = F.count(F.lit(1)).over(whole), F.row_number().over(order)
    half = F.when((size > 1) & (at > F.floor(size / 2)), 1).otherwise(0)
    split = rows.join(failed.select("batch_id").distinct(), "batch_id", "left_semi")
    return split.select("row_idx", "batch_id", half.alias("half"), (size > 1).alias("retry"))


def rolling_usage(
    log: DataFrame, seconds: int = 60, input_cap: int | None = None, output_cap: int | None = None,
    bucket_seconds: int = 600,
) -> DataFrame:
    """Requests and tokens of the last `seconds` per model at every instant with a request.

    Charges are clamped to the cap. Equal instants are added up first. A charge is put in at its instant and taken out
    again just after the window, so that a running sum (linear, no sliding frame) gives the answer; time buckets keep a
    busy model from landing in one task, with the last `seconds` before each bucket copied into it.
    """
    span, bucket = seconds * 1_000_000, bucket_seconds * 1_000_000
    if bucket < span:
        raise ValueError("bucket_seconds must be at least seconds")
    clamp = lambda c, cap: F.col(c) if cap is None else F.least(F.col(c), F.lit(cap))
    instants = log.groupBy("model", "ts_us").agg(
        F.count(F.lit(1)).alias("req"), F.sum(clamp("input_tokens", input_cap)).alias("inp"),
        F.sum(clamp("output_tokens", output_cap)).alias("out"),
    )
    own = F.floor(F.col("ts_us") / bucket).cast("bigint")
    last = F.floor((F.col("ts_us") + span) / bucket).cast("bigint")
    copies = instants.withColumn("own", own).withColumn("bucket", F.explode(F.sequence(own, last)))
    events = F.array(
        F.struct(F.col("ts_us").alias("at"), F.lit(1).alias("sign")),
        F.struct((F.col("ts_us") + span + 1).alias("at"), F.lit(-1).alias("sign")),
    )
    moves = copies.select("model", "bucket", "own", "req", "inp", "out", F.explode(events).alias("e")).select(
        "model", "bucket", "own", "e.at", "e.sign", *[(F.col(c) * F.col("e.sign")).alias(c) for c in ("req", "inp", "out")]
    )
    running = Window.partitionBy("model", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = moves.select(
        "model", "bucket", "own", F.col("at").alias("ts_us"), "sign",
        F.sum("req").over(running).alias("requests"), F.sum("inp").over(running).alias("input_tokens"),
        F.sum("out").over(running).alias("output_tokens"),
    )
    return summed.where("sign = 1 and bucket = own").select("model", "ts_us", "requests", "input_tokens", "output_tokens")
