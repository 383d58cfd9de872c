"""Cost and wall-clock forecasts before a run, and the distance to the actual cost afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.documents import is_readable
from ..functions.tokens import cost_micros, low_end_tokens
from ..session import materialize
from .batching import size_batches
from .joins import beside


def batch_target(rate_limits: dict | None) -> int:
    """Half the measured input limit if that is below the usual target."""
    limit = (rate_limits or {}).get("input_tokens_limit")
    return vocab.CLASSIFY_TARGET_TOKENS if not limit or limit <= 0 else int(min(vocab.CLASSIFY_TARGET_TOKENS, limit * 0.5))


def price_of(model: str) -> tuple[float, float]:
    """USD per million input and output tokens."""
    return next(((i, o) for name, i, o in vocab.PRICES if name in model), vocab.DEFAULT_PRICE)


def _measured(rate_limits: dict | None) -> dict[str, float]:
    return {k: v for k, v in (rate_limits or {}).items() if isinstance(v, (int, float)) and v > 0}


def _workers(limits: dict[str, float], target: int, out_per_batch: Column, latency: float, batches: Column) -> Column:
    rate = 60.0 / latency
    allowed = []
    if "requests_limit" in limits:
        allowed.append(F.lit(0.8 * limits["requests_limit"] / rate))
    if "input_tokens_limit" in limits:
        allowed.append(F.lit(0.8 * limits["input_tokens_limit"] / (target * rate)))
    if "output_tokens_limit" in limits:
        allowed.append(F.lit(0.8 * limits["output_tokens_limit"]) / (F.greatest(F.lit(1), out_per_batch) * rate))
    if not allowed:
        return F.greatest(F.lit(1), F.least(F.lit(vocab.WORKERS_UNMEASURED), batches)).cast("bigint")
    tightest = F.least(*allowed) if len(allowed) > 1 else allowed[0]
    return F.greatest(F.lit(1), F.least(F.floor(tightest), F.lit(vocab.WORKERS_CEILING), batches)).cast("bigint")


def _forecast(
    items: DataFrame, model: str, rate_limits: dict | None, target: int, latency: float, per_row_output: int | None,
    batch_overhead: int,
) -> DataFrame:
    """`per_row_output` None means the flat output per batch of the sweep, shared out by rows like the overhead."""
    limits = _measured(rate_limits)
    readable = is_readable(F.col("invoice"))
    narrow = materialize(
        items.select(
            "row_idx", "acctnum", "category", "descrptn", "est_input_tokens", "is_vision", readable.alias("readable"),
            low_end_tokens(F.col("est_input_tokens"), F.col("invoice")).alias("low"),
        ),
        "forecast-items",
    )
    total = lambda c, test=None: F.coalesce(F.sum(F.col(c) if test is None else F.when(test, F.col(c))), F.lit(0))
    sums = narrow.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if("readable").alias("rows_with_invoice"),
        total("low").alias("low"), total("est_input_tokens").alias("high"),
        total("low", F.col("readable")).alias("low_inv"), total("est_input_tokens", F.col("readable")).alias("high_inv"),
    )
    count = size_batches(narrow, target).agg((F.coalesce(F.max("batch_id"), F.lit(-1)) + 1).alias("est_batches"))
    base = beside(sums, count)
    rows, inv, batches = F.col("row_count"), F.col("rows_with_invoice"), F.col("est_batches")
    share = F.when(rows == 0, 0.0).otherwise(inv / rows)
    if per_row_output is None:
        output = batches * vocab.SWEEP_OUTPUT_PER_BATCH
        out_per_batch = F.lit(vocab.SWEEP_OUTPUT_PER_BATCH)
        inv_out, floor_out = output * share, output * (1 - share)
    else:
        output = rows * per_row_output
        out_per_batch = F.floor(output / F.greatest(F.lit(1), batches))
        inv_out, floor_out = inv * per_row_output, (rows - inv) * per_row_output
    low_extra, high_extra = F.lit(batch_overhead), batches * batch_overhead

    def cost(tokens: Column, out: Column, prices: tuple[float, float]) -> Column:
        return tokens / 1e6 * prices[0] + out / 1e6 * prices[1]

    inv_price, floor_price = price_of(vocab.INVOICE_MODEL), price_of(model)
    inv_low = cost(F.col("low_inv") + low_extra * share, inv_out, inv_price)
    inv_high = cost(F.col("high_inv") + high_extra * share, inv_out, inv_price)
    floor_low = cost(F.col("low") - F.col("low_inv") + low_extra * (1 - share), floor_out, floor_price)
    floor_high = cost(F.col("high") - F.col("high_inv") + high_extra * (1 - share), floor_out, floor_price)
    workers = _workers(limits, target, out_per_batch, latency, batches)
    waves = F.ceil(F.greatest(F.lit(0), batches - 1) / workers)
    walls = [F.when(batches >= 1, (latency + waves * latency) / 60.0).otherwise(0.0)]
    if "input_tokens_limit" in limits:
        walls.append((F.col("high") + high_extra) / (0.8 * limits["input_tokens_limit"]))
    if "requests_limit" in limits:
        walls.append(batches / (0.8 * limits["requests_limit"]))
    if "output_tokens_limit" in limits:
        walls.append(output / (0.8 * limits["output_tokens_limit"]))
    return base.select(
        "row_count", "rows_with_invoice", "est_batches",
        (F.col("low") + low_extra).alias("input_tokens_low"), (F.col("high") + high_extra).alias("input_tokens_high"),
        output.alias("output_tokens_est"), F.round(inv_low + floor_low, 6).alias("cost_low_usd"),
        F.round(inv_high + floor_high, 6).alias("cost_high_usd"), F.round(inv_low, 4).alias("invoice_cost_low_usd"),
        F.round(inv_high, 4).alias("invoice_cost_high_usd"), workers.alias("max_workers"),
        F.round(F.greatest(*walls) if len(walls) > 1 else walls[0], 6).alias("wall_clock_est_min"),
    )


def classify_forecast(items: DataFrame, model: str = vocab.FLOOR_MODEL, rate_limits: dict | None = None) -> DataFrame:
    return _forecast(
        items, model, rate_limits, batch_target(rate_limits), vocab.CLASSIFY_LATENCY_S, vocab.OUTPUT_TOKENS_PER_ROW, 0
    )


def sweep_forecast(items: DataFrame, model: str = vocab.FLOOR_MODEL, rate_limits: dict | None = None) -> DataFrame:
    """As the classify forecast, with a system overhead per batch (high) or once (low)."""
    return _forecast(
        items, model, rate_limits, vocab.SWEEP_TARGET_TOKENS, vocab.SWEEP_LATENCY_S, None, vocab.SWEEP_OVERHEAD_TOKENS
    )


def forecast_delta(log: DataFrame, cost_low_usd: float, cost_high_usd: float) -> DataFrame:
    """Actual cost, and its distance to the middle of the forecast."""
    spent = F.sum(cost_micros(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))) / F.lit(1_000_000)
    actual = F.round(F.coalesce(spent.cast("double"), F.lit(0.0)), 4)
    return log.agg(actual.alias("actual_cost_usd")).withColumn(
        "delta_usd", F.round(F.col("actual_cost_usd") - (cost_low_usd + cost_high_usd) / 2, 4)
    )
