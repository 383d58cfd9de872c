"""Tallies over decision records. Currencies are never added together; money is summed as decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.mining import mine_invoice_key
from ..functions.cleaning import strip
from ..functions.tokens import cost_micros
from .joins import beside

def _count() -> Column:
    return F.count(F.lit(1))


#: What amounts are summed as: 36 digits before the point.
_MONEY = "decimal(38,2)"


def money(c: str = "amount") -> Column:
    """Sum of amounts as decimals; null if it has more digits than they hold. `unsummed` rows are in no sum."""
    return F.try_sum(F.col(c).try_cast(_MONEY))


def _unsummed(c: str) -> Column:
    return F.col(c).isNotNull() & F.col(c).try_cast(_MONEY).isNull()


def unsummed(records: DataFrame, c: str = "amount") -> DataFrame:
    """Rows whose amount is no money value and so is in no sum: not a number, or of more than 36 digits."""
    return records.where(_unsummed(c))


def read_stats(ledger: DataFrame, skipped_blank_rows: DataFrame | None = None) -> DataFrame:
    """Rows, blank amounts and a currency tally (`EUR=3,USD=5`), one row.

    `skipped_blank_rows` (one row, one column of that name) is what the reader left out; it is added to the result.
    """
    per_currency = ledger.groupBy("currency").agg(_count().alias("n"), F.count_if("amount_was_blank").alias("blank"))
    entry = F.concat(F.col("currency"), F.lit("="), F.col("n").cast("string"))
    stats = per_currency.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_data_rows"),
        F.coalesce(F.sum("blank"), F.lit(0)).alias("blank_amount_rows"),
        F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("currency_tally"),
    )
    return stats if skipped_blank_rows is None else beside(stats, skipped_blank_rows.select("skipped_blank_rows"))


def ingest_check(ledger: DataFrame) -> DataFrame:
    """Negatives, close entries, rows with a URL, rows without one whose text holds a key."""
    mined = mine_invoice_key(F.col("descrptn"), F.col("adddesc"))["key"]
    url = F.coalesce("invoice_url", F.lit("")) != ""
    return ledger.agg(
        F.count_if(F.col("amount") < 0).alias("negative_rows"),
        F.count_if(F.upper(strip(F.col("userid"))) == vocab.CLOSE_USER).alias("close_rows"),
        F.count_if(url).alias("url_rows"), F.count_if(~url & mined.isNotNull()).alias("mined_rows"),
    )


def class_tally(records: DataFrame) -> DataFrame:
    """Records per label, with and without the M&A sweep."""
    return records.groupBy("classification").agg(
        _count().alias("n"), F.count_if(F.col("phase") != "deal_profile").alias("n_excl_deal_profile")
    )


def phase_tally(records: DataFrame) -> DataFrame:
    return records.groupBy("phase").agg(_count().alias("n"))


def amounts(records: DataFrame) -> DataFrame:
    return records.groupBy("classification", "currency").agg(money().cast("double").alias("amount"))


def coverage(records: DataFrame, total_rows_in: DataFrame) -> DataFrame:
    """`total_rows_in`: one row, one column of that name."""
    counted = records.agg(_count().alias("records"), F.count_distinct("row_idx").alias("rows"))
    return beside(total_rows_in, counted).select(
        "total_rows_in", "records", (F.col("total_rows_in") - F.col("rows")).alias("rows_with_no_record")
    )


def _filled(counted: DataFrame, columns: list[str], keys: list[tuple]) -> DataFrame:
    """Counts per `columns`, with a zero for each of the fixed `keys` that did not occur."""
    spark = counted.sparkSession
    zeros = spark.createDataFrame(keys, ", ".join(f"{c} string" for c in columns)).withColumn("n", F.lit(0).cast("bigint"))
    return counted.unionByName(zeros).groupBy(*columns).agg(F.sum("n").alias("n"))


def flag_counts(records: DataFrame) -> DataFrame:
    """Occurrences per flag, every known flag listed."""
    counted = records.select(F.explode("flags").alias("flag")).groupBy("flag").agg(_count().alias("n"))
    return _filled(counted, ["flag"], [(f,) for f in vocab.FLAGS])


def invoice_tallies(records: DataFrame) -> DataFrame:
    """had_invoice, invoice_accessed, source and read path; the last two only for documents that were read."""
    read = F.col("invoice.kind").isin(*vocab.READABLE_KINDS)
    entries = {
        "had_invoice": F.col("had_invoice"), "invoice_accessed": F.col("invoice_accessed"),
        "by_source": F.when(read, F.col("invoice.source")), "by_read_path": F.when(read, F.col("invoice.read_path")),
    }
    pairs = F.array(*[F.struct(F.lit(s).alias("section"), k.alias("value")) for s, k in entries.items()])
    counted = (
        records.select(F.explode(pairs).alias("p")).where("p.value is not null")
        .groupBy("p.section", "p.value").agg(_count().alias("n"))
    )
    keys = [(s, k) for s in ("had_invoice", "invoice_accessed") for k in vocab.YES_NO]
    keys += [("by_source", k) for k in vocab.INVOICE_SOURCES] + [("by_read_path", k) for k in vocab.READ_PATHS]
    return _filled(counted, ["section", "value"], keys)


def deal_profile_stats(records: DataFrame) -> DataFrame:
    swept = F.col("phase") == "deal_profile"
    has = lambda f: F.array_contains("flags", f)
    return records.agg(
        F.count_if(F.col("acctnum") == vocab.MA_ACCOUNT).alias("ma_rows_total"),
        F.count_if(swept).alias("auto_non_recurring"),
        F.count_if(swept & ~has("deal_sweep_failed") & ~has("deal_sweep_skipped")).alias("swept_ok"),
        F.count_if(has("deal_sweep_failed")).alias("sweep_failed"),
        F.count_if(has("deal_sweep_skipped")).alias("sweep_skipped"),
        F.count_if(has("deal_profile_match")).alias("deal_profile_match_count"),
        F.count_if(swept & (F.col("invoice_accessed") == "yes")).alias("invoices_read"),
    )


def usage_totals(records: DataFrame) -> DataFrame:
    """Tokens, exact cost, errors, the most used model (ties by name) and all models seen.

    Needs model_version, input_tokens, output_tokens, error. Tallied per model first, then folded.
    """
    model = F.col("model_version")
    per_model = records.groupBy("model_version").agg(
        _count().alias("n"), F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"),
        F.sum(cost_micros(model, F.col("input_tokens"), F.col("output_tokens"))).alias("micros"),
    )
    named = model.isNotNull()
    folded = per_model.agg(
        F.sum("input").alias("input_tokens"), F.sum("output").alias("output_tokens"), F.sum("errors").alias("error_count"),
        F.round((F.sum("micros") / F.lit(1_000_000)).cast("double"), 4).alias("cost_actual_usd"),
        F.array_sort(F.collect_list(F.when(named, F.struct((-F.col("n")).alias("rank"), model.alias("name"))))).alias("ranked"),
        F.array_sort(F.collect_set(model)).alias("seen"),
    )
    fallback = F.lit(vocab.FLOOR_MODEL)
    return folded.select(
        "input_tokens", "output_tokens", "error_count", "cost_actual_usd",
        F.coalesce(F.get("ranked", F.lit(0))["name"], fallback).alias("model_version"),
        F.when(F.size("seen") > 0, F.array_join("seen", ",")).otherwise(fallback).alias("model_versions"),
    )


def run_summary(records: DataFrame, total_rows_in: DataFrame) -> DataFrame:
    """The scorecard as one JSON document, assembled from small aggregates.

    Every part is at most a few dozen rows before it is folded into the document.
    """
    def listed(df: DataFrame, name: str) -> DataFrame:
        columns = df.columns
        entries = F.array_sort(F.collect_list(F.struct(*columns)))
        return df.agg(entries.alias(name))

    def single(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.struct(*df.columns).alias(name))

    left_out = records.agg(F.count_if(_unsummed("amount")).alias("unsummed_rows"))
    parts = [
        single(coverage(records, total_rows_in), "coverage"), listed(class_tally(records), "by_classification"),
        listed(phase_tally(records), "by_phase"), listed(amounts(records), "amounts_by_classification_currency"),
        single(left_out, "amounts"),
        listed(invoice_tallies(records), "invoice"), single(deal_profile_stats(records), "deal_profile"),
        listed(flag_counts(records), "flag_counts"), single(usage_totals(records), "usage"),
    ]
    document = beside(*parts)
    return document.select(F.to_json(F.struct(*document.columns)).alias("summary"))
