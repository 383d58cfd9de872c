"""The review queue: what a human looks at, in vendor order, with totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import reporting
from .joins import lookup_join
from .ordering import global_positions
from .scorecard import money


def vendor() -> Column:
    return F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit(vocab.UNCATEGORIZED))


def flagged(rows: DataFrame) -> DataFrame:
    """Rows whose label calls for review, before the M&A account is taken out."""
    return rows.where(F.col("classification").isin(*vocab.REVIEW_CLASSES))


def _is_ma():
    return F.coalesce(F.col("acctnum") == vocab.MA_ACCOUNT, F.lit(False))


def review_rows(rows: DataFrame) -> DataFrame:
    return flagged(rows).where(~_is_ma())


def excluded_count(rows: DataFrame) -> DataFrame:
    """Flagged rows of the M&A account, which the review leaves out."""
    return flagged(rows).agg(F.count_if(_is_ma()).alias("ma_excluded"))


def vendor_exposure(review: DataFrame) -> DataFrame:
    """Total amount and first row per vendor, over every review row."""
    return review.groupBy(vendor().alias("vendor")).agg(
        F.coalesce(money(), F.lit(0)).alias("exposure"), F.min("row_idx").alias("first_row")
    )


def vendor_ranks(review: DataFrame) -> DataFrame:
    """Vendors by exposure, the larger first, ties by first appearance; `band` alternates from 1."""
    order = [F.desc("exposure"), F.asc("first_row")]
    ranked = global_positions(vendor_exposure(review), order, "vendor_rank")
    return ranked.withColumn("band", F.pmod(F.col("vendor_rank") + 1, F.lit(2)).cast("int"))


def review_queue(review: DataFrame) -> DataFrame:
    """Review rows with `vendor`, `vendor_rank`, `band` and their place `review_pos`.

    Order: vendor rank, entry date (missing first), row. The place comes from a range partitioning on all three, so
    the rows of one large vendor are spread over tasks.
    """
    keyed = lookup_join(
        review.withColumn("vendor", vendor()), vendor_ranks(review).select("vendor", "vendor_rank", "band", "exposure"),
        ["vendor"], "row_idx",
    )
    return global_positions(
        keyed, [F.col("vendor_rank"), F.coalesce("entrdate", F.lit("")), F.col("row_idx")], "review_pos"
    )


def review_table(queue: DataFrame) -> DataFrame:
    """The twelve visible columns, by place."""
    from ..functions.periods import quarter_of

    pointer = F.when(F.col("invoice_pointer") != "", F.col("invoice_pointer"))
    date = F.coalesce(F.date_format(F.col("entrdate").try_cast("date"), "MM/dd/yyyy"), F.col("entrdate"))
    return queue.select(
        "review_pos", "row_idx", quarter_of(F.col("period")).alias("quarter"), "period", date.alias("entry_date"),
        "vendor", F.col("descrptn").alias("description"), reporting.dash_if_empty(F.col("adddesc")).alias("additional"),
        F.col("amount").alias("amount_usd"), reporting.local_amount(F.col("currency"), F.col("amount")).alias("local_amount"),
        reporting.supporting_doc(pointer, F.col("had_invoice")).alias("supporting_doc"),
        reporting.class_label(F.col("classification")).alias("label"),
        reporting.dash_if_empty(F.col("reasoning")).alias("reasoning"),
        reporting.dash_if_empty(F.col("evidence")).alias("evidence"),
    )


def review_summary(review: DataFrame) -> DataFrame:
    """Count and amount per summary label, their total, and the grand total over every review row."""
    per_class = review.groupBy("classification").agg(F.count(F.lit(1)).alias("n"), F.coalesce(money(), F.lit(0)).alias("usd"))
    listed = per_class.where(F.col("classification").isin(*vocab.SUMMARY_CLASSES))
    zeros = review.sparkSession.createDataFrame([(c,) for c in vocab.SUMMARY_CLASSES], "classification string")
    lines = zeros.join(listed, "classification", "left").select(
        "classification", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("usd", F.lit(0)).cast("decimal(28,2)").alias("usd")
    )
    rolled = lines.rollup("classification").agg(F.sum("n").alias("n"), F.sum("usd").alias("usd")).withColumn(
        "classification", F.coalesce("classification", F.lit("Total"))
    )
    grand = per_class.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("usd"), F.lit(0)).alias("usd"))
    grand = grand.withColumn("classification", F.lit("Grand total"))
    both = rolled.unionByName(grand)
    return both.select("classification", "n", F.col("usd").cast("double").alias("usd"))
