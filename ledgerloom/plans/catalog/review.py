"""Review queue, vendor ranks, totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import report
from ...operators.outputs import result_columns
from ..registry import part, query
from .reconcile import records

part("review", ("records",), """
select *, coalesce(nullif(category, ''), '(uncategorized)') as vendor from records
where classification in ('human_review', 'non_recurring', 'L') and acctnum <> 'MR58200000'
""")
part("vendors", ("review",), """
select vendor, exposure, first_row, row_number() over (order by exposure desc, first_row) - 1 as vendor_rank from (
 select vendor, sum(cast(amount as decimal(18,2))) as exposure, min(row_idx) as first_row from review group by vendor) v
""")


def review(ctx):
    return report.review_rows(records(ctx))


@query("f10_review_rows", "review", check="select row_idx, classification from review")
def review_rows(ctx):
    return review(ctx).select("row_idx", "classification")


@query("f10_excluded_rows", "records", check="""
select count(*) as ma_excluded from records where classification in ('human_review', 'non_recurring', 'L') and acctnum = 'MR58200000'""")
def excluded(ctx):
    return report.excluded_count(records(ctx))


@query("a22_vendor_exposure", "vendors", check="select vendor, cast(exposure as double) as exposure, first_row from vendors")
def exposure(ctx):
    return report.vendor_exposure(review(ctx)).withColumn("exposure", F.col("exposure").cast("double"))


@query("w6_review_order", "review", "vendors", check="""
select row_idx, vendor, vendor_rank, (vendor_rank + 1) % 2 as band,
 row_number() over (order by vendor_rank, coalesce(entrdate, ''), row_idx) - 1 as review_pos from review join vendors using (vendor)""")
def review_order(ctx):
    return report.review_queue(review(ctx)).select("row_idx", "vendor", "vendor_rank", "band", "review_pos")


@query("a21_review_summary", "review", check="""
select classification, count(*) as n, cast(sum(cast(amount as decimal(18,2))) as double) as usd from review where classification <> 'L' group by 1
union all select 'Total', count(*) filter (classification <> 'L'), cast(sum(cast(amount as decimal(18,2))) filter (classification <> 'L') as double) from review
union all select 'Grand total', count(*), cast(sum(cast(amount as decimal(18,2))) as double) from review""")
def review_summary(ctx):
    return report.review_summary(review(ctx))


_ALL_CLASSES = "case row_idx % 3 when 0 then 'L' when 1 then 'human_review' else 'recurring' end"


part("raw_labels", ("ledger",), f"select *, {_ALL_CLASSES} as c from ledger where acctnum <> 'MR58200000'")


@query("a21_review_summary_with_raw_label", "raw_labels", check="""
select 'human_review' as classification, count(*) filter (c = 'human_review') as n, cast(sum(cast(amount as decimal(18,2))) filter (c = 'human_review') as double) as usd from raw_labels
union all select 'non_recurring', 0, 0
union all select 'Total', count(*) filter (c = 'human_review'), cast(sum(cast(amount as decimal(18,2))) filter (c = 'human_review') as double) from raw_labels
union all select 'Grand total', count(*) filter (c <> 'recurring'), cast(sum(cast(amount as decimal(18,2))) filter (c <> 'recurring') as double) from raw_labels""")
def raw_label_summary(ctx):
    labelled = ctx.view("ledger").withColumn("classification", F.expr(_ALL_CLASSES))
    return report.review_summary(report.review_rows(labelled))


@query("k5_review_table", "review", "vendors", check="""
select row_number() over (order by vendor_rank, coalesce(entrdate, ''), row_idx) - 1 as review_pos, row_idx,
 concat(left(period, 4), 'Q', cast((cast(right(period, 2) as int) + 2) // 3 as varchar)) as quarter, period,
 strftime(cast(entrdate as date), '%m/%d/%Y') as entry_date, vendor, descrptn as description,
 cast(amount as double) as amount_usd, case when currency <> 'USD' then concat(currency, ' ', format('{:,.2f}', cast(amount as decimal(18,2)))) else '—' end as local_amount,
 case classification when 'human_review' then 'Human Review' when 'non_recurring' then 'Non-Recurring' else classification end as label
from review join vendors using (vendor)""")
def review_table(ctx):
    queue = report.review_queue(review(ctx))
    pointers = result_columns(records(ctx)).select("row_idx", "invoice_pointer")
    return report.review_table(queue.join(pointers, "row_idx")).drop("additional", "supporting_doc", "reasoning", "evidence")
