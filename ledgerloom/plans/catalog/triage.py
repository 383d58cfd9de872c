"""Rule triage and the flagship: scope, triage, amounts by label and currency."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.mining import mine_invoice_key
from ...operators import scope, triage
from ..registry import query
from . import common  # noqa: F401


@query("p8_p13_mined_key", "mined", check="select row_idx, key, truncated from mined")
def mined_key(ctx):
    mined = mine_invoice_key(F.col("descrptn"), F.col("adddesc"))
    return ctx.view("ledger").select("row_idx", mined.alias("m")).select("row_idx", "m.key", "m.truncated")


@query("f3_rule_triage", "settled", check="""
select row_idx, rule, classification, basis, had_invoice, flags,
 case rule when 'reclass' then 'Row description contains ''reclass''; auto-labeled as a reclassification entry and not sent to the classifier.'
  when 'close_guard' then 'CLOSEGL row''s category/description reads as deal-related; the CLOSEGL auto-recurring guard tripped instead of auto-clearing this row.'
  when 'close' then 'System close entry (userid CLOSEGL); auto-classified recurring.' else 'negative amount; netting deferred (v3_00 §7)' end as reasoning,
 case when rule = 'close_guard' then 'CLOSEGL guard tripped: category or description suggests a deal/transaction entry; needs human confirmation before auto-clearing as recurring.' end as missing_info
from settled""")
def rule_triage(ctx):
    rows = triage.settled(triage.prepared(ctx.view("ledger")))
    return rows.select(
        "row_idx", "rule", "classification", "basis", "had_invoice", F.array_join("flags", ",").alias("flags"),
        "reasoning", "missing_info",
    )


@query("f3_scorer_bound", "triaged", check="select row_idx, amount from triaged where rule = 'scorer'")
def scorer_bound(ctx):
    return triage.scorer_bound(triage.prepared(ctx.view("ledger"))).select("row_idx", "amount")


@query("f4_invoice_reference", "mined",
       check="select row_idx, coalesce(invoice_url, '') <> '' or key is not null as referenced from mined")
def invoice_reference(ctx):
    rows = triage.with_mined_key(ctx.view("ledger"))
    referenced = triage.has_invoice_reference(F.col("invoice_url"), F.col("key"))
    return rows.select("row_idx", referenced.alias("referenced"))


@query("p15_reclass_text", "ledger", check="""
select row_idx, coalesce(descrptn, '') ilike '%reclass%' or coalesce(adddesc, '') ilike '%reclass%' as is_reclass from ledger""")
def reclass_text(ctx):
    return ctx.view("ledger").select(
        "row_idx", triage.is_reclass(F.col("descrptn"), F.col("adddesc")).alias("is_reclass")
    )


@query("p16_close_guard", "ledger", check="""
select row_idx, regexp_matches(concat(coalesce(category, ''), '|', coalesce(descrptn, '')), '(?i)acquisi|disposi|merger|transaction|deal') as guarded
from ledger""")
def close_guard(ctx):
    return ctx.view("ledger").select(
        "row_idx", triage.close_guard_trips(F.col("category"), F.col("descrptn")).alias("guarded")
    )


@query("x_scoped_amounts", "triaged", check="""
select case rule when 'close_guard' then 'human_review' when 'close' then 'recurring' when 'negative' then 'skipped_negative'
  when 'scorer' then 'not_processed' else rule end as classification, currency, count(*) as row_count,
 cast(sum(cast(amount as decimal(18,2))) as double) as amount
from triaged where period in (select distinct period from ledger order by period desc limit 3) and (amount_was_blank or abs(amount) >= 999)
group by 1, 2""")
def scoped_amounts(ctx):
    rows = triage.prepared(scope.filter_scope(ctx.view("ledger")))
    return rows.groupBy(
        F.coalesce("classification", F.lit("not_processed")).alias("classification"), "currency"
    ).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"),
    )
