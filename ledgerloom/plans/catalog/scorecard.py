"""Scorecard tallies over the records of a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import scorecard
from ..registry import part, query
from .reconcile import records


@query("a1_read_stats", "ledger", check="""
select count(*) as total_data_rows, count(*) filter (amount_was_blank) as blank_amount_rows,
 (select string_agg(concat(currency, '=', cast(n as varchar)), ',' order by currency) from (select currency, count(*) as n from ledger group by currency)) as currency_tally
from ledger""")
def read_stats(ctx):
    return scorecard.read_stats(ctx.view("ledger"))


@query("a2_ingest_check", "mined", check="""
select count(*) filter (amount < 0) as negative_rows, count(*) filter (upper(trim(userid)) = 'CLOSEGL') as close_rows,
 count(*) filter (invoice_url is not null) as url_rows, count(*) filter (invoice_url is null and key is not null) as mined_rows from mined""")
def ingest_check(ctx):
    return scorecard.ingest_check(ctx.view("ledger"))


@query("a8_class_tally", "records", check="""
select classification, count(*) as n, count(*) filter (phase <> 'deal_profile') as n_excl_deal_profile from records group by 1""")
def class_tally(ctx):
    return scorecard.class_tally(records(ctx))


@query("a8_phase_tally", "records", check="select phase, count(*) as n from records group by 1")
def phase_tally(ctx):
    return scorecard.phase_tally(records(ctx))


@query("a9_amounts", "records", check="""
select classification, currency, cast(sum(cast(amount as decimal(18,2))) as double) as amount from records group by 1, 2""")
def amounts(ctx):
    return scorecard.amounts(records(ctx))


@query("a10_coverage", "records", check="""
select (select count(*) from ledger) as total_rows_in, count(*) as records, (select count(*) from ledger) - count(distinct row_idx) as rows_with_no_record from records""")
def coverage(ctx):
    total = ctx.view("ledger").agg(F.count(F.lit(1)).alias("total_rows_in"))
    return scorecard.coverage(records(ctx), total)


_FLAGS = ("closegl_user", "reclass_rule", "skipped_negative", "had_invoice", "invoice_accessed", "invoice_unavailable",
          "deal_profile_match", "amount_blank", "deal_sweep_failed", "deal_sweep_skipped", "basis_mismatch",
          "invoice_read_mismatch", "invoice_truncated")


@query("a11_flag_counts", "records", check=" union all ".join(
    f"select '{f}' as flag, count(*) filter (list_contains(string_split(flags, ','), '{f}')) as n from records" for f in _FLAGS))
def flag_counts(ctx):
    return scorecard.flag_counts(records(ctx))


@query("a11_invoice_tallies", "records", check="""
select 'had_invoice' as section, v as value, (select count(*) from records where had_invoice = v) as n from (values ('yes'), ('no')) t(v)
union all select 'invoice_accessed', v, (select count(*) from records where invoice_accessed = v) from (values ('yes'), ('no')) t(v)
union all select 'by_source', v, (select count(*) from records where kind in ('pdf', 'text') and case when reference = 'url' then 'url' else 'local_file' end = v) from (values ('url'), ('local_file')) t(v)
union all select 'by_read_path', v, (select count(*) from records where case kind when 'pdf' then 'vision' when 'text' then 'text' end = v) from (values ('text'), ('vision')) t(v)""")
def invoice_tallies(ctx):
    return scorecard.invoice_tallies(records(ctx))


@query("a12_deal_profile_stats", "records", check="""
select count(*) filter (acctnum = 'MR58200000') as ma_rows_total, count(*) filter (phase = 'deal_profile') as auto_non_recurring,
 count(*) filter (phase = 'deal_profile' and model_version is not null) as swept_ok, count(*) filter (contains(flags, 'deal_sweep_failed')) as sweep_failed,
 count(*) filter (contains(flags, 'deal_sweep_skipped')) as sweep_skipped, count(*) filter (contains(flags, 'deal_profile_match')) as deal_profile_match_count,
 count(*) filter (phase = 'deal_profile' and invoice_accessed = 'yes') as invoices_read from records""")
def deal_profile_stats(ctx):
    return scorecard.deal_profile_stats(records(ctx))


part("usage_lines", ("decision_log",), """
select case when seq % 7 = 0 then null else model end as m, input_tokens, output_tokens, seq from decision_log
""")


@query("a13_usage_totals", "usage_lines", check="""
select sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, count(*) filter (seq % 11 = 0) as error_count,
 round(sum(case when m is null then 0 else input_tokens * case when m = 'claude-opus-4-8' then 5 when m = 'claude-haiku-4-5' then 1 else 3 end
  + output_tokens * case when m = 'claude-opus-4-8' then 25 when m = 'claude-haiku-4-5' then 5 else 15 end end) / 1e6, 4) as cost_actual_usd,
 (select m from usage_lines where m is not null group by m order by count(*) desc, m limit 1) as model_version,
 (select string_agg(m, ',' order by m) from (select distinct m from usage_lines where m is not null)) as model_versions from usage_lines""")
def usage_totals(ctx):
    log = ctx.view("decision_log").select(
        F.when(F.col("seq") % 7 != 0, F.col("model")).alias("model_version"), "input_tokens", "output_tokens",
        F.when(F.col("seq") % 11 == 0, "failed").alias("error"),
    )
    return scorecard.usage_totals(log)


@query("k3_run_summary")
def run_summary(ctx):
    total = ctx.view("ledger").agg(F.count(F.lit(1)).alias("total_rows_in"))
    return scorecard.run_summary(records(ctx), total)
