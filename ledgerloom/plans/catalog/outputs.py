"""Annotated ledger and its pointer and status texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import vocab
from ...operators import outputs, scope
from ..registry import part, query
from .reconcile import records

part("results", ("records",), """
select row_idx, classification, basis, phase, had_invoice, invoice_accessed, case when phase = 'classify' then invoice_read else '' end as invoice_read,
 coalesce(invoice_date, '') as invoice_date, coalesce(missing_info, '') as missing_info,
 case when coalesce(invoice_url, '') <> '' then invoice_url when kind in ('pdf', 'text') and reference = 'key' then concat(local_path, ' p.', pages_read) else '' end as invoice_pointer,
 coalesce(invoice_error, '') as invoice_error, flags,
 case when phase <> 'deal_profile' then '' when contains(flags, 'deal_sweep_failed') then 'could not gather' when contains(flags, 'deal_sweep_skipped') then 'not swept'
  when invoice_accessed = 'yes' then 'invoice read' else 'invoice not read' end as deal_sweep_status
from records
""")
_PLAIN = [c for c in vocab.RESULT_COLUMNS if c not in ("reasoning", "evidence", "missing_info")]


def _decided(ctx):
    """The records of rows that the decision log knows; the others are undecided."""
    return records(ctx).join(ctx.view("decision_log").select("row_idx").distinct(), "row_idx", "left_semi")


@query("p32_invoice_pointer", "results", check="select row_idx, invoice_pointer from results")
def pointer(ctx):
    return outputs.result_columns(records(ctx)).select("row_idx", "invoice_pointer")


@query("p33_sweep_status", "results", check="select row_idx, deal_sweep_status from results")
def sweep_status(ctx):
    return outputs.result_columns(records(ctx)).select("row_idx", "deal_sweep_status")


@query("k2_annotated_ledger", "ledger", "results", "decision_log", check=f"""
select l.row_idx, l.period, l.amount, {', '.join(f"r.{c}" for c in _PLAIN if c != 'classification')},
 case when r.row_idx is not null then r.classification when l.period >= '200101' then 'not_processed' end as classification
from ledger l left join (select * from results where row_idx in (select row_idx from decision_log)) r using (row_idx)""")
def annotated(ctx):
    ledger = ctx.view("ledger")
    in_scope = ledger.where(F.col("period") >= "200101")
    return outputs.annotate(ledger, _decided(ctx), in_scope).select("row_idx", "period", "amount", *_PLAIN)


@query("k2_annotated_again", "ledger", "results", "decision_log", check="""
select l.row_idx, case when r.row_idx is not null then r.classification else 'earlier' end as classification, 'kept' as "Flags2"
from ledger l left join (select * from results where row_idx in (select row_idx from decision_log)) r using (row_idx)""")
def annotated_again(ctx):
    carrying = ctx.view("ledger").withColumns({"Classification": F.lit("earlier"), "Flags2": F.lit("kept")})
    out_of_scope = ctx.view("ledger").where("false")
    return outputs.annotate(carrying, _decided(ctx), out_of_scope).select("row_idx", "classification", "Flags2")


@query("j10_ledger_decisions", "ledger", "results", "decision_log", check="""
select l.row_idx, l.amount, case when r.row_idx is null then 'not_processed' else r.classification end as classification
from ledger l left join (select * from results where row_idx in (select row_idx from decision_log)) r using (row_idx)""")
def ledger_decisions(ctx):
    return outputs.annotate(ctx.view("ledger"), _decided(ctx)).select("row_idx", "amount", "classification")
