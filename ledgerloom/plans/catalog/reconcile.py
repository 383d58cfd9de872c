"""Reconciling scorer output with work items; sweep records; the records of a whole run."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ... import vocab
from ...operators import reconcile, scope, triage
from ..registry import part, query
from .resolution import prepared, shared_items

SWEPT_QUARTERS = ["1999Q1", "2001Q2"]

part("classify_items", ("items",), "select *, row_idx // 12 as batch_id from items where acctnum <> 'MR58200000'")
part("answers", ("scorer_rows", "classify_items"),
     "select * from scorer_rows where source_row in (select row_idx from classify_items)")
part("verdicts", ("classify_items", "answers"), """
select batch_id, count(*) filter (a.n is null) as missing, count(*) filter (i.row_idx is null) as extra, count(*) filter (a.n > 1) as repeated
from (select batch_id, row_idx from classify_items) i full join (select batch_id, row_idx, count(*) as n from answers group by all) a using (batch_id, row_idx) group by batch_id
""")
part("one_answer", ("answers",), "select distinct on (batch_id, row_idx) * from answers")
_SENT = "coalesce(kind in ('pdf', 'text'), false)"
_READ_OK = "coalesce(m_read in ('read', 'unavailable', 'none_attached'), false)"
def _classified(prefix: str, needs: tuple[str, ...], source: str, ok: str) -> None:
    """Reconciled rows of `source`, which joins items `i` with answers `a`."""
    part(f"{prefix}classified", needs, f"""
select *, case when not unverified then m_class else 'human_review' end as label
from (select *, contains(flags, 'invoice_unavailable') and deal <> 'none' and m_class <> 'human_review' as unverified,
  case when not ok then 'row_idx set mismatch (anti-conflation)'
   when not coalesce(m_class in ('recurring', 'non_recurring', 'human_review'), false) then concat('model returned invalid/missing classification: ', case when m_class is null then 'None' else concat('''', m_class, '''') end) end as failure
 from (select i.*, a.classification as m_class, a.invoice_read as m_read, a.invoice_date as m_date, a.reasoning as m_reasoning, a.evidence as m_evidence, a.missing_info as m_missing,
   {ok} as ok,
   case when coalesce(trim(a.recognized_deal), '') = '' then 'none' else a.recognized_deal end as deal,
   case when a.basis in ('closegl_rule', 'invoice_content', 'deal_profile', 'row_text_routine', 'none') then a.basis else 'none' end as m_basis
  from {source}) x) y
""")
    part(f"{prefix}classify_records", (f"{prefix}classified",), f"""
select row_idx, acctnum, amount, currency, category, period, entrdate, descrptn, adddesc, invoice_url, 'classify' as phase, failure as error, had_invoice, invoice_accessed, kind, error as invoice_error,
 pages_read, reference, local_path, case when failure is null then 'claude-sonnet-4-6' end as model_version,
 case when failure is null then label else 'human_review' end as classification,
 case when failure is not null or (m_basis = 'deal_profile' and deal = 'none') then 'none' else m_basis end as basis,
 case when failure is null then deal else 'none' end as recognized_deal,
 case when failure is not null then 'none_attached' when {_READ_OK} then m_read when {_SENT} then 'read' else 'none_attached' end as invoice_read,
 case when failure is null and coalesce(trim(m_date), '') <> '' then m_date end as invoice_date,
 case when failure is null then coalesce(m_reasoning, '') else 'Processing error; routed to human review.' end as reasoning,
 case when failure is null then coalesce(m_evidence, '') else 'none' end as evidence,
 case when failure is not null then failure when label = 'human_review' and coalesce(m_missing, '') = '' then 'model omitted missing_info' else m_missing end as missing_info,
 case when failure is null and unverified then m_class end as override_from,
 case when failure is not null then flags else concat_ws(',', nullif(flags, ''),
   case when {_READ_OK} and (({_SENT} and m_read <> 'read') or (not {_SENT} and m_read = 'read')) then 'invoice_read_mismatch' end,
   case when {_SENT} and contains(pages_read, ',') then 'invoice_truncated' end, case when deal <> 'none' then 'deal_profile_match' end,
   case when m_basis = 'deal_profile' and deal = 'none' then 'basis_mismatch' end) end as flags
from {prefix}classified
""")


_classified(
    "", ("classify_items", "one_answer", "verdicts"),
    "classify_items i left join one_answer a using (batch_id, row_idx) left join verdicts v using (batch_id)",
    "v.missing + v.extra + v.repeated = 0",
)
part("sweep_records", ("items", "sweep_failures"), """
select row_idx, acctnum, amount, currency, category, period, entrdate, descrptn, adddesc, invoice_url, 'deal_profile' as phase, cast(null as varchar) as error, had_invoice, invoice_accessed, kind, error as invoice_error,
 pages_read, reference, local_path, case when state = 'ok' then 'claude-sonnet-4-6' end as model_version,
 'non_recurring' as classification, 'ma_account_rule' as basis, 'none' as recognized_deal, 'none_attached' as invoice_read, cast(null as varchar) as invoice_date,
 concat('M&A account (MR58200000) row: non-recurring by rule; ', case state when 'skipped' then 'not swept this run (outside selected sweep quarter(s) 1999Q1, 2001Q2).'
  when 'failed' then concat('row swept for the quarter deal profile. sweep could not gather deal info (see flags). reason: ', reason) else 'row swept for the quarter deal profile.' end) as reasoning,
 'M&A account rule' as evidence, cast(null as varchar) as missing_info, cast(null as varchar) as override_from,
 concat_ws(',', nullif(flags, ''), case state when 'skipped' then 'deal_sweep_skipped' when 'failed' then 'deal_sweep_failed' end) as flags
from (select i.*, f.reason, case when not (period between '199901' and '199903' or period between '200104' and '200106') then 'skipped' when f.reason is not null then 'failed' else 'ok' end as state
 from items i left join sweep_failures f using (row_idx) where acctnum = 'MR58200000') s
""")
part("records", ("settled", "sweep_records", "classify_records", "triaged"), """
select row_idx, acctnum, amount, currency, category, period, entrdate, descrptn, null as adddesc, invoice_url, 'phase0' as phase, cast(null as varchar) as error, had_invoice, 'no' as invoice_accessed, cast(null as varchar) as kind,
 cast(null as varchar) as invoice_error, cast(null as varchar) as pages_read, cast(null as varchar) as reference, cast(null as varchar) as local_path, cast(null as varchar) as model_version, classification, basis, 'none' as recognized_deal, 'none_attached' as invoice_read,
 cast(null as varchar) as invoice_date, cast(null as varchar) as reasoning, cast(null as varchar) as evidence, cast(null as varchar) as missing_info, cast(null as varchar) as override_from, flags from settled
union all select * from sweep_records union all select * from classify_records
""")


def classify_items(ctx):
    items = shared_items(ctx).where(F.col("acctnum") != vocab.MA_ACCOUNT)
    return items.withColumn("batch_id", F.expr("row_idx div 12"))


def answers(ctx):
    asked = classify_items(ctx).select(F.col("row_idx").alias("source_row"))
    return ctx.view("scorer_rows").join(asked, "source_row", "left_semi")


def sweep(ctx):
    ma = scope.split_by_quarters(scope.select_ma(shared_items(ctx)), SWEPT_QUARTERS)
    failures = ctx.view("sweep_failures").where("reason is not null")
    return reconcile.sweep_records(ma, SWEPT_QUARTERS, failures)


def settled(ctx):
    return reconcile.settled_records(triage.settled(prepared(ctx)))


def run_records(ctx):
    """Every record of a run: rule-settled, swept, classified."""
    return settled(ctx).unionByName(sweep(ctx)).unionByName(reconcile.reconcile(classify_items(ctx), answers(ctx)))


def records(ctx):
    return ctx.shared("records", lambda: run_records(ctx))


@query("j9_answer_match", "classify_items", "answers", check="""
select batch_id, row_idx, i.x is not null as expected, coalesce(a.n, 0) as returned
from (select batch_id, row_idx, 1 as x from classify_items) i full join (select batch_id, row_idx, count(*) as n from answers group by all) a using (batch_id, row_idx)""")
def answer_match(ctx):
    return reconcile.match_answers(classify_items(ctx), answers(ctx)).select(
        "batch_id", "row_idx", F.coalesce("expected", F.lit(False)).alias("expected"),
        F.coalesce("returned", F.lit(0)).cast("bigint").alias("returned"),
    )


@query("a15_batch_verdicts", "verdicts",
       check="select *, missing + extra + repeated = 0 as ok from verdicts")
def verdicts(ctx):
    return reconcile.batch_verdicts(classify_items(ctx), answers(ctx))


_SHOWN = ("row_idx", "error", "model_version", "had_invoice", "invoice_accessed", "classification", "basis", "recognized_deal",
          "invoice_read", "invoice_date", "reasoning", "evidence", "missing_info")


@query("c1_reconciled_rows", "classify_records", check=f"select {', '.join(_SHOWN)}, override_from, flags from classify_records")
def reconciled(ctx):
    rows = reconcile.reconcile(classify_items(ctx), answers(ctx))
    return rows.select(*_SHOWN, F.col("override.from").alias("override_from"), F.array_join("flags", ",").alias("flags"))


@query("c2_error_records", "classify_records",
       check="select row_idx, classification, basis, error, missing_info, reasoning, flags from classify_records where error is not null")
def error_records(ctx):
    rows = reconcile.reconcile(classify_items(ctx), answers(ctx)).where("error is not null")
    return rows.select("row_idx", "classification", "basis", "error", "missing_info", "reasoning", F.array_join("flags", ",").alias("flags"))


@query("f12_valid_labels", "answers", check="""
select batch_id, row_idx, coalesce(classification in ('recurring', 'non_recurring', 'human_review'), false) as label_ok,
 case when basis in ('closegl_rule', 'invoice_content', 'deal_profile', 'row_text_routine', 'none') then basis else 'none' end as basis from answers""")
def valid_labels(ctx):
    ok = F.coalesce(F.col("classification").isin(*vocab.SCORER_CLASSIFICATIONS), F.lit(False))
    basis = F.when(F.col("basis").isin(*vocab.SCORER_BASES), F.col("basis")).otherwise("none")
    return answers(ctx).select("batch_id", "row_idx", ok.alias("label_ok"), basis.alias("basis"))


@query("c3_decision_records", "records", check="""
select row_idx, phase, classification, basis, recognized_deal, had_invoice, invoice_accessed, flags, 0 as input_tokens from records""")
def decision_records(ctx):
    nested = reconcile.nest_records(records(ctx))
    return nested.select(
        "row_idx", "phase", "decision.classification", "decision.basis", "decision.recognized_deal", "had_invoice",
        "invoice_accessed", F.array_join("flags", ",").alias("flags"), "usage.input_tokens",
    )


@query("c6_sweep_records", "sweep_records",
       check="select row_idx, classification, basis, reasoning, evidence, model_version, flags from sweep_records")
def sweep_rows(ctx):
    return sweep(ctx).select(
        "row_idx", "classification", "basis", "reasoning", "evidence", "model_version", F.array_join("flags", ",").alias("flags")
    )


@query("p40_sweep_text", "sweep_records", check="select reasoning, count(*) as n from sweep_records group by reasoning")
def sweep_text(ctx):
    return sweep(ctx).groupBy("reasoning").agg(F.count(F.lit(1)).alias("n"))


@query("u1_all_records", "records", check="select row_idx, phase, classification from records")
def all_records(ctx):
    return records(ctx).select("row_idx", "phase", "classification")


def _stub(frame: pd.DataFrame) -> pd.DataFrame:
    """Label by amount rank inside the batch: what a scorer that sees whole batches can do."""
    top = frame["amount"] == frame["amount"].max()
    return pd.DataFrame({
        "batch_id": frame["batch_id"], "row_idx": frame["row_idx"],
        "classification": top.map({True: "human_review", False: "recurring"}),
    })


@query("hook_score_batches", "ledger", check="""
select row_idx // 12 as batch_id, row_idx, case when amount = max(amount) over (partition by row_idx // 12) then 'human_review' else 'recurring' end as classification
from ledger""")
def score_hook(ctx):
    rows = ctx.view("ledger").select("row_idx", "amount", F.expr("row_idx div 12").alias("batch_id"))
    return reconcile.score_batches(rows, _stub, "batch_id long, row_idx long, classification string")
