"""Work items: URL and local documents joined to scorer-bound rows, and the preparation counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import vocab  # noqa: F401
from ...operators import resolution, triage
from ..registry import part, query
from . import invoices, scalars  # noqa: F401

_SUBSTANTIVE = "coalesce(length(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 4, false)"

part("file_docs", ("resolved", "matched_files", "files"), """
select key, entityid, status, r.stem, coalesce(f.kind, 'error') as kind, coalesce(f.error, case when r.stem is null then concat('local_resolution_', status) end) as error,
 f.sha256, f.text, f.page_count, coalesce(r.stem, key) as path,
 case when a is not null and b is not null and greatest(1, a) <= page_count and greatest(1, a) <= least(b, page_count) then greatest(1, a) else 1 end as lo,
 case when a is not null and b is not null and greatest(1, a) <= page_count and greatest(1, a) <= least(b, page_count) then least(b, page_count) else page_count end as hi
from (select r.*, try_cast(trim(split_part(m.pages, '-', 1)) as int) as a, try_cast(trim(split_part(m.pages, '-', 2)) as int) as b
      from resolved r left join matched_files m on m.stem = r.stem) r left join files f on f.stem = r.stem
""")
part("items", ("triaged", "file_docs", "bodies"), f"""
select *, case when had_invoice = 'yes' and kind in ('pdf', 'text') then 'yes' else 'no' end as invoice_accessed,
 concat_ws(',', case when amount_was_blank then 'amount_blank' end, case when had_invoice = 'yes' then 'had_invoice' end,
  case when had_invoice = 'yes' and kind in ('pdf', 'text') then 'invoice_accessed' end, case when had_invoice = 'yes' and kind = 'error' then 'invoice_unavailable' end) as flags,
 {scalars.ROW_TOKENS} + coalesce(doc_tokens, 0) as est_input_tokens, coalesce(kind = 'pdf', false) as is_vision
from (
 select t.*, case when coalesce(invoice_url, '') <> '' then 'url' when t.key is not null then 'key' else 'none' end as reference,
  case when coalesce(invoice_url, '') <> '' or t.key is not null then 'yes' else 'no' end as had_invoice,
  case when coalesce(invoice_url, '') <> '' then case when {_SUBSTANTIVE.format('invoice_url')} then coalesce(b.kind, 'error') else 'error' end
   when t.key is not null then d.kind end as kind,
  case when coalesce(invoice_url, '') <> '' then case when {_SUBSTANTIVE.format('invoice_url')} then case when b.url is null then 'fetch_failed: no response body' else b.error end else 'reference_too_short' end
   when t.key is not null then d.error end as error,
  case when coalesce(invoice_url, '') <> '' then case when b.kind in ('pdf', 'text') then b.sha256 end when t.key is not null and d.kind = 'pdf' then d.sha256 end as doc_sha,
  case when coalesce(invoice_url, '') <> '' then b.pages_read
   when t.key is not null and d.kind = 'pdf' then case when hi - lo + 1 <= 20 then concat(cast(lo as varchar), '-', cast(hi as varchar))
    else concat(cast(lo as varchar), '-', cast(lo + 1 as varchar), ',', cast(hi - 1 as varchar), '-', cast(hi as varchar)) end end as pages_read,
  case when coalesce(invoice_url, '') <> '' then length(b.text) // 4 when d.kind = 'pdf' then length(d.text) // 4 end as text_tokens,
  case when coalesce(invoice_url, '') <> '' then case when b.kind = 'pdf' then case when b.page_count <= 20 then b.page_count else 4 end else 0 end
   when d.kind = 'pdf' then case when hi - lo + 1 <= 20 then hi - lo + 1 else 4 end end as doc_pages,
  case when coalesce(invoice_url, '') <> '' then case when b.kind in ('pdf', 'text') then b.est_input_tokens else 0 end
   when d.kind = 'pdf' then case when hi - lo + 1 <= 20 then hi - lo + 1 else 4 end * 5300 + length(d.text) // 4 else 0 end as doc_tokens,
  case when coalesce(invoice_url, '') = '' then d.status end as status, case when coalesce(invoice_url, '') = '' then d.path end as local_path
 from triaged t left join bodies b on b.url = t.invoice_url
 left join file_docs d on coalesce(t.invoice_url, '') = '' and d.key = t.key and d.entityid = trim(coalesce(t.entityid, ''))
 where t.rule = 'scorer') i
""")


def prepared(ctx):
    """Triaged rows, written once: keys are mined from their texts, and several steps start from them."""
    return ctx.shared("prepared", lambda: triage.prepared(ctx.view("ledger")))


def items(ctx, fetch_urls: bool = True):
    rows = triage.scorer_bound(prepared(ctx))
    return resolution.work_items(
        rows, ctx.view("fetched_bodies"), ctx.view("invoice_files"), ctx.view("invoice_lookup"), fetch_urls
    )


def shared_items(ctx):
    return ctx.shared("items", lambda: items(ctx))


@query("j8_url_documents", "triaged", "bodies", check=f"""
select t.row_idx, b.kind, b.error from triaged t left join bodies b on b.url = t.invoice_url
where rule = 'scorer' and {_SUBSTANTIVE.format('invoice_url')}""")
def url_documents(ctx):
    rows = triage.scorer_bound(prepared(ctx))
    docs = resolution.fetched_documents(rows, ctx.view("fetched_bodies"))
    from ...functions.mining import is_substantive_reference
    from ...operators.joins import lookup_join

    wanted = rows.where(is_substantive_reference(F.col("invoice_url"))).select("row_idx", "invoice_url")
    return lookup_join(wanted, docs, ["invoice_url"], "row_idx").select("row_idx", "url_doc.kind", "url_doc.error")


@query("c4_work_items", "items", check=f"""
select row_idx, reference, had_invoice, invoice_accessed, flags, kind, error, pages_read, est_input_tokens, is_vision,
 {scalars.fingerprint_sql('doc_sha')} as row_hash from items""")
def work_items(ctx):
    return items(ctx).select(
        "row_idx", "reference", "had_invoice", "invoice_accessed", F.array_join("flags", ",").alias("flags"),
        "invoice.kind", "invoice.error", "invoice.pages_read", "est_input_tokens", "is_vision", "row_hash",
    )


@query("c4_work_items_unfetched", "items", "triaged", check=f"""
select row_idx, had_invoice, case when reference = 'url' then 'no' else invoice_accessed end as invoice_accessed,
 case when reference = 'url' then {scalars.ROW_TOKENS} + 9000 else est_input_tokens end as est_input_tokens from items""")
def work_items_unfetched(ctx):
    return items(ctx, fetch_urls=False).select("row_idx", "had_invoice", "invoice_accessed", "est_input_tokens")


@query("c5_short_references", "items",
       check="select row_idx, error, flags from items where error = 'reference_too_short'")
def short_references(ctx):
    return shared_items(ctx).where("invoice.error = 'reference_too_short'").select(
        "row_idx", "invoice.error", F.array_join("flags", ",").alias("flags")
    )


@query("a4_preparation_counts", "triaged", "items", check=f"""
select count(*) filter (rule = 'reclass') as reclass_fired, count(*) filter (rule = 'close') as closegl_fired,
 count(*) filter (rule = 'close_guard') as closegl_guard_trips, count(*) filter (rule = 'negative') as negatives_skipped,
 count(*) filter (rule = 'scorer') as to_classify, count(*) filter (referenced) as had_invoice_yes,
 (select count(*) from items where invoice_accessed = 'yes') as invoice_accessed_yes,
 (select count(*) from items where had_invoice = 'yes' and invoice_accessed = 'no') as invoice_unavailable,
 (select count(*) from items where had_invoice = 'yes' and invoice_accessed = 'no' and {_SUBSTANTIVE.format("coalesce(nullif(invoice_url, ''), key)")}) as invoice_read_failed,
 (select count(*) from items where reference = 'url' and invoice_accessed = 'yes') as url_fetched_ok,
 (select count(*) from items where reference = 'url' and invoice_accessed = 'no') as url_fetch_failed,
 (select count(*) from items where status = 'resolved') as local_resolved,
 (select count(*) from items where status = 'no_match') as local_no_match,
 (select count(*) from items where status = 'ambiguous') as ambiguous, 0 as errors
from triaged""")
def preparation_counts(ctx):
    return resolution.preparation_counts(triage.settled(prepared(ctx)), shared_items(ctx))


@query("a23_lookup_rate", "items", check="""
select count(*) filter (status = 'resolved') as resolved, count(*) filter (status is not null) as attempted,
 concat('Local invoices: ', cast(count(*) filter (status = 'resolved') as varchar), ' of ', cast(count(*) filter (status is not null) as varchar), ' resolved') as banner
from items""")
def lookup_rate(ctx):
    return resolution.lookup_rate(resolution.preparation_counts(triage.settled(prepared(ctx)), shared_items(ctx)))
