"""Deal vocabulary: validity, merge, derivation, index, recognition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import deals, scope
from ..registry import part, query
from .resolution import shared_items

_LISTS = deals.LIST_FIELDS
part("valid_mentions", ("deal_mentions",), """
select *, lower(trim(name)) as deal_key, trim(name) as clean_name from deal_mentions where evidence_ref is not null and trim(name) <> ''
""")
part("mention_values", ("valid_mentions",), " union all ".join(
    f"select deal_key, ord, '{f}' as field, trim(v) as value, place from (select deal_key, ord, unnest({f}) as v, generate_subscripts({f}, 1) as place from valid_mentions) x where trim(v) <> ''"
    for f in _LISTS))
part("deal_terms", ("mention_values",), """
select deal_key, field, value, min(ord) as first_ord, min(ord * 10 + place) as first_place from mention_values group by all
""")
part("support", ("valid_mentions", "ledger"), """
select distinct deal_key, v as row_idx from (select deal_key, batch_id, try_cast(unnest(supporting_row_idxs) as bigint) as v from valid_mentions) s
join (select row_idx, row_idx // 20 as batch_id from ledger where acctnum = 'MR58200000') b on b.row_idx = s.v and b.batch_id = s.batch_id
""")
part("entries", ("valid_mentions", "deal_terms", "support", "ledger"), """
select deal_key, (select arg_min(clean_name, ord) from valid_mentions m where m.deal_key = d.deal_key) as name, """
     + ", ".join(f"""
 coalesce((select list(value order by first_place) from deal_terms t where t.deal_key = d.deal_key and field = '{f}'), []) as {f}""" for f in _LISTS)
     + """,
 (select count(*) from support s where s.deal_key = d.deal_key) as supporting_rows,
 coalesce((select list_sort(list(distinct concat(left(period, 4), 'Q', cast((cast(right(period, 2) as int) + 2) // 3 as varchar)))) from support s join ledger l using (row_idx) where s.deal_key = d.deal_key), []) as quarters
from (select distinct deal_key from valid_mentions) d
""")
_LINE = (
    "concat('- ', name" + "".join(
        f", case when len({f}) > 0 then concat(' | {label}: ', array_to_string({f}, ', ')) else '' end" for label, f in deals.INDEX_FIELDS) + ")"
)
_ORDER = "order by coalesce(quarters[-1], '') desc, supporting_rows desc, name, deal_key"


def mentions(ctx):
    quote = F.struct(F.col("evidence_ref").alias("ref"), F.col("evidence_quote").alias("quote"))
    return ctx.view("deal_mentions").withColumn("evidence", F.when(F.col("evidence_ref").isNotNull(), F.array(quote)))


def batch_rows(ctx):
    return scope.select_ma(ctx.view("ledger")).select("row_idx", F.expr("row_idx div 20").alias("batch_id"))


def entries(ctx):
    return deals.deal_entries(mentions(ctx), batch_rows(ctx), ctx.view("ledger"))


@query("f13_valid_mentions", "valid_mentions", check="select ord, deal_key, clean_name as name from valid_mentions")
def valid(ctx):
    return deals.valid_mentions(mentions(ctx)).select("ord", "deal_key", "name")


@query("p39_list_coercion", "valid_mentions", check="""
select ord, array_to_string(list_filter(list_transform(aliases, lambda v: trim(v)), lambda v: v <> ''), '|') as aliases,
 coalesce(array_to_string(list_filter(list_transform(invoice_numbers, lambda v: trim(v)), lambda v: v <> ''), '|'), '') as invoice_numbers from valid_mentions""")
def coercion(ctx):
    return deals.valid_mentions(mentions(ctx)).select(
        "ord", F.array_join("aliases", "|").alias("aliases"), F.array_join("invoice_numbers", "|").alias("invoice_numbers")
    )


@query("a17_merged_terms", "deal_terms", check="select deal_key, field, value, first_ord from deal_terms")
def merged_terms(ctx):
    return deals.deal_terms(deals.valid_mentions(mentions(ctx))).select("deal_key", "field", "value", F.col("ord").alias("first_ord"))


@query("a17_merged_evidence", "valid_mentions", check="""
select deal_key, evidence_ref as ref, evidence_quote as quote, min(ord) as first_ord from valid_mentions group by all""")
def merged_evidence(ctx):
    return deals.deal_evidence(deals.valid_mentions(mentions(ctx))).select("deal_key", "ref", "quote", F.col("ord").alias("first_ord"))


@query("a17_deal_names", "valid_mentions", check="select deal_key, arg_min(clean_name, ord) as name from valid_mentions group by 1")
def names(ctx):
    return deals.deal_names(deals.valid_mentions(mentions(ctx)))


@query("u5_ordered_union", "entries", check="select deal_key, array_to_string(aliases, '|') as aliases, array_to_string(advisors_seen, '|') as advisors from entries")
def ordered_union(ctx):
    return entries(ctx).select("deal_key", F.array_join("aliases", "|").alias("aliases"), F.array_join("advisors_seen", "|").alias("advisors"))


@query("a18_deal_entries", "entries", check="""
select deal_key, name, supporting_rows, array_to_string(quarters, ',') as quarters, array_to_string(entityids, ',') as entityids from entries""")
def deal_entries(ctx):
    return entries(ctx).select(
        "deal_key", "name", "supporting_rows", F.array_join("quarters", ",").alias("quarters"), F.array_join("entityids", ",").alias("entityids")
    )


@query("a18_deal_support", "support", check="select deal_key, row_idx from support")
def support(ctx):
    return deals.deal_support(deals.valid_mentions(mentions(ctx)), batch_rows(ctx))


@query("j12_deal_quarters", "support", "ledger", check="""
select deal_key, concat(left(period, 4), 'Q', cast((cast(right(period, 2) as int) + 2) // 3 as varchar)) as quarter, count(*) as n from support join ledger using (row_idx) group by 1, 2""")
def deal_quarters(ctx):
    return deals.deal_quarters(deals.deal_support(deals.valid_mentions(mentions(ctx)), batch_rows(ctx)), ctx.view("ledger"))


@query("a19_period_range", "ledger", check="""
select concat(least(min(period), '199412'), '-', greatest(max(period), '199903')) as period_range from ledger where acctnum = 'MR58200000'""")
def period_range(ctx):
    return deals.period_range(scope.select_ma(ctx.view("ledger")), "199412-199903")


part("sweep_items", ("items", "sweep_failures"), """
select i.row_idx, i.row_idx // 20 as batch_id, invoice_accessed, f.reason is not null as failed from items i left join sweep_failures f using (row_idx) where acctnum = 'MR58200000'
""")


@query("a20_sweep_stats", "sweep_items", "valid_mentions", check="""
select sum(n)::bigint as rows_selected, sum(n - bad)::bigint as rows_ok, sum(bad)::bigint as rows_failed, sum(read)::bigint as invoices_read, count(*) as batches_total,
 count(*) filter (n = bad) as batches_failed, (select count(distinct deal_key) from valid_mentions) as entries
from (select batch_id, count(*) as n, count(*) filter (failed) as bad, count(*) filter (invoice_accessed = 'yes') as read from sweep_items group by 1) b""")
def sweep_stats(ctx):
    items = scope.select_ma(shared_items(ctx)).withColumn("batch_id", F.expr("row_idx div 20"))
    return deals.sweep_stats(items, ctx.view("sweep_failures").where("reason is not null"), mentions(ctx))


@query("p21_index_line", "entries", check=f"select deal_key, {_LINE} as line from entries")
def index_line(ctx):
    return entries(ctx).select("deal_key", deals.index_line().alias("line"))


@query("o2_deal_order", "entries", check=f"select deal_key, row_number() over ({_ORDER}) - 1 as line_no from entries")
def deal_order(ctx):
    return deals.ordered_deals(entries(ctx)).select("deal_key", "line_no")


@query("k6_index_lines", "entries", check=f"""
select 0 as line_no, 'KNOWN DEALS — identifiers to recognize in a row''s own text or invoice:' as line
union all select row_number() over ({_ORDER}), {_LINE} from entries""")
def index_lines(ctx):
    return deals.index_lines(entries(ctx))


@query("a25_index_report", "entries", check=f"""
select count(*) as entries_total, count(*) as entries_full,
 (sum(length({_LINE}) + 1) + length('KNOWN DEALS — identifiers to recognize in a row''s own text or invoice:'))::bigint // 4 as est_tokens from entries""")
def index_report(ctx):
    return deals.index_report(entries(ctx))


@query("k4_profile_table", "entries", "valid_mentions", check="""
select name, supporting_rows, array_to_string(matter_numbers, '; ') as matter_numbers, array_to_string(invoice_numbers, '; ') as invoice_numbers, array_to_string(quarters, '; ') as quarters,
 array_to_string(aliases, '; ') as aliases, array_to_string(properties, '; ') as properties, array_to_string(entityids, '; ') as entityids, array_to_string(advisors_seen, '; ') as advisors_seen,
 text as evidence
from entries join (select deal_key, string_agg(concat(ref, ': ', quote), chr(10) order by first_ord) as text from (
 select deal_key, evidence_ref as ref, evidence_quote as quote, min(ord) as first_ord from valid_mentions group by all) e group by deal_key) t using (deal_key)""")
def profile_table(ctx):
    return deals.profile_table(entries(ctx), deals.deal_evidence(deals.valid_mentions(mentions(ctx))))


@query("j13_known_deals_in_text", "deal_terms", "valid_mentions", "ledger", check="""
select row_idx, arg_min(deal_key, (-length(phrase), deal_key)) as deal_key, count(*) as n_phrases from (
 select l.row_idx, d.phrase, d.deal_key from (
  select row_idx, concat(' ', trim(regexp_replace(lower(concat_ws(' ', descrptn, adddesc)), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') as t from ledger) l
 join (select phrase, min(deal_key) as deal_key from (
   select deal_key, trim(regexp_replace(lower(value), '[^\\p{L}\\p{N}]+', ' ', 'g')) as phrase from (
    select deal_key, value from deal_terms where field in ('aliases', 'matter_numbers', 'invoice_numbers', 'properties')
    union all select deal_key, arg_min(clean_name, ord) from valid_mentions group by 1) v) p where phrase <> '' group by 1) d
 on contains(l.t, concat(' ', d.phrase, ' '))) h group by row_idx""")
def known_deals(ctx):
    valid_rows = deals.valid_mentions(mentions(ctx))
    dictionary = deals.deal_dictionary(deals.deal_names(valid_rows), deals.deal_terms(valid_rows))
    return deals.match_deals(ctx.view("ledger"), dictionary)


