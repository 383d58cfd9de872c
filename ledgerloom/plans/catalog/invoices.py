"""Invoice lookup: index, exact, prefix and fallback matches, tie-break."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import invoices, triage
from ..registry import part, query
from . import common  # noqa: F401

_NORM = "regexp_replace(regexp_replace(upper({0}), '^INV[\\s#\\-.:]*', ''), '[^A-Z0-9]', '', 'g')"

part("lookup_index", ("invoice_lookup",), f"""
select {_NORM.format('invoice_key')} as index_key, csv_row, gnl_ref, nullif(pages, '') as pages, gl_entityids from invoice_lookup
union all
select {_NORM.format('vendor_invoice_no')}, csv_row, gnl_ref, nullif(pages, ''), gl_entityids from invoice_lookup
where {_NORM.format('vendor_invoice_no')} <> {_NORM.format('invoice_key')}
""")
part("matched_files", ("invoice_files", "lookup_index"), """
select f.stem, l.pages, l.gl_entityids
from (select stem, split_part(stem, '__', 1) as true_key, case when contains(stem, '__') then split_part(stem, '__', 2) end as ref from invoice_files) f
left join (select *, count(*) over (partition by index_key) as n, row_number() over (partition by index_key, gnl_ref order by csv_row) as rn from lookup_index) l
 on l.index_key = f.true_key and (l.n = 1 or (l.gnl_ref = f.ref and l.rn = 1))
""")
part("key_pairs", ("mined",), "select distinct key, trim(coalesce(entityid, '')) as entityid from mined where key is not null")
part("candidates", ("key_pairs", "matched_files"), """
select k.key, k.entityid, m.stem, m.pages, list_contains(list_transform(regexp_split_to_array(m.gl_entityids, '[;,]'), lambda x: trim(x)), k.entityid) as listed
from (select distinct key, entityid from key_pairs) k join matched_files m on starts_with(m.stem, k.key)
""")
part("resolved", ("candidates", "key_pairs", "matched_files"), f"""
select k.key, k.entityid,
 case when e.stem is not null or coalesce(p.n, 0) = 1 or p.n_listed = 1 or (p.n is null and x.n = 1) then 'resolved'
  when p.n > 1 or x.n > 1 then 'ambiguous' else 'no_match' end as status,
 case when e.stem is not null then e.stem when p.n = 1 then p.stem when p.n > 1 then case when p.n_listed = 1 then p.listed_stem end when x.n = 1 then x.stem end as stem
from key_pairs k
left join matched_files e on e.stem = k.key
left join (select key, entityid, count(*) as n, min(stem) as stem, count(*) filter (listed) as n_listed, min(stem) filter (listed) as listed_stem
  from candidates group by all) p on p.key = k.key and p.entityid = k.entityid
left join (select {_NORM.format('stem')} as file_key, count(*) as n, min(stem) as stem from matched_files group by all) x on x.file_key = k.key
""")


def matched(ctx):
    return invoices.match_lookup_rows(ctx.view("invoice_files"), invoices.lookup_index(ctx.view("invoice_lookup")))


@query("s11_lookup_index", "lookup_index", check="select index_key, csv_row, gnl_ref, pages, gl_entityids from lookup_index")
def lookup_index(ctx):
    return invoices.lookup_index(ctx.view("invoice_lookup"))


@query("s12_file_index", "invoice_files",
       check=f"select {_NORM.format('stem')} as file_key, stem from invoice_files where {_NORM.format('stem')} <> ''")
def file_index(ctx):
    return invoices.file_index(ctx.view("invoice_files"))


def _keys(ctx):
    return ctx.shared("mined-keys", lambda: triage.with_mined_key(ctx.view("ledger")).where("key is not null").select("key", "entityid").distinct())


def _files(ctx):
    return ctx.shared("numbered-files", lambda: invoices.numbered_files(ctx.view("invoice_files"), ctx.view("invoice_lookup")))


def _answers(ctx):
    keys = _keys(ctx).select("key").distinct()
    return keys.join(invoices.file_answers(_files(ctx), invoices.key_lengths(keys)), "key")


def _with_stem(ctx, rows, number: str):
    """The stem of the file a key has to itself."""
    return rows.join(_files(ctx).select(F.col("file_no").alias(number), "stem", "pages"), number, "left")


@query("j2_exact_stem", "key_pairs", "matched_files", check="""
select distinct key, stem, pages from key_pairs join matched_files on stem = key""")
def exact(ctx):
    return _with_stem(ctx, _answers(ctx).where("exact_no is not null"), "exact_no").select("key", "stem", "pages")


@query("j3_prefix_stems", "candidates", "matched_files", check="""
select key, count(distinct stem) as n, case when count(distinct stem) = 1 then min(stem) end as stem from candidates
where key not in (select stem from matched_files) group by key""")
def prefix(ctx):
    found = _answers(ctx).where("exact_no is null and n_prefix > 0").withColumn("only_no", F.expr("if(n_prefix = 1, prefix_no, null)"))
    return _with_stem(ctx, found, "only_no").select("key", F.col("n_prefix").alias("n"), "stem")


@query("j4_normalised_stem", "key_pairs", "candidates", "matched_files", check=f"""
select key, count(*) as n, case when count(*) = 1 then min(stem) end as stem
from (select distinct key from key_pairs where key not in (select key from candidates)) k join matched_files on {_NORM.format('stem')} = key group by key""")
def fallback(ctx):
    found = _answers(ctx).where("n_prefix = 0 and n_norm > 0").withColumn("only_no", F.expr("if(n_norm = 1, norm_no, null)"))
    return _with_stem(ctx, found, "only_no").select("key", F.col("n_norm").alias("n"), "stem")


@query("j5_lookup_row", "matched_files", check="select stem, pages, gl_entityids from matched_files")
def lookup_row(ctx):
    return matched(ctx)


@query("j6_entity_tie_break", "candidates", check="""
select key, entityid, count(*) as n, case when count(*) = 1 then min(stem) end as stem from candidates where listed group by all""")
def tie_break(ctx):
    pairs = _keys(ctx)
    listed = pairs.join(invoices.entity_answers(_files(ctx), invoices.key_lengths(pairs)), ["key", "entityid"])
    found = listed.withColumn("only_no", F.expr("if(n_entity = 1, entity_no, null)"))
    return _with_stem(ctx, found, "only_no").select("key", "entityid", F.col("n_entity").alias("n"), "stem")


@query("j7_resolution", "mined", "resolved", "matched_files", check="""
select m.row_idx, m.key, coalesce(r.status, 'no_match') as status, r.stem, f.pages as hint
from mined m left join resolved r on r.key = m.key and r.entityid = trim(coalesce(m.entityid, ''))
left join matched_files f on f.stem = r.stem""")
def resolution(ctx):
    rows = triage.with_mined_key(ctx.view("ledger")).select("row_idx", "key", "entityid")
    return invoices.resolve_rows(rows, ctx.view("invoice_files"), ctx.view("invoice_lookup")).select(
        "row_idx", "key", "status", "stem", "hint"
    )
