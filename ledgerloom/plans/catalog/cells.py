"""Cell grids: sheets, columns, typed ledgers, account tabs, flat export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import vocab
from ...sources import cells
from ..registry import part, query

PREFERRED = "g&a records"
_CLEAN_TEXT = "case when upper(trim(replace({0}, '#NAME?', ''))) not in ('', 'NULL', '#NAME?') then trim(replace({0}, '#NAME?', '')) end"


def _resolved_sql(source: str) -> str:
    """Column resolution as SQL: headers against the alias list."""
    aliases = ", ".join(f"('{f}', '{a}', {i}, {at})" for f, (names, at) in vocab.LEDGER_COLUMNS.items() for i, a in enumerate(names))
    return f"""
select s.file, s.sheet, f.field, coalesce(m.col_no, f.pos) as col_no, m.col_no is null as fallback
from (select distinct file, sheet from {source} where row_no = 1) s
cross join (select distinct field, pos from (values {aliases}) v(field, alias, prio, pos)) f
left join (select file, sheet, field, arg_min(col_no, (prio, col_no)) as col_no from {source} join (values {aliases}) v(field, alias, prio, pos)
  on row_no = 1 and contains(lower(trim(value)), alias) group by all) m on m.file = s.file and m.sheet = s.sheet and m.field = f.field"""


part("resolved_columns", ("ledger_cells",), _resolved_sql("ledger_cells"))
part("chosen_sheet", ("resolved_columns", "ledger_cells"), f"""
select file, arg_min(sheet, (missing, case when lower(sheet) = '{PREFERRED}' then 0 else 1 end, sheet_no)) as sheet, min(missing) as missing from (
 select c.file, c.sheet, min(sheet_no) as sheet_no, coalesce((select count(*) filter (fallback) from resolved_columns r where r.sheet = c.sheet having count(*) > 0), 14) as missing from ledger_cells c group by all) t group by file
""")
part("tab_headers", ("account_cells",), """
select sheet, coalesce(min(row_no) filter (hit), 6) as header_row, min(row_no) filter (hit) is null as fallback from (
 select sheet, row_no, bool_or(contains(lower(value), 'period')) and bool_or(contains(lower(value), 'counterparty')) and bool_or(contains(lower(value), 'amount')) as hit
 from account_cells where row_no <= 12 group by all
 union all select distinct sheet, 1, false from account_cells) h group by sheet
""")
part("tab_rows", ("ledger", "tab_headers"), """
select concat('Tab ', acctnum) as sheet, row_idx + 10 as row_no, row_idx % 20 <> 3 and acctnum <> 'MR70000003' as has_period, l.*,
 case when acctnum = 'MR70000001' then concat('Tab ', acctnum) else concat('Account ', acctnum) end as account_name
from ledger l where acctnum <> 'MR58200000'
""")


def grid(ctx, name: str):
    """A cell grid as the table a workbook decoder leaves, so that header filters reach the files."""
    return ctx.shared(name, lambda: ctx.view(name))


@query("s3_resolve_columns", "resolved_columns", check="select sheet, field, col_no, fallback from resolved_columns")
def resolve(ctx):
    return cells.resolve_columns(cells.first_row(grid(ctx, "ledger_cells"))).select("sheet", "field", "col_no", "fallback")


@query("j1_header_aliases", "resolved_columns", check="select sheet, field, col_no from resolved_columns where not fallback")
def header_aliases(ctx):
    spec = {f: names for f, (names, _) in vocab.LEDGER_COLUMNS.items()}
    found = cells.field_columns(cells.first_row(grid(ctx, "ledger_cells")), spec)
    return found.where("col_no is not null").select("sheet", "field", "col_no")


@query("s2_choose_sheet", "chosen_sheet", check="select file, sheet, missing from chosen_sheet")
def choose_sheet(ctx):
    return cells.choose_sheets(grid(ctx, "ledger_cells"), PREFERRED)


@query("a5_column_warnings", "resolved_columns", "ledger_cells", check="""
select sheet, 'unresolved' as kind, field as fields, col_no from resolved_columns where fallback
union all select sheet, 'shared', string_agg(field, ',' order by field), col_no from resolved_columns group by sheet, col_no having count(*) > 1
union all select r.sheet, 'amount', 'amount', r.col_no from resolved_columns r left join ledger_cells c on c.sheet = r.sheet and c.row_no = 1 and c.col_no = r.col_no
 where field = 'amount' and coalesce(lower(trim(c.value)), '') <> 'usd amount'""")
def warnings(ctx):
    return cells.column_warnings(cells.first_row(grid(ctx, "ledger_cells"))).drop("file")


@query("s5_rows_from_cells", "ledger_cells", check="""
select sheet, row_no, max(value) filter (col_no = 1) as c1, max(value) filter (col_no = 8) as c8, max(vtype) filter (col_no = 20) as t20 from ledger_cells group by all""")
def rows(ctx):
    at = lambda n: F.try_element_at("cells", F.lit(n))
    return cells.rows_from_cells(grid(ctx, "ledger_cells")).select(
        "sheet", "row_no", at(1)["value"].alias("c1"), at(8)["value"].alias("c8"), at(20)["vtype"].alias("t20")
    )


@query("s1_typed_ledger", "ledger", check="""
select row_idx, period, acctnum, ref, entityid, department, category, amount, amount_was_blank, currency, descrptn, adddesc, source,
 case when row_idx % 4 = 0 then cast(date '1899-12-30' + cast(36000 + row_idx % 100 as int) as varchar) else entrdate end as entrdate, trim(userid) as userid, invoice_url
from ledger where row_idx % 50 <> 7""")
def typed_ledger(ctx):
    return cells.read_ledger(grid(ctx, "ledger_cells"), PREFERRED).drop("file")


@query("f11_blank_rows", "ledger", check="""
select 'ledger.xlsx' as file, max(row_idx) filter (row_idx % 50 <> 7) - 1 - count(*) filter (row_idx % 50 <> 7) as skipped_blank_rows from ledger""")
def blank_rows(ctx):
    return cells.blank_rows(grid(ctx, "ledger_cells"), PREFERRED)


@query("s4_raw_rows", "ledger", check="""
select row_idx as row_no, case when row_idx % 50 <> 7 then concat(period, '.0') end as "PERIOD", case when row_idx % 50 <> 7 then concat(' ', entityid) end as "ENTITYID",
 case when row_idx % 50 <> 7 then descrptn end as "DESCRPN" from ledger where row_idx <= (select max(row_idx) from ledger where row_idx % 50 <> 7)""")
def raw_rows(ctx):
    # The sheet's headers stop before column 9, which has no header.
    return cells.raw_rows(grid(ctx, "ledger_cells"), "ledger.xlsx", "G&A Records").select("row_no", "PERIOD", "ENTITYID", "DESCRPN")


@query("s15_validation", "ledger", check="""
select 'ledger.xlsx' as file, true as format_ok, true as structure_ok, true as records_ok, count(*) as row_count, false as carries_results from ledger where row_idx % 50 <> 7""")
def validation(ctx):
    return cells.validate(grid(ctx, "ledger_cells"), PREFERRED)


@query("s6_header_rows", "tab_headers", check="select sheet, header_row, fallback from tab_headers")
def header_rows(ctx):
    return cells.header_rows(grid(ctx, "account_cells")).drop("file")


@query("s7_tab_columns", "account_cells", "tab_headers", check="""
select sheet, field, arg_min(col_no, (prio, col_no)) as col_no from (select c.sheet, c.col_no, c.value from account_cells c join tab_headers h on h.sheet = c.sheet and h.header_row = c.row_no) c
join (values """ + ", ".join(f"('{f}', '{a}', {i})" for f, names in vocab.TAB_COLUMNS.items() for i, a in enumerate(names)) + """) v(field, alias, prio)
 on contains(lower(trim(value)), alias) group by sheet, field""")
def tab_columns(ctx):
    return cells.tab_columns(grid(ctx, "account_cells")).drop("file")


_TAB_OUT = """
select period as "PERIOD", acctnum as "ACCTNUM", cast(cast(amount as decimal(18,2)) as varchar) as "USD Amount", coalesce(descrptn, '') as "DESCRPN", entrdate as "ENTRDATE", 'USD' as "OCURRCODE",
 coalesce(adddesc, '') as "ADDLDESC", userid as "USERID", account_name as "Category", coalesce(invoice_url, '') as "Image URL - Hyperlink", '1' as "Exchange Rate", account_name as "Source Tab"
from tab_rows where has_period"""
_SHOWN = ("PERIOD", "ACCTNUM", "USD Amount", "DESCRPN", "ENTRDATE", "OCURRCODE", "ADDLDESC", "USERID", "Category", "Image URL - Hyperlink", "Exchange Rate", "Source Tab")
_AT_OUT = """
select concat(period, '.0') as "PERIOD", case when row_idx % 3 = 0 then '58200000.0' else acctnum end as "ACCTNUM",
 case when amount_was_blank then '' when amount < 0 then concat('(', cast(cast(-amount as decimal(18,2)) as varchar), ')') else cast(cast(amount as decimal(18,2)) as varchar) end as "USD Amount",
 coalesce(descrptn, '') as "DESCRPN", case when row_idx % 4 = 0 then cast(36000 + row_idx % 100 as varchar) when row_idx % 4 = 1 then concat(entrdate, 'T00:00:00') else entrdate end as "ENTRDATE",
 case when currency = 'UNKNOWN' then '' else lower(currency) end as "OCURRCODE", coalesce(adddesc, '') as "ADDLDESC", userid as "USERID", coalesce(category, '') as "Category",
 coalesce(invoice_url, '') as "Image URL - Hyperlink", '1' as "Exchange Rate", 'A&T' as "Source Tab" from ledger where acctnum = 'MR58200000'"""


@query("s8_account_tabs", "tab_rows", check=_TAB_OUT)
def account_tabs(ctx):
    return cells.extract_tabs(grid(ctx, "account_cells")).select(*[F.col(f"`{c}`") for c in _SHOWN])


@query("s9_flat_sheet", "ledger", check=_AT_OUT)
def flat_sheet(ctx):
    return cells.extract_flat(grid(ctx, "at_cells")).select(*[F.col(f"`{c}`") for c in _SHOWN])


@query("s10_flatten", "tab_rows", "ledger", check=f"{_TAB_OUT} union all {_AT_OUT}")
def flatten(ctx):
    return cells.flatten(grid(ctx, "account_cells"), grid(ctx, "at_cells")).select(*[F.col(f"`{c}`") for c in _SHOWN])


@query("k7_flat_export", "tab_rows", "ledger", check="""
select "Source Tab", count(*) as n from (select account_name as "Source Tab" from tab_rows where has_period union all select 'A&T' from ledger where acctnum = 'MR58200000') t group by 1""")
def flat_export(ctx):
    export = cells.flat_export(cells.flatten(grid(ctx, "account_cells"), grid(ctx, "at_cells")))
    return export.groupBy("Source Tab").agg(F.count(F.lit(1)).alias("n"))


@query("a24_tab_stats", "tab_rows", "tab_headers", "account_cells", check="""
select sheet, acctnum as account, count(*) filter (has_period) as rows_written, max(row_no) - any_value(header_row) - count(*) filter (has_period) as blank_period_dropped, cast(null as varchar) as skip_reason
from tab_rows join tab_headers using (sheet) group by sheet, acctnum
union all select 'Readme', null, null, null, 'A2 is not an account'
union all select 'Empty', null, null, null, 'fewer than 2 rows'""")
def tab_stats(ctx):
    return cells.tab_stats(grid(ctx, "account_cells"))
