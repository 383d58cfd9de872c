"""Scope, quarters, row selection, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.periods import months_of_quarter, quarter_of, quarter_scope
from ...operators import scope
from ..registry import query
from . import common  # noqa: F401

_LATEST3 = "period in (select distinct period from ledger order by period desc limit 3)"
_QUARTER = (
    "case when regexp_matches(period, '^[0-9]{6}') and cast(substr(period, 5, 2) as int) between 1 and 12 "
    "then concat(left(period, 4), 'Q', cast((cast(substr(period, 5, 2) as int) + 2) // 3 as varchar)) end"
)


@query("f1_scope_latest_periods", "ledger", check=f"select row_idx, period from ledger where {_LATEST3}")
def latest(ctx):
    return scope.scope_periods(ctx.view("ledger")).select("row_idx", "period")


@query("f1_scope_named_periods", "ledger",
       check="select row_idx, period from ledger where period in ('199501', '199712')")
def named(ctx):
    return scope.scope_periods(ctx.view("ledger"), "199501, 199712,").select("row_idx", "period")


@query("f1_scope_single_period", "ledger", check="select row_idx, period from ledger where period = '199803'")
def single(ctx):
    return scope.scope_periods(ctx.view("ledger"), "199803").select("row_idx", "period")


@query("f2_scope_materiality", "ledger",
       check="select row_idx, amount from ledger where amount_was_blank or abs(amount) >= 999")
def materiality(ctx):
    return scope.filter_scope(ctx.view("ledger"), "all").select("row_idx", "amount")


@query("f5_ma_rows", "ledger", check="select row_idx from ledger where acctnum = 'MR58200000'")
def ma_rows(ctx):
    return scope.select_ma(ctx.view("ledger")).select("row_idx")


@query("f6_quarter_split", "ledger",
       check=f"select row_idx, coalesce({_QUARTER} in ('1995Q1', '1999Q4'), false) as selected from ledger")
def quarter_split(ctx):
    return scope.split_by_quarters(ctx.view("ledger"), ["1995Q1", "1999Q4"]).select("row_idx", "selected")


@query("f7_quarter_argument", "ledger", check=f"""
select row_idx, {_QUARTER} as quarter from ledger
where {_QUARTER} in (select distinct {_QUARTER} from ledger order by 1 desc limit 2)""")
def quarter_argument(ctx):
    ledger = ctx.view("ledger")
    rows = scope.split_by_quarters(ledger, scope.resolve_quarters(ledger, "2")).where("selected")
    return rows.select("row_idx", quarter_of(F.col("period")).alias("quarter"))


@query("f8_route", "ledger",
       check="select row_idx, case when acctnum = 'MR58200000' then 'sweep' else 'classify' end as route from ledger")
def routed(ctx):
    return scope.route(ctx.view("ledger")).select("row_idx", "route")


def _wanted(ctx):
    return ctx.view("events").select((F.col("user_id") * 3).alias("row_idx"))


@query("f9_explicit_rows", "ledger",
       check="select row_idx, acctnum from ledger where row_idx in (select user_id * 3 from events)")
def explicit_rows(ctx):
    return scope.select_rows(ctx.view("ledger"), _wanted(ctx)).select("row_idx", "acctnum")


@query("u6_missing_rows", "ledger",
       check="select distinct user_id * 3 as row_idx from events where user_id * 3 not in (select row_idx from ledger)")
def missing_rows(ctx):
    return scope.missing_rows(ctx.view("ledger"), _wanted(ctx))


@query("o3_sample", "ledger", check="""
select row_idx, acctnum from (
 select *, acctnum = 'MR58200000' as ma, row_number() over (partition by acctnum = 'MR58200000' order by row_idx) as rn from ledger) t
where (ma and rn <= 50) or (not ma and rn <= 101 - least(50, (select count(*) from ledger where acctnum = 'MR58200000')))""")
def sample(ctx):
    return scope.sample_rows(ctx.view("ledger"), 101).select("row_idx", "acctnum")


@query("o4_periods_sorted", "ledger", check="select distinct period from ledger")
def periods_sorted(ctx):
    return scope.distinct_periods(ctx.view("ledger")).orderBy("period")


@query("w2_latest_periods", "ledger", check="select distinct period from ledger order by period desc limit 5")
def latest_periods(ctx):
    return scope.latest_periods(ctx.view("ledger"), 5)


@query("a3_scope_stats", "ledger", check=f"""
select count(*) as total_in, count(*) filter (not ({_LATEST3})) as excluded_by_period,
 count(*) filter ({_LATEST3} and not (amount_was_blank or abs(amount) >= 999)) as excluded_by_amount,
 count(*) filter ({_LATEST3} and (amount_was_blank or abs(amount) >= 999)) as kept,
 (select string_agg(period, ',' order by period) from (select distinct period from ledger)) as periods_all,
 (select string_agg(period, ',' order by period) from (select distinct period from ledger order by period desc limit 3)) as periods_selected
from ledger""")
def stats(ctx):
    return scope.scope_stats(ctx.view("ledger"))


@query("a6_quarters_available", "ledger", check=f"select distinct {_QUARTER} as quarter from ledger")
def quarters(ctx):
    return scope.quarters_available(ctx.view("ledger"))


@query("a7_quarter_listing", "ledger", check=f"""
select {_QUARTER} as quarter, count(*) as row_count, count(*) filter (acctnum = 'MR58200000') as ma_rows,
 case when {_QUARTER} in (select {_QUARTER} from ledger where acctnum = 'MR58200000' and currency = 'UNKNOWN') then 'yes' else 'no' end as profile_built
from ledger group by 1""")
def quarter_listing(ctx):
    ledger = ctx.view("ledger")
    swept = ledger.where((F.col("acctnum") == "MR58200000") & (F.col("currency") == "UNKNOWN"))
    return scope.quarter_listing(ledger, swept.select(quarter_of(F.col("period")).alias("quarter")))


@query("p17_quarter_of", "ledger", check=f"select row_idx, {_QUARTER} as quarter from ledger")
def p17(ctx):
    return ctx.view("ledger").select("row_idx", quarter_of(F.col("period")).alias("quarter"))


@query("p18_months_of_quarter", "ledger", check=f"""
select quarter, concat_ws(',', concat(left(quarter, 4), lpad(cast(3 * q - 2 as varchar), 2, '0')),
 concat(left(quarter, 4), lpad(cast(3 * q - 1 as varchar), 2, '0')), concat(left(quarter, 4), lpad(cast(3 * q as varchar), 2, '0'))) as months
from (select quarter, cast(right(quarter, 1) as int) as q from (select distinct {_QUARTER} as quarter from ledger))""")
def p18(ctx):
    months = F.array_join(months_of_quarter(F.col("quarter")), ",")
    return scope.quarters_available(ctx.view("ledger")).select("quarter", months.alias("months"))


@query("x8_quarter_scope", "ledger",
       check="select row_idx, period from ledger where period in ('199704', '199705', '199706')")
def x8(ctx):
    _, months = quarter_scope("1997Q2")
    return scope.scope_periods(ctx.view("ledger"), months).select("row_idx", "period")
