"""Decision log: store routing, last write wins, set differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import log, reconcile, resolution
from ...session import scratch_path
from ..registry import query
from .reconcile import records
from .resolution import _SUBSTANTIVE as SUBSTANTIVE


def _stores(ctx):
    lines = ctx.view("decision_log")
    return lines.where("store_ord = 0").drop("store_ord"), lines.where("store_ord = 1").drop("store_ord")


@query("k1_store_routing", "records",
       check="select row_idx, case when acctnum = 'MR58200000' then 'deal' else 'main' end as store from records")
def routing(ctx):
    return log.route_store(records(ctx)).select("row_idx", "store")


@query("s13_stored_log", "records", check="""
select row_idx, 7 as seq, case when acctnum = 'MR58200000' then 'deal' else 'main' end as store, phase, classification, amount, currency from records""")
def stored_log(ctx):
    """The records written to a log's stores and read back."""
    nested = reconcile.nest_records(records(ctx)).withColumn("seq", F.lit(7).cast("bigint"))
    path = scratch_path(ctx.spark, "stored-log")
    log.append_log(nested, path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nested.schema)
    lines = log.read_log(ctx.spark, path, schema)
    flat = reconcile.flatten_records(lines).select("row_idx", "phase", "classification", "amount", "currency")
    return lines.select("row_idx", "seq", "store").join(flat, "row_idx")


@query("u2_union_of_stores", "decision_log", check="select seq, row_idx, store_ord from decision_log")
def union_of_stores(ctx):
    return log.union_stores(*_stores(ctx)).select("seq", "row_idx", "store_ord")


@query("w1_latest_per_row", "decision_log", check="""
select row_idx, seq, phase, classification, n - 1 as superseded from (
 select *, count(*) over (partition by row_idx) as n, row_number() over (partition by row_idx order by store_ord desc, seq desc) as rn from decision_log) t where rn = 1""")
def latest(ctx):
    return log.latest_per_row(log.union_stores(*_stores(ctx))).select("row_idx", "seq", "phase", "classification", "superseded")


@query("o5_row_order", "decision_log", check="select row_idx, max(seq) as seq from decision_log group by row_idx")
def row_order(ctx):
    return log.latest_per_row(log.union_stores(*_stores(ctx))).select("row_idx", "seq").orderBy("row_idx")


@query("j11_undecided_rows", "ledger", "decision_log",
       check="select row_idx from ledger where row_idx not in (select row_idx from decision_log)")
def undecided(ctx):
    return log.undecided(ctx.view("ledger"), ctx.view("decision_log")).select("row_idx")


@query("u3_row_difference", "ledger", "decision_log",
       check="select row_idx from ledger except select row_idx from decision_log")
def difference(ctx):
    return ctx.view("ledger").select("row_idx").subtract(ctx.view("decision_log").select("row_idx"))


@query("u4_distinct_references", "ledger", "bodies", check=f"""
select distinct invoice_url, b.kind, b.sha256 from ledger join bodies b on b.url = invoice_url where {SUBSTANTIVE.format("invoice_url")}""")
def distinct_references(ctx):
    found = resolution.fetched_documents(ctx.view("ledger"), ctx.view("fetched_bodies"))
    kept = F.when(F.col("url_doc.error").isNull() | ~F.col("url_doc.error").like("oversize%"), F.col("url_doc.sha256"))
    return found.select("invoice_url", F.col("url_doc.kind").alias("kind"), kept.alias("sha256"))
