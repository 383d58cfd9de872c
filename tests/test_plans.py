"""Plan shapes that must hold at any size, and a sample of registered queries against their checking SQL."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom import vocab
from ledgerloom.operators import joins, resolution, scope, triage
from ledgerloom.plans import catalog
from ledgerloom.plans.registry import CHECKS, QUERIES, Context
from ledgerloom.sources import cells

SMALL = "/root/testdata/sf0.001"
SAMPLE = (
    "x_scoped_amounts", "f3_rule_triage", "j7_resolution", "c4_work_items", "w3_batches", "c1_reconciled_rows",
    "w6_review_order", "w8_rolling_minute", "k4_profile_table", "j13_known_deals_in_text", "s1_typed_ledger",
    "s10_flatten", "t2_live_tally", "x4_review_run", "x6_recover",
)
ROWS_ONLY = {"p38_scorer_view", "k3_run_summary"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scope_filter_reaches_the_scan_and_prunes_columns(spark, tmp_path, make_ledger):
    path = str(tmp_path / "ledger")
    make_ledger([{"period": f"2026{m:02d}"} for m in range(1, 9)]).write.parquet(path)
    ledger = spark.read.parquet(path)
    amounts = triage.triage(triage.with_mined_key(scope.filter_scope(ledger))).groupBy("classification", "currency").agg(F.sum("amount"))
    text = plan(amounts)
    assert "GreaterThanOrEqual(period,202606)" in text
    read = text[text.index("ReadSchema"):].split("\n")[0]
    assert "invoice_url" not in read and "source" not in read and "entityid" not in read


def test_rows_carry_no_document_text(spark, make_ledger):
    ledger = make_ledger([{"invoice_url": "http://x/long"}, {"descrptn": "depot 73190 wired"}])
    bodies = spark.createDataFrame([("http://x/long", "text/plain", "y" * 400, 0)], "url string, content_type string, body string, page_count int")
    files = spark.createDataFrame([("73190", 10, "%PDF-", "sha", 3, "z" * 800)], "stem string, size_bytes long, head string, sha256 string, page_count int, text string")
    lookup = spark.createDataFrame([], "vendor_invoice_no string, invoice_key string, gnl_ref string, pages string, gl_entityids string, csv_row long")
    items = resolution.work_items(triage.scorer_bound(triage.prepared(ledger)), bodies, files, lookup)
    got = {r.row_idx: r.invoice for r in items.collect()}
    assert [(got[k].text, got[k].text_tokens) for k in (2, 3)] == [(None, 100), (None, 200)]
    texts = {r.sha256: len(r.text) for r in resolution.document_texts(bodies, files).collect()}
    assert texts == {got[2].sha256: 400, got[3].sha256: 800}


def test_every_query_is_checked_or_known_to_be_rows_only():
    catalog.load()
    assert set(QUERIES) - set(CHECKS) == ROWS_ONLY
    assert entry.FLAGSHIP in QUERIES


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="test tables not present")
@pytest.mark.parametrize("name", ["x1_ingest_check", "j1_header_aliases", "j13_known_deals_in_text", "j14_operator_rules", "c1_reconciled_rows", "j7_resolution"])
def test_no_pairing_joins(spark, name):
    catalog.load()
    text = plan(QUERIES[name](Context(spark, SMALL)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="test tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_check(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {table.stem} as select * from '{table}'")
    catalog.load()
    df = QUERIES[name](Context(spark, SMALL))
    cursor = con.execute(CHECKS[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect())
    assert got == sorted(str(tuple(r)) for r in cursor.fetchall())


def test_limits_of_documents_are_lifted_by_the_job(spark, make_ledger):
    ledger = make_ledger([{"invoice_url": "http://x/long"}, {"descrptn": "depot 73190 wired"}])
    bodies = spark.createDataFrame(
        [("http://x/long", "application/pdf", "y" * 400, 60)], "url string, content_type string, body string, page_count int"
    )
    files = spark.createDataFrame(
        [("73190", 1000, "%PDF-", "sha", 50, "z" * 800)],
        "stem string, size_bytes long, head string, sha256 string, page_count int, text string",
    )
    lookup = spark.createDataFrame(
        [], "vendor_invoice_no string, invoice_key string, gnl_ref string, pages string, gl_entityids string, csv_row long"
    )
    bound = triage.scorer_bound(triage.prepared(ledger))

    def read(limits):
        items = resolution.work_items(bound, bodies, files, lookup, limits=limits).orderBy("row_idx").collect()
        return [(r.invoice_accessed, r.invoice.pages_read) for r in items]

    ends = [("yes", "1-2,59-60"), ("yes", "1-2,49-50")]
    assert read(resolution.Limits()) == ends
    assert read(resolution.Limits(full_read=55)) == [ends[0], ("yes", "1-50")]
    assert read(resolution.Limits(None, None)) == [("yes", "1-60"), ("yes", "1-50")]
    assert [accessed for accessed, _ in read(resolution.Limits(max_bytes=300))] == ["no", "no"]


def test_cells_never_meet_by_sheet(spark, tmp_path):
    """One sheet may hold nearly all cells, so tables of sheets come to the cells; rows of other accounts are not put together."""
    grid = "file string, sheet_no int, sheet string, row_no int, col_no int, value string, vtype string"
    flat = lambda n, *v: [("b", 1, vocab.AT_SHEET, n, k, x, "s") for k, x in enumerate(v, start=1)]
    tab = lambda n, *v: [("a", 1, "T", n, k, x, "s") for k, x in enumerate(v, start=1)]
    rows = flat(1, "ACCTNUM", "PERIOD", "USD Amount")
    for n in range(2, 200):
        rows += flat(n, vocab.MA_ACCOUNT if n % 50 == 0 else "58200000" if n == 64 else "MR70000001", "202601", str(n))
    tabs = tab(1, "Name") + tab(2, "MR70000001") + tab(4, "Period", "Counterparty", "Amount") + tab(7, "202601", "x", "5")
    for name, made in (("flat", rows), ("tabs", tabs)):
        spark.createDataFrame(made, grid).write.parquet(f"{tmp_path}/{name}")
    flat_cells, tab_cells = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("flat", "tabs"))
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")  # as if nothing were known to be small
    try:
        for out, cells_ in ((cells.extract_flat(flat_cells), 1), (cells.extract_tabs(tab_cells), 1)):
            text = plan(out)
            assert "SortMergeJoin" not in text and "hashpartitioning(file" not in text
            assert text.count("hashpartitioning(row_no") == cells_
        got = sorted((r["row_no"], r["USD Amount"]) for r in cells.extract_flat(flat_cells).collect())
        near = cells.cells_of_rows(flat_cells, flat_cells.where("row_no in (63, 64, 127, 128)").select("file", "sheet", "row_no"))
        assert sorted({r.row_no for r in near.collect()}) == [63, 64, 127, 128] and near.count() == 12
    finally:
        spark.conf.set(name, before)
    assert got == [(n, str(n)) for n in (50, 64, 100, 150)]
    assert [r["USD Amount"] for r in cells.extract_tabs(tab_cells).collect()] == ["5"]


def test_rows_without_a_key_are_spread(spark):
    """The salt must be among what the join's shuffle goes by: else all rows without a key meet in one task."""
    rows = spark.range(3000).selectExpr("id as row_idx", "case when id % 10 = 0 then cast(id as string) end as k")
    lookup = spark.range(0, 3000, 20).selectExpr("cast(id as string) as k", "id as found")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        joined = joins.lookup_join(rows, lookup, ["k"], "row_idx")
        text = plan(joined)
        assert all("_salt" in part[:40] for part in text.split("hashpartitioning(")[1:]) and "hashpartitioning(" in text
        got = {r.row_idx: r.found for r in joined.collect()}
    finally:
        spark.conf.set(name, before)
    assert got == {n: n if n % 20 == 0 else None for n in range(3000)}
