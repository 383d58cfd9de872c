"""Whole jobs: error records, recovery from a log's lines, runs that go on, checks of cells."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import log, reconcile, resolution, scope, triage
from ledgerloom.plans import jobs
from ledgerloom.plans.stages import Stages

BODIES = "url string, content_type string, body string, page_count int"
FILES = "stem string, size_bytes long, head string, sha256 string, page_count int, text string"
LOOKUP = "csv_row long, invoice_key string, vendor_invoice_no string, gnl_ref string, pages string, gl_entityids string"
GRID = "file string, sheet_no int, sheet string, row_no int, col_no int, value string, vtype string"


def no_invoices(spark):
    return jobs.InvoiceTables(*(spark.createDataFrame([], s) for s in (BODIES, FILES, LOOKUP)))


def recurring(items):
    rest = [F.lit(None).cast("string").alias(c) for c in reconcile.ANSWER_FIELDS if c != "classification"]
    return items.select("batch_id", "row_idx", F.lit("recurring").alias("classification"), *rest)


def test_rows_without_money_become_error_records(spark, make_ledger):
    ledger = make_ledger([{}, {"amount": None}, {"amount": float("nan")}, {"amount": float("inf")}, {"amount": 1e33}, {"amount": -1e31}])
    failures = spark.createDataFrame([], "row_idx long, reason string")
    result = jobs.review_run(ledger, no_invoices(spark), recurring, failures)
    got = {r.row_idx: r for r in result.records.collect()}
    assert sorted(got) == [2, 3, 4, 5, 6, 7]
    assert {i: got[i].error for i in (2, 7)} == {2: None, 7: None} and got[7].classification == "skipped_negative"
    for i, text in ((3, "missing"), (4, "NaN"), (5, "Infinity"), (6, "1.0E33")):
        assert text in got[i].error and got[i].error.startswith("phase0_resolution_error: ")
        assert (got[i].phase, got[i].classification, got[i].missing_info) == ("phase0", "human_review", got[i].error)
        assert got[i].row_hash and got[i].flags == []
    assert json.loads(result.summary.first().summary)["usage"]["error_count"] == 4
    shown = {r.row_idx: r.classification for r in result.annotated.collect()}
    assert shown[2] == "recurring" and shown[3] == shown[6] == "human_review"


def test_errors_are_counted_beside_the_rest(spark, make_ledger):
    ledger = make_ledger([{"descrptn": "reclass"}, {"amount": None}, {"amount": float("nan")}, {}])
    rows = triage.prepared(triage.sound(ledger))
    tables = no_invoices(spark)
    items = resolution.work_items(triage.scorer_bound(rows), tables.bodies, tables.files, tables.lookup)
    counts = resolution.preparation_counts(triage.settled(rows), items, triage.flawed(ledger)).first()
    assert (counts.reclass_fired, counts.to_classify, counts.errors) == (1, 1, 2)
    assert resolution.preparation_counts(triage.settled(rows), items).first().errors == 0
    assert triage.flawed(ledger.where("false")).count() == 0


def line(row_idx: int, label: str, acctnum: str = "MR70000001", **more) -> str:
    packet = {"row_idx": row_idx, "period": "202601", "acctnum": acctnum, "amount": 1500.0, "amount_was_blank": False, "currency": "USD"}
    return json.dumps({
        "row_idx": row_idx, "packet": packet, "phase": "classify", "had_invoice": "no", "invoice_accessed": "no",
        "decision": {"classification": label, "basis": "none", "missing_info": "x" * 40}, "flags": [],
        "usage": {"input_tokens": 1, "output_tokens": 1}, **more,
    })


def test_log_folds_by_the_place_of_its_lines(spark, tmp_path, make_ledger):
    """One file without run numbers, read in many splits, against a fold line by line."""
    path = tmp_path / "log"
    path.mkdir()
    written = [(2 + i * 7 % 23, f"label {i}") for i in range(400)]
    body = [line(row, label) for row, label in written]
    body[100:100] = ["", '{"row_idx": 3, "decision": {"classif', "[]"]
    (path / "log.jsonl").write_text("\n".join(body) + '\n{"row_idx": 2, "phase": "cl')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        lines = log.read_ordered_log(spark, str(path), reconcile.log_schema())
        assert lines.rdd.getNumPartitions() > 4
        result = jobs.recover_log(make_ledger([{}, {}, {"period": "202512"}]), str(path), months="1")
        records = {r.row_idx: r for r in result.records.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {i: r.classification for i, r in records.items()} == dict(written)
    shown = {r.row_idx: r.classification for r in result.annotated.collect()}
    assert shown == {i: dict(written)[i] for i in (2, 3, 4)}
    # Rows that the ledger lacks are records still.
    assert json.loads(result.summary.first().summary)["coverage"]["records"] == len(dict(written)) == 23


def test_run_numbers_and_stores_come_before_places(spark, tmp_path, make_ledger):
    path = tmp_path / "log"
    path.mkdir()
    ma = "MR58200000"
    (path / "a.jsonl").write_text("\n".join([
        line(2, "second run", seq=2), line(2, "first run", seq=1), line(2, "no number"), line(3, "deal store", ma), line(3, "main store", seq=9),
    ]))
    result = jobs.recover_log(make_ledger([{}, {}, {}]), str(path))
    assert {r.row_idx: r.classification for r in result.annotated.collect()} == {2: "second run", 3: "deal store", 4: "not_processed"}
    nothing = jobs.recover_log(make_ledger([{}]), str(tmp_path / "none"))
    assert nothing.records.count() == 0 and nothing.annotated.first().classification == "not_processed"


def workbooks(spark):
    def row(sheet, row_no, values, file="a"):
        return [(file, 1, sheet, row_no, i, v, "s") for i, v in enumerate(values, start=1) if v is not None]

    tab = row("Rent", 1, ["Rent of offices"]) + row("Rent", 2, ["MR70000009"])
    tab += row("Rent", 4, ["Period", "Date", "Counterparty", "Amount", "USERID", "DESCRPN"])
    tab += row("Rent", 5, ["202601", "2026-01-03", "Y", "1200", "u", "rent"]) + row("Rent", 6, ["202602", "2026-02-03", "Y", "5", "u", "small"])
    tab += row("Rent", 7, ["202602", "2026-02-03", "Y", "-2000", "u", "credit"]) + row("Rent", 8, ["202512", "2025-12-03", "Y", "9000", "u", "old"])
    flat = row("A&T", 1, ["PERIOD", "ACCTNUM", "USD Amount", "DESCRPN"], "b") + row("A&T", 2, ["202603", "MR58200000", "7000", "deal"], "b")
    flat += row("A&T", 3, ["202603", "MR70000001", "7000", "not of the account"], "b")
    return spark.createDataFrame(tab, GRID), spark.createDataFrame(flat, GRID)


def test_flat_run_goes_on_where_it_failed(spark, tmp_path):
    path, asked = str(tmp_path / "out"), []
    failures = spark.createDataFrame([], "row_idx long, reason string")

    def fails(items):
        raise RuntimeError("scorer is away")

    def answers(items):
        asked.append(1)
        return recurring(items)

    run = lambda score, quarter="2026Q1": jobs.flat_run(
        *workbooks(spark), quarter, no_invoices(spark), score, failures, path, seq=1
    )
    with pytest.raises(RuntimeError, match="away"):
        run(fails)
    stages = tmp_path / "out" / "_runs" / "1"
    done = {p.parent.name: p.stat().st_mtime_ns for p in stages.glob("*/_SUCCESS")}
    assert {"ledger", "exported", "prepared", "items", "batched"} <= set(done) and "records" not in done
    assert not (tmp_path / "out" / "log").exists()
    run(answers)
    again = {p.parent.name: p.stat().st_mtime_ns for p in stages.glob("*/_SUCCESS")}
    assert {k: again[k] for k in done} == done and {"records", "written"} <= set(again)
    want = {2: "recurring", 3: None, 4: "skipped_negative", 5: None, 6: "non_recurring"}
    shown = {r.row_idx: r.classification for r in spark.read.parquet(f"{path}/annotated").collect()}
    assert shown == want and asked == [1]
    run(fails)  # all is there: neither scored nor logged again
    lines = log.read_ordered_log(spark, f"{path}/log", reconcile.log_schema())
    assert sorted(r.row_idx for r in lines.collect()) == [2, 4, 6]
    assert spark.read.option("header", True).csv(f"{path}/flat").count() == 5
    with pytest.raises(ValueError, match="holds a run"):
        run(answers, "2026Q2")


def test_stage_tables_cut_off_are_written_again(spark, tmp_path):
    stages = Stages(spark, str(tmp_path), {"a": 1})
    assert stages.table("t", lambda: spark.range(3)).count() == 3
    assert stages.table("t", lambda: spark.range(9)).count() == 3
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert Stages(spark, str(tmp_path), {"a": 1}).table("t", lambda: spark.range(9)).count() == 9


def test_check_of_cells_names_what_is_wrong(spark):
    head = ["PERIOD", "ACCTNUM", "USD Amount", "DESCRPN", "USERID"]
    rows = [head, ["202601", "MR70000001", "-10", "reclass", "closegl"], None, ["202601", "MR70000001", "5000", "rent", "u"]]
    cells = [("f", 1, "G", n, c, v, "s") for n, row in enumerate(rows, start=1) if row for c, v in enumerate(row, start=1)]
    got = jobs.check_cells(spark.createDataFrame(cells, GRID)).first()
    assert (got.total_data_rows, got.skipped_blank_rows, got.negative_rows, got.close_rows, got.kept) == (2, 1, 1, 1, 1)
    texts = got.warning_texts.split("; ")
    assert got.column_warnings == len(texts) and "unresolved invoice_url (1)" in texts
    assert not any(t.startswith("amount") for t in texts)
    other = [c[:5] + ("AMT", "s") if c[3:5] == (1, 3) else c for c in cells]
    renamed = jobs.check_cells(spark.createDataFrame(other, GRID)).first()
    assert renamed.blank_amount_rows == 2 and "amount amount (1)" in renamed.warning_texts.split("; ")


def test_unknown_amounts_stay_in_scope(make_ledger):
    rows = scope.filter_scope(make_ledger([{"amount": None}, {"amount": 1.0}, {"amount": 2000.0}]))
    assert sorted(r.row_idx for r in rows.collect()) == [2, 4]


def test_flat_run_flattens_once(spark, tmp_path, monkeypatch):
    called = []
    monkeypatch.setattr(jobs.cells, "flatten", lambda *a, whole=jobs.cells.flatten: called.append(a) or whole(*a))
    failures = spark.createDataFrame([], "row_idx long, reason string")
    jobs.flat_run(*workbooks(spark), "2026Q1", no_invoices(spark), recurring, failures, str(tmp_path / "run"), 1)
    assert len(called) == 1
