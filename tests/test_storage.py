"""Logs, streams, readers and sinks on real files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.documents import classify_file
from ledgerloom.operators import log, outputs, reconcile, triage
from ledgerloom.plans import jobs
from ledgerloom.session import scratch_root
from ledgerloom.sources import cells, invoices, logs
from ledgerloom.streaming import live


def test_log_round_trip_with_malformed_tail(spark, tmp_path, make_ledger):
    path = str(tmp_path / "log")
    ledger = make_ledger([{"descrptn": "reclass"}, {"descrptn": "reclass", "acctnum": "MR58200000"}])
    first = reconcile.settled_records(triage.settled(triage.prepared(ledger)))
    log.append_log(reconcile.nest_records(first).withColumn("seq", F.lit(1).cast("long")), path)
    again = first.withColumn("classification", F.lit("human_review")).where("row_idx = 2")
    nested = reconcile.nest_records(again).withColumn("seq", F.lit(2).cast("long"))
    log.append_log(nested, path)
    (tmp_path / "log" / "store=main" / "part-x.json").write_text('\n{"row_idx": 2, "seq": 9, "phase": "cl')
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nested.schema)
    lines = log.read_log(spark, path, schema)
    assert sorted((r.row_idx, r.seq, r.store) for r in lines.collect()) == [(2, 1, "main"), (2, 2, "main"), (3, 1, "deal")]
    flat = reconcile.flatten_records(lines).withColumn("k", F.lit(1))
    assert flat.count() == 3
    latest = log.latest_per_row(lines.withColumn("store_ord", F.lit(0)).select("row_idx", "seq", "store_ord", "decision.classification"))
    assert sorted((r.row_idx, r.classification, r.superseded) for r in latest.collect()) == [(2, "human_review", 1), (3, "reclass", 0)]
    assert log.read_log(spark, str(tmp_path / "none"), schema).count() == 0


def test_profile_scan_is_strict(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text('{"quarters": ["2026Q1"], "entries": [{"name": "X", "supporting_row_idxs": [3]}]}')
    assert logs.read_profile(spark, str(good)).select("entry.name", "quarters").first() == ("X", ["2026Q1"])
    bad = tmp_path / "bad.json"
    bad.write_text('{"quarters": [')
    with pytest.raises(Exception):
        logs.read_profile(spark, str(bad)).collect()
    assert logs.read_profile(spark, str(tmp_path / "none.json")).count() == 0


def test_live_latest_is_order_free_and_replay_safe(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "out")
    schema = "row_idx long, store_ord int, seq long, classification string"
    for part in ([(1, 0, 5, "a"), (2, 0, 1, "b"), (1, 0, 6, "c")], [(1, 0, 2, "old"), (3, 1, 1, "d")], [(2, 0, 9, "e")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    live.stream_latest(stream, path, str(tmp_path / "cp1"), available_now=True).awaitTermination()
    want = [(1, 6, "c", 2), (2, 9, "e", 1), (3, 1, "d", 0)]
    read = lambda p: sorted((r.row_idx, r.seq, r.classification, r.superseded) for r in live.read_latest(spark, p).collect())
    assert read(path) == want
    # The same input again under a new checkpoint rewrites the same batches.
    live.stream_latest(stream, path, str(tmp_path / "cp2"), available_now=True).awaitTermination()
    assert read(path) == want
    live.compact_latest(spark, path, str(tmp_path / "compact"))
    assert read(str(tmp_path / "compact")) == want


def test_live_tally_loses_nothing_unless_a_watermark_says_so(spark, tmp_path):
    # Rows are late against the watermark that held before the previous batch.
    source, path = tmp_path / "in", str(tmp_path / "out")
    schema = "ts timestamp, classification string, phase string"
    text = "cast(t as timestamp) as ts, c as classification, 'x' as phase"
    for number, part in enumerate([[("2026-01-01 00:00:10", "a")], [("2026-01-01 01:00:00", "b")], [("2026-01-01 01:00:30", "b")], [("2026-01-01 00:00:20", "late"), ("2026-01-01 00:55:00", "near")]]):
        spark.createDataFrame(part, "t string, c string").selectExpr(*text.split(", ")).coalesce(1).write.json(f"{source}/{number}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(source))
    live.stream_tally(stream, path, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert sorted(r.classification for r in live.read_tally(spark, path).collect()) == ["a", "b", "late", "near"]
    live.compact_tally(spark, path, str(tmp_path / "compact"))
    folded = lambda p: sorted(map(tuple, live.read_tally(spark, p).collect()))
    assert folded(str(tmp_path / "compact")) == folded(path)
    path = str(tmp_path / "bounded")
    live.stream_tally(stream, path, str(tmp_path / "cp2"), "10 minutes", available_now=True).awaitTermination()
    assert sorted(r.classification for r in live.read_tally(spark, path).collect()) == ["a", "b", "near"]


def test_invoice_directory_and_lookup(spark, tmp_path):
    folder = tmp_path / "pdfs"
    folder.mkdir()
    (folder / "1231239.pdf").write_bytes(b"%PDF-1.4 x")
    (folder / "INV-12.3.pdf").write_bytes(b"PK")
    (folder / "note.txt").write_bytes(b"%PDF-")
    listed = invoices.list_invoice_files(spark, str(folder))
    assert sorted(r.stem for r in listed.collect()) == ["1231239", "INV-12.3"]
    read = invoices.read_invoice_files(spark, str(folder))
    doc = classify_file(F.col("path"), F.col("size_bytes"), F.col("head"), F.col("sha256"), F.lit(1), F.lit("t"), F.lit(None).cast("string"))
    assert sorted((r.stem, r.kind) for r in read.select("stem", doc.alias("d")).select("stem", "d.kind").collect()) == [("1231239", "pdf"), ("INV-12.3", "error")]
    table = tmp_path / "lookup.csv"
    table.write_text("invoice_key,vendor_invoice_no,gnl_ref,pages,gl_entityids\nINV-5,VN 77,A,1-2,7\n,88,,,\n")
    from ledgerloom.operators.invoices import lookup_index

    got = lookup_index(invoices.read_lookup_csv(spark, str(table)))
    assert sorted((r.index_key, r.pages) for r in got.collect()) == [("5", "1-2"), ("88", None), ("VN77", "1-2")]
    assert invoices.read_lookup_csv(spark, str(tmp_path / "none.csv")).count() == 0


def test_annotation_is_idempotent_and_written_by_period(spark, tmp_path, make_ledger):
    ledger = make_ledger([{"descrptn": "reclass"}, {}, {"period": "202512"}])
    records = reconcile.settled_records(triage.settled(triage.prepared(ledger)))
    once = outputs.annotate(ledger, records, ledger.where("period = '202601'"))
    twice = outputs.annotate(once, records, ledger.where("period = '202601'"))
    assert once.columns == twice.columns
    label = lambda df: {r.row_idx: r.classification for r in df.collect()}
    assert label(once) == label(twice) == {2: "reclass", 3: "not_processed", 4: None}
    outputs.write_annotated(once, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("period=*")) == ["period=202512", "period=202601"]


def test_whole_run_keeps_every_row(spark, tmp_path, make_ledger):
    ledger = make_ledger([
        {"descrptn": "reclass"}, {"userid": "CLOSEGL"}, {"amount": -5000.0}, {"descrptn": "depot 73190 wired"}, {"invoice_url": "http://x/1"},
        {"acctnum": "MR58200000"}, {"acctnum": "MR58200000", "period": "202512"}, {"amount": 1.0},
    ])
    bodies = spark.createDataFrame([("http://x/1", "text/plain", "invoice total", 1)], "url string, content_type string, body string, page_count int")
    files = spark.createDataFrame([("73190", 10, "%PDF-", "sha", 3, "text")], "stem string, size_bytes long, head string, sha256 string, page_count int, text string")
    lookup = spark.createDataFrame([], "csv_row long, invoice_key string, vendor_invoice_no string, gnl_ref string, pages string, gl_entityids string")
    score = lambda items: items.select("batch_id", "row_idx", F.lit("recurring").alias("classification"), *[
        F.lit(None).cast("string").alias(c) for c in reconcile.ANSWER_FIELDS if c != "classification"])
    failures = spark.createDataFrame([], "row_idx long, reason string")
    result = jobs.review_run(ledger, jobs.InvoiceTables(bodies, files, lookup), score, failures)
    got = {r.row_idx: (r.phase, r.classification, r.invoice_accessed) for r in result.records.collect()}
    assert got == {
        2: ("phase0", "reclass", "no"), 3: ("phase0", "recurring", "no"), 4: ("phase0", "skipped_negative", "no"),
        5: ("classify", "recurring", "yes"), 6: ("classify", "recurring", "yes"), 7: ("deal_profile", "non_recurring", "no"),
        8: ("deal_profile", "non_recurring", "no"),
    }
    jobs.write_run(result, str(tmp_path / "run"), seq=1)
    document = spark.read.json(str(tmp_path / "run" / "summary")).first()
    assert document.coverage["rows_with_no_record"] == 0 and document.coverage["records"] == 7
    table, summary, excluded = jobs.review_report(result.annotated)
    assert table.count() == 0 and excluded.first()[0] == 2


def test_sheet_choice_prefers_columns_then_name(spark):
    head = lambda sheet, no, names: [("f", no, sheet, 1, i, n, "s") for i, n in enumerate(names, start=1)]
    data = head("Foo", 1, ["Foo", "Bar"]) + head("Data", 2, ["PERIOD", "REF", "USD Amount"]) + head("Copy", 3, ["PERIOD", "REF", "USD Amount"])
    grid = spark.createDataFrame(data, "file string, sheet_no int, sheet string, row_no int, col_no int, value string, vtype string")
    assert cells.choose_sheets(grid).first().sheet == "Data"
    assert cells.choose_sheets(grid, " copy ").first().sheet == "Copy"
    assert cells.choose_sheets(grid, "foo").first().sheet == "Data"
    kinds = {(r.sheet, r.kind) for r in cells.column_warnings(cells.first_row(grid)).collect()}
    assert ("Foo", "amount") in kinds and ("Data", "amount") not in kinds and ("Data", "unresolved") in kinds


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    assert scratch_root(spark)

    class FakeContext:
        master = "spark://host"
        getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k: None)}))

    fake = type("S", (), {"sparkContext": FakeContext, "conf": type("C", (), {"get": staticmethod(lambda k, d=None: d)})})
    with pytest.raises(RuntimeError):
        scratch_root(fake)


def test_log_is_packed_and_takes_plain_lines_too(spark, tmp_path, make_ledger):
    path = tmp_path / "log"
    rows = make_ledger([{"descrptn": "reclass"}] * 300)
    nested = reconcile.nest_records(reconcile.settled_records(triage.settled(triage.prepared(rows))))
    log.append_log(nested.withColumn("seq", F.lit(1).cast("long")), str(path))
    files = [f for f in path.rglob("part-*")]
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert sum(f.stat().st_size for f in files) < 300 * 100  # a line has several hundred signs
    again = nested.where("row_idx < 5").withColumn("seq", F.lit(2).cast("long"))
    again.withColumn("store", F.lit("main")).write.mode("append").partitionBy("store").json(str(path))
    lines = log.read_ordered_log(spark, str(path), reconcile.log_schema())
    assert (lines.count(), lines.where("seq.seq = 2").count()) == (303, 3)
    latest = log.latest_per_row(lines)
    assert latest.count() == 300 and {r.seq.seq for r in latest.where("row_idx < 5").collect()} == {2}
