"""Truth tables of the column functions."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import cleaning, documents, mining, pages, periods, reporting, tokens

from ledger_rows import LEDGER_SCHEMA, ledger_row


def values(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


# One case per branch and border of the three rules: a marked key, a code that opens the text, a code beside a word.
KEYS = [
    *[(f"INV{sign}8A20", "8A20") for sign in ("", " ", "#", "-", ".", ":", " #-.: ")],  # every sign between mark and key
    ("inv 8a20", "8A20"),  # either case
    ("INV 8A2", None),  # three characters are too few for a marked key
    ("REINV 8A20", None),  # the mark must open a word
    ("INV 12-34/56 paid", "123456"),  # signs inside a key go
    ("INV 12/11/2024 paper 99887", "99887"),  # a date is refused, the next rule is asked
    ("INV ABCD", None),  # so are letters alone
    ("INV ABCD copy INV 4455", None),  # only the first mark counts, and four characters are too few beside a word
    ("INV ABCD copy INV 44556", "44556"),
    ("77001  ", "77001"),  # two blanks behind the opening code
    ("77001 ", None),  # one blank, and no word beside it
    ("7700  lamp", None),  # four characters are too few there
    ("AB-7.1/2   lamp", "AB712"),
    ("1/2/2024  lamp", None),
    ("lamp 77001", "77001"),  # before and behind a word
    ("77001 lamp", "77001"),
    ("77001 of it", None),  # two letters are no word
    ("lamp (77001), desk", "77001"),  # punctuation around a code is cut
    ("lamp 77_001", None),  # other signs are not
    ("lamp 7700", None),
    ("lamp colour", None),
    ("lamp 1/2/2024 desk 88112", "88112"),
    ("", None),
    (None, None),
]


def test_mined_keys(spark):
    mined = mining.mine_invoice_key(F.col("d"), F.lit(None).cast("string"))["key"]
    assert values(spark, "d string", [(t,) for t, _ in KEYS], mined) == [k for _, k in KEYS]


def test_key_of_second_text_and_truncation(spark):
    def full(n):  # a text of n characters that a key ends
        return "x" * (n - 10) + " INV 50607"

    long_key = "7" * 45
    rows = [(full(40), None), (full(39), None), (full(40) + " end", None), ("plain", f"INV {long_key}"), ("INV 1a2b", "INV 99999")]
    mined = mining.mine_invoice_key(F.col("d"), F.col("a"))
    got = values(spark, "d string, a string", rows, mined)
    assert [(r.key, r.truncated) for r in got] == [
        ("50607", True), ("50607", False), ("50607", False), (long_key, False), ("1A2B", False)
    ]


@pytest.mark.parametrize("text,want", [
    ("(1,234.56)", (-1234.56, False)), ("$ 1,000", (1000.0, False)), ("( $5 )", (-5.0, False)), ("abc", (0.0, True)),
    ("1e3", (1000.0, False)), ("", (0.0, True)), ("()", (0.0, True)), (None, (0.0, True)), ("nan", (0.0, True)),
    ("1_000", (1000.0, False)), ("1__0", (0.0, True)), ("_1", (0.0, True)), ("1_0.2_5e1_0", (10.25e10, False)), ("inf", (0.0, True)), ("-7.5", (-7.5, False)), ("$", (0.0, True)),
])
def test_amounts(spark, text, want):
    both = F.struct(cleaning.parse_amount(F.col("v")), cleaning.amount_was_blank(F.col("v")))
    assert tuple(values(spark, "v string", [(text,)], both)[0]) == want


def test_dates_and_ids(spark):
    rows = [("45000.0", "n"), ("19999", "n"), ("2026-01-02T00:00:00", "d"), (" Jan 5 ", "s"), ("#NAME?", "s"), ("45000", "s")]
    assert values(spark, "v string, t string", rows, cleaning.clean_date(F.col("v"), F.col("t"))) == [
        "2023-03-15", "19999", "2026-01-02", "Jan 5", None, "45000"
    ]
    ids = [("123.0", "n"), ("123.5", "n"), ("123.0", "s"), (" null ", "s")]
    assert values(spark, "v string, t string", ids, cleaning.clean_id(F.col("v"), F.col("t"))) == ["123", "123.5", "123.0", None]


PAGES = [
    (5, None, "1-5"), (25, None, "1-2,24-25"), (20, None, "1-20"), (21, None, "1-2,20-21"), (50, "3-8", "3-8"),
    (50, "10-40", "10-11,39-40"), (5, "7-9", "1-5"), (5, "x", "1-5"), (5, "4-9", "4-5"), (5, "4-2", "1-5"),
]


def test_page_selection(spark):
    text = pages.format_pages(pages.select_pages(F.col("n"), F.col("h")))
    assert values(spark, "n int, h string", [p[:2] for p in PAGES], text) == [p[2] for p in PAGES]


def test_pages_read(spark):
    rows = [("1-2,24-25",), ("3-8",), ("7-7",), ("5-3",), ("x",), ("",), (None,), ("1-2,x",)]
    assert values(spark, "r string", rows, pages.pages_read_count(F.col("r"))) == [4, 6, 1, None, None, None, None, None]
    assert values(spark, "r string", rows, pages.has_gap(F.col("r"))) == [True, False, False, False, False, False, False, False]


def test_quarters(spark):
    rows = [("202601",), ("202612",), ("202613",), ("2026",), ("",), ("abcdef",), (None,)]
    assert values(spark, "p string", rows, periods.quarter_of(F.col("p"))) == ["2026Q1", "2026Q4", None, None, None, None, None]
    assert periods.months_of_label(" 2026q3 ") == ["202607", "202608", "202609"]
    assert periods.quarter_scope("2026Q1") == ("2026Q1", "202601,202602,202603,")
    with pytest.raises(ValueError):
        periods.months_of_label("2026Q5")


def test_row_tokens_follow_json_length(spark):
    rows = [
        ledger_row(2), ledger_row(3, descrptn='quote " back \\ tab\t', amount=-12.5, amount_was_blank=True),
        ledger_row(4, descrptn="Café \U0001f600 naïve", category=None, amount=12345678.25), ledger_row(5, userid="\x01"),
    ]
    frame = spark.createDataFrame(rows, LEDGER_SCHEMA)
    got = {r.row_idx: r.t for r in frame.select("row_idx", tokens.estimate_row_tokens().alias("t")).collect()}
    for row in frame.collect():
        assert got[row.row_idx] == len(json.dumps(row.asDict())) // 4 + 860


def test_fingerprint_reacts_to_fields_and_document(spark):
    rows = [ledger_row(2), ledger_row(3), ledger_row(2, amount_was_blank=True, ref="2"), ledger_row(2, adddesc="x"), ledger_row(2)]
    sha = F.when(F.col("n") == 4, "abc")
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], LEDGER_SCHEMA + ", n int").withColumn("ref", F.lit("r"))
    a, b, c, d, e = [r[0] for r in frame.coalesce(1).orderBy("n").select(reporting.row_fingerprint(sha)).collect()]
    assert a == b == c and len({a, d, e}) == 3


def test_body_trust(spark):
    rows = [
        ("text/html", "<p>hi</p>"), ("application/pdf", "x"), ("image/png", "%PDF-1.4 y"), ("text/plain", "Please LOG IN now"),
        ("text/plain", "total 12"), ("application/json", "{}"), ("image/png", "zz"), ("", "zz"),
    ]
    doc = documents.classify_body(F.lit("u"), F.col("t"), F.col("b"), F.lit(30))
    got = values(spark, "t string, b string", rows, doc)
    assert [d.kind for d in got] == ["error", "pdf", "pdf", "error", "text", "text", "error", "error"]
    assert got[1].pages_read == "1-2,29-30" and got[1].est_input_tokens == 4 * 5300
    assert got[3].error == "login_page_detected" and got[7].error == "unsupported_content_type: unknown"


def test_reference_length(spark):
    rows = [("123",), ("a51",), ("a512",), ("1234",), ("http://x/y",), (None,)]
    assert values(spark, "v string", rows, mining.is_substantive_reference(F.col("v"))) == [False, False, True, True, True, None]


def test_low_end_tokens(spark):
    invoice = documents.pdf_invoice(
        F.lit("url"), F.lit("u"), F.lit("x" * 40), F.lit(3), F.lit(None).cast("string"), F.lit("s"), F.lit(1)
    )
    got = values(spark, "a int", [(0,)], tokens.low_end_tokens(F.lit(900 + 3 * 5300 + 10), invoice))
    assert got == [900 + 3 * 3700 + 10]
    assert math.isclose(values(spark, "a int", [(0,)], tokens.input_price(F.lit("x-claude-haiku-4-5-y")))[0], 1.0)


def test_escapes_are_seen_at_every_sign(spark):
    """The first 300 signs but DEL, which counts as one, and some beyond: as long as their ASCII JSON literals."""
    signs = [chr(k) for k in [*range(127), *range(128, 300), 0x2028, 0x1F600]]
    rows = spark.createDataFrame([(f"a{c}b", len(json.dumps(f"a{c}b"))) for c in signs], "t string, want int")
    assert rows.where(tokens.json_text_length(F.col("t")) != F.col("want")).count() == 0
    assert tokens._NOT_PLAIN.count("-") == 1  # one range of signs: several are tested one by one
