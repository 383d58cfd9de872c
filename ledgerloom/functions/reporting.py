"""Text shown in results: pointers, labels, status words, hygiene checks, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab

DASH = "—"
HASHED_FIELDS = (
    "acctnum", "adddesc", "amount", "category", "currency", "department", "descrptn", "entityid", "entrdate",
    "invoice_url", "period", "ref", "source", "userid",
)
CLASS_LABELS = {
    "human_review": "Human Review", "non_recurring": "Non-Recurring", "L": 'Needs Reclass (raw: "L")',
}


def row_fingerprint(sha256: Column, row: dict[str, Column] | None = None) -> Column:
    """SHA-256 over every business field, the document hash and a version tag.

    Each field is written `name=value`, null as `name!`, separated by U+001F, the amount with two decimals.
    """
    field = row or {name: F.col(name) for name in HASHED_FIELDS}

    def tagged(name: str) -> Column:
        value = field[name].cast("decimal(38,2)").cast("string") if name == "amount" else field[name]
        return F.coalesce(F.concat(F.lit(f"{name}="), value), F.lit(f"{name}!"))

    parts = [tagged(name) for name in HASHED_FIELDS]
    tail = [F.coalesce(sha256, F.lit(vocab.NO_INVOICE)), F.lit(vocab.HASH_VERSION)]
    return F.sha2(F.concat_ws("\u001f", *parts, *tail), 256)


def invoice_pointer(invoice_url: Column, summary: Column) -> Column:
    """The row's URL, else path and pages of the local document that was read, else empty."""
    local = summary["kind"].isin(*vocab.READABLE_KINDS) & (summary["source"] == "local_file")
    path, pages = summary["path_or_url"], summary["pages_read"]
    with_pages = F.when(F.coalesce(pages, F.lit("")) != "", F.concat(path, F.lit(" p."), pages)).otherwise(path)
    return (
        F.when(F.coalesce(invoice_url, F.lit("")) != "", invoice_url)
        .when(F.coalesce(local, F.lit(False)) & (F.coalesce(path, F.lit("")) != ""), with_pages)
        .otherwise("")
    )


def sweep_status(phase: Column, flags: Column, invoice_accessed: Column) -> Column:
    return (
        F.when(phase != "deal_profile", "")
        .when(F.array_contains(flags, "deal_sweep_failed"), "could not gather")
        .when(F.array_contains(flags, "deal_sweep_skipped"), "not swept")
        .when(invoice_accessed == "yes", "invoice read")
        .otherwise("invoice not read")
    )


def supporting_doc_kind(pointer: Column) -> Column:
    return (
        F.when(pointer.isNull(), "none")
        .when(pointer.startswith("http"), "url")
        .when(pointer.try_cast("double").isNotNull(), "number")
        .otherwise("text")
    )


def supporting_doc(pointer: Column, had_invoice: Column) -> Column:
    """Display text of the supporting document."""
    kind = supporting_doc_kind(pointer)
    page = F.format_string("Page %d (batch PDF)", pointer.try_cast("double").cast("bigint"))
    return (
        F.when(kind == "url", "View Invoice")
        .when(kind == "number", page)
        .when((kind == "text") & (F.lower(F.trim(pointer)) == "unpaid"), "Unpaid — no invoice ref")
        .when(kind == "text", pointer)
        .when(F.lower(F.coalesce(had_invoice, F.lit(""))) == "no", "No invoice on file")
        .otherwise("Invoice on file — no reference")
    )


def local_amount(currency: Column, amount: Column) -> Column:
    """`EUR 1,234.50`; a dash for USD and for missing amounts."""
    code = F.coalesce(F.when(currency != "", currency), F.lit("USD"))
    text = F.concat(code, F.lit(" "), F.format_number(amount.cast("decimal(38,2)"), 2))
    return F.when((code != "USD") & amount.isNotNull(), text).otherwise(DASH)


def class_label(classification: Column) -> Column:
    chosen = None
    for key, label in CLASS_LABELS.items():
        chosen = F.when(classification == key, label) if chosen is None else chosen.when(classification == key, label)
    return chosen.otherwise(classification)


def dash_if_empty(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(DASH)


def quarter_span(low: Column, high: Column) -> Column:
    """`2026Q1` for one quarter, `2026Q1 – 2026Q3` for a set given by its least and greatest member."""
    return F.when(low.isNull(), "").when(low == high, low).otherwise(F.concat(low, F.lit(" – "), high))


def strip_comments(c: Column) -> Column:
    """Text without HTML comments, trimmed; null when nothing is left."""
    text = F.trim(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), )
    text = F.btrim(text, F.lit(" \t\n\r"))
    return F.when(text != "", text)


def word_count(c: Column) -> Column:
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.coalesce(F.size(words), F.lit(0))


def context_status(words: Column) -> Column:
    return (
        F.when(words == 0, "empty")
        .when(words > vocab.CONTEXT_WORD_CAP, "too_large")
        .when(words > vocab.CONTEXT_WORD_WARN, "warn")
        .otherwise("ok")
    )
