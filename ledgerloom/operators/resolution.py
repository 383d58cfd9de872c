"""Invoice state of the rows that go to the scorer: work items, and the counters of the preparation phase."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import documents
from ..functions.mining import is_substantive_reference
from ..functions.reporting import row_fingerprint
from ..functions.tokens import estimate_row_tokens, text_tokens
from .invoices import resolve_keys
from .joins import beside, lookup_join

NOT_FETCHED = "fetch_failed: no response body"


@dataclass(frozen=True)
class Limits:
    """Bytes of a document that is still read, and pages up to which all are; None lifts a limit."""

    max_bytes: int | None = vocab.INVOICE_MAX_BYTES
    full_read: int | None = vocab.FULL_READ_PAGES


def fetched_documents(rows: DataFrame, bodies: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Trusted or rejected document per distinct URL worth fetching, without its text."""
    urls = rows.where(is_substantive_reference(F.col("invoice_url"))).select(F.col("invoice_url").alias("url")).distinct()
    document = documents.classify_body(
        F.col("url"), F.col("content_type"), F.col("body"), F.col("page_count"),
        max_bytes=limits.max_bytes, full_read=limits.full_read,
    )
    return bodies.join(urls, "url", "left_semi").select(
        F.col("url").alias("invoice_url"), documents.without_text(document).alias("url_doc")
    )


def document_texts(bodies: DataFrame, files: DataFrame) -> DataFrame:
    """`sha256` and `text`, once per document: what a scorer joins for the rows it asks about."""
    fetched = bodies.select(F.sha2("body", 256).alias("sha256"), F.col("body").alias("text"))
    return fetched.unionByName(files.select("sha256", "text")).where("sha256 is not null").dropDuplicates(["sha256"])


def local_documents(rows: DataFrame, files: DataFrame, lookup: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Resolution status and document per distinct (key, entity) of rows that have no URL.

    `files` carries stem, size_bytes, head, sha256, page_count and text.
    """
    keyed = rows.where("invoice_url is null and key is not null")
    answers = resolve_keys(keyed, files, lookup)
    content = files.select("stem", "size_bytes", "head", "sha256", "page_count", text_tokens(F.col("text")).alias("tokens"))
    document = documents.classify_file(
        F.col("stem"), F.col("size_bytes"), F.col("head"), F.col("sha256"), F.col("page_count"),
        F.lit(None).cast("string"), F.col("hint"), limits.max_bytes, limits.full_read, F.col("tokens"),
    )
    missed = documents.unavailable_invoice(
        F.lit("local_file"), F.col("key"), F.concat(F.lit("local_resolution_"), F.col("status"))
    )
    return lookup_join(answers, content, ["stem"], "key").select(
        "key", F.col("entityid").alias("_entity"), "status",
        F.when(F.col("status") == "resolved", document).otherwise(missed).alias("file_doc"),
    )


def _one(name: str, test: Column) -> Column:
    return F.when(test, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))


def work_items(
    rows: DataFrame, bodies: DataFrame | None, files: DataFrame, lookup: DataFrame, fetch_urls: bool = True,
    limits: Limits = Limits(),
) -> DataFrame:
    """Scorer-bound rows with invoice, had_invoice, invoice_accessed, flags, estimate, fingerprint.

    A URL always wins and never falls back to a key. With `fetch_urls=False` a URL row is charged two average pages.
    `reference` tells which source was used; `status` is the outcome of a local lookup.
    """
    has_url = F.coalesce("invoice_url", F.lit("")) != ""
    entity = F.coalesce(F.trim("entityid"), F.lit(""))
    joined = lookup_join(
        rows.withColumn("_entity", entity).withColumn("_key", F.when(~has_url, F.col("key"))),
        local_documents(rows, files, lookup, limits).withColumnRenamed("key", "_key"), ["_key", "_entity"], "row_idx",
    )
    url_error = lambda text: documents.unavailable_invoice(F.lit("url"), F.col("invoice_url"), F.lit(text))
    nothing = F.lit(None).cast(documents.INVOICE_TYPE)
    if fetch_urls:
        joined = lookup_join(joined, fetched_documents(rows, bodies, limits), ["invoice_url"], "row_idx")
        substantive = is_substantive_reference(F.col("invoice_url"))
        by_url = F.when(~substantive, url_error("reference_too_short")).otherwise(
            F.coalesce("url_doc", url_error(NOT_FETCHED))
        )
    else:
        by_url = nothing
    reference = F.when(has_url, "url").when(F.col("key").isNotNull(), "key").otherwise("none")
    source = joined.withColumn("reference", reference).withColumn(
        "invoice", F.when(F.col("reference") == "url", by_url).when(F.col("reference") == "key", F.col("file_doc")).otherwise(nothing)
    ).drop("_entity", "_key", "file_doc", "url_doc")
    readable = documents.is_readable(F.col("invoice"))
    had = F.col("reference") != "none"
    failed = had & F.col("invoice").isNotNull() & ~readable
    extra = (
        F.when(readable, F.col("invoice.est_input_tokens"))
        .when((F.col("reference") == "url") & F.lit(not fetch_urls), 2 * vocab.PAGE_TOKENS_MID).otherwise(0)
    )
    yes_no = lambda test: F.when(test, "yes").otherwise("no")
    return source.withColumns({
        "had_invoice": yes_no(had),
        "invoice_accessed": yes_no(readable),
        "flags": F.concat(
            "flags", _one("had_invoice", had), _one("invoice_accessed", readable), _one("invoice_unavailable", failed)
        ),
        "est_input_tokens": (estimate_row_tokens() + extra).cast("bigint"),
        "row_hash": row_fingerprint(F.when(readable, F.col("invoice.sha256"))),
        "is_vision": F.coalesce(F.col("invoice.read_path") == "vision", F.lit(False)),
    })


def preparation_counts(settled: DataFrame, items: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """The counters of the preparation phase, one row. `errors` holds the rows that could not be prepared."""
    read_failed = (F.col("invoice_accessed") == "no") & (
        ((F.col("reference") == "url") & is_substantive_reference(F.col("invoice_url")))
        | ((F.col("reference") == "key") & is_substantive_reference(F.col("key")))
    ) & F.col("invoice").isNotNull()
    ref = F.col("reference")
    from_settled = settled.agg(
        F.count_if(F.col("rule") == "reclass").alias("reclass_fired"),
        F.count_if(F.col("rule") == "close").alias("closegl_fired"),
        F.count_if(F.col("rule") == "close_guard").alias("closegl_guard_trips"),
        F.count_if(F.col("rule") == "negative").alias("negatives_skipped"),
        F.count_if(F.col("had_invoice") == "yes").alias("settled_had"),
    )
    unread_url = (ref == "url") & (F.col("invoice_accessed") == "no") & F.col("invoice").isNotNull()
    from_items = items.agg(
        F.count(F.lit(1)).alias("to_classify"),
        F.count_if(F.col("had_invoice") == "yes").alias("item_had"),
        F.count_if(F.col("invoice_accessed") == "yes").alias("invoice_accessed_yes"),
        F.count_if(F.array_contains("flags", "invoice_unavailable")).alias("invoice_unavailable"),
        F.count_if(read_failed).alias("invoice_read_failed"),
        F.count_if((ref == "url") & (F.col("invoice_accessed") == "yes")).alias("url_fetched_ok"),
        F.count_if(unread_url).alias("url_fetch_failed"),
        F.count_if((ref == "key") & (F.col("status") == "resolved")).alias("local_resolved"),
        F.count_if((ref == "key") & (F.col("status") == "no_match")).alias("local_no_match"),
        F.count_if((ref == "key") & (F.col("status") == "ambiguous")).alias("ambiguous"),
    )
    parts = beside(from_settled, from_items)
    if errors is None:
        parts = parts.withColumn("errors", F.lit(0).cast("bigint"))
    else:
        parts = beside(parts, errors.agg(F.count(F.lit(1)).alias("errors")))
    return parts.select(
        "reclass_fired", "closegl_fired", "closegl_guard_trips", "negatives_skipped", "to_classify",
        (F.col("settled_had") + F.col("item_had")).alias("had_invoice_yes"), "invoice_accessed_yes",
        "invoice_unavailable", "invoice_read_failed", "url_fetched_ok", "url_fetch_failed", "local_resolved",
        "local_no_match", "ambiguous", "errors",
    )


def lookup_rate(counts: DataFrame) -> DataFrame:
    """Local lookups: resolved of attempted."""
    attempted = F.col("local_resolved") + F.col("local_no_match") + F.col("ambiguous")
    return counts.select(
        F.col("local_resolved").alias("resolved"), attempted.alias("attempted"),
        F.format_string("Local invoices: %d of %d resolved", F.col("local_resolved"), attempted).alias("banner"),
    )
