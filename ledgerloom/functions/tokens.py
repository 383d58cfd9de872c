"""Token estimates, prices and model tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .binding import bind
from .pages import pages_read_count

_TEXT_FIELDS = (
    "period", "acctnum", "ref", "entityid", "department", "category", "currency", "descrptn", "adddesc", "source",
    "entrdate", "userid", "invoice_url",
)
_ALL_FIELDS = ("row_idx", "amount", "amount_was_blank", *_TEXT_FIELDS)
# One range: a class of several is tested range by range for every character, which took ten times as long.
_NOT_PLAIN = r"[^ -\x7f]"
_TWO_CHAR_ESCAPES = '"\\\n\r\t\b\f'


def _extra_chars(c: Column) -> Column:
    """What escaping adds to the length of a string as an ASCII JSON literal."""
    escapes = F.length(c) - F.length(F.translate(c, _TWO_CHAR_ESCAPES, ""))
    controls = F.length(F.regexp_replace(c, r"[^\x00-\x07\x0b\x0e-\x1f]", ""))
    wide = F.length(F.regexp_replace(c, r"[\x00-\x7f]", ""))
    astral = F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10ffff}]", ""))
    return escapes + controls * 5 + wide * 5 + astral * 6


def _needs_escape(c: Column) -> Column:
    """Whether a text holds a character that an ASCII JSON literal writes otherwise."""
    return c.rlike(_NOT_PLAIN) | c.contains('"') | c.contains("\\")


def json_text_length(c: Column) -> Column:
    """Length of a string as an ASCII JSON literal (`null` counts 4). Plain text takes one look."""
    extra = F.when(_needs_escape(c), _extra_chars(c)).otherwise(0)
    return F.when(c.isNull(), 4).otherwise(F.length(c) + 2 + extra)


def number_text(c: Column) -> Column:
    """Plain decimal text with at least one decimal, at most six."""
    digits = F.regexp_replace(c.cast("decimal(38,6)").cast("string"), "0+$", "")
    return F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)


def estimate_row_tokens(row: dict[str, Column] | None = None) -> Column:
    """Characters of the row's JSON text by four, plus a fixed overhead."""
    field = row or {name: F.col(name) for name in _ALL_FIELDS}
    # {"name": value, ...}: braces, and per field the quoted name, colon, comma and blanks.
    frame = 2 + sum(len(name) + 4 for name in _ALL_FIELDS) + 2 * (len(_ALL_FIELDS) - 1)
    length = (
        F.lit(frame)
        + F.length(field["row_idx"].cast("string"))
        + F.length(number_text(field["amount"]))
        + F.when(field["amount_was_blank"], 4).otherwise(5)
    )
    # Escaping adds per character, so it can be counted over all texts together.
    texts = F.concat_ws("", *[field[name] for name in _TEXT_FIELDS])
    length = length + bind(texts, lambda t: F.length(t) + F.when(_needs_escape(t), _extra_chars(t)).otherwise(0))
    for name in _TEXT_FIELDS:
        length = length + F.when(field[name].isNull(), 4).otherwise(2)
    return (F.floor(length / vocab.CHARS_PER_TOKEN) + vocab.ROW_OVERHEAD_TOKENS).cast("bigint")


def text_tokens(c: Column) -> Column:
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / vocab.CHARS_PER_TOKEN).cast("bigint")


def low_end_tokens(est: Column, invoice: Column) -> Column:
    """Low end of an item's estimate: text documents are exact, page images swap the high page rate for the low."""
    fallback = F.floor(est * 0.75).cast("bigint")
    base = F.greatest(est - F.coalesce(invoice["est_input_tokens"], F.lit(0)), F.lit(0))
    pages = pages_read_count(invoice["pages_read"])
    text = F.coalesce(invoice["text_tokens"], text_tokens(invoice["text"]))
    return (
        F.when(invoice.isNull() | ~F.coalesce(invoice["kind"].isin(*vocab.READABLE_KINDS), F.lit(False)), est)
        .when(invoice["read_path"] == "text", base + text)
        .when((invoice["read_path"] == "vision") & pages.isNotNull(), base + pages * vocab.PAGE_TOKENS_LOW + text)
        .otherwise(fallback)
    ).cast("bigint")


def _price(model: Column, at: int) -> Column:
    chosen = None
    for name, *prices in vocab.PRICES:
        test = model.contains(name)
        value = F.lit(prices[at])
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    return chosen.otherwise(F.lit(vocab.DEFAULT_PRICE[at]))


def input_price(model: Column) -> Column:
    """USD per million input tokens; the first table name contained in `model` wins."""
    return _price(model, 0)


def output_price(model: Column) -> Column:
    return _price(model, 1)


def cost_micros(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Exact cost in millionths of a USD: tokens times USD per million tokens."""
    price = lambda p: p(model).cast("decimal(6,2)")
    tokens = lambda t: F.coalesce(t, F.lit(0)).cast("decimal(20,0)")
    total = tokens(input_tokens) * price(input_price) + tokens(output_tokens) * price(output_price)
    return F.when(model.isNull(), F.lit(0)).otherwise(total).cast("decimal(30,2)")


def model_for(has_readable_invoice: Column, floor_model: str = vocab.FLOOR_MODEL) -> Column:
    return F.when(has_readable_invoice, vocab.INVOICE_MODEL).otherwise(floor_model)
