"""Cell cleaning: text, ids, dates, amounts, currency.

`vtype` tells how the cell was typed at the source: 'n' number, 's' text, 'd' date or timestamp (ISO text), 'b'
boolean. A wide text ledger passes `vtype='s'` throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab

# Every code point that Unicode treats as white space.
WHITESPACE = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
              0x202F, 0x205F, 0x3000]
)
# Digits may be grouped by single underscores.
_DIGITS = "[0-9]+(_[0-9]+)*"
_NUMBER = rf"^[+-]?({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"


def strip(c: Column) -> Column:
    """Trim all Unicode white space (Spark's `trim` knows the blank only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def _type(vtype: Column | str | None) -> Column:
    return F.lit(vtype) if vtype is None or isinstance(vtype, str) else vtype


def _null_word(c: Column) -> Column:
    return F.upper(c).isin(*vocab.NULL_WORDS)


def clean_text(c: Column) -> Column:
    """Drop `#NAME?`, trim; null for empty text and for the word NULL."""
    text = strip(F.replace(c, F.lit("#NAME?"), F.lit("")))
    return F.when(~_null_word(text), text)


def whole_number_text(c: Column, vtype: Column | str = "s") -> Column:
    """A numeric cell such as 123.0 reads as 123."""
    return F.when(_type(vtype) == "n", F.regexp_replace(c, r"^(-?[0-9]+)\.0+$", "$1")).otherwise(c)


def clean_id(c: Column, vtype: Column | str = "s") -> Column:
    text = strip(whole_number_text(c, vtype))
    return F.when(~_null_word(text), text)


def serial_to_iso(c: Column) -> Column:
    """Spreadsheet day number to ISO date; null outside the plausible range."""
    number = F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double")
    day = F.date_add(F.lit(vocab.SERIAL_EPOCH).cast("date"), F.floor(number).cast("int"))
    return F.when(number.between(vocab.SERIAL_MIN, vocab.SERIAL_MAX), day.cast("string"))


def clean_date(c: Column, vtype: Column | str = "s") -> Column:
    """ISO date for dates and day numbers; other text is kept as it is."""
    kind = _type(vtype)
    text = strip(c)
    kept = F.when(~_null_word(text), text)
    return (
        F.when(kind == "d", F.substring(c, 1, 10))
        .when(kind == "n", F.coalesce(serial_to_iso(c), kept))
        .otherwise(kept)
    )


def raw_date(c: Column, vtype: Column | str = "s") -> Column:
    """Date columns of the verbatim scan: only typed dates and day numbers change."""
    kind = _type(vtype)
    return F.when(kind == "d", F.substring(c, 1, 10)).when(kind == "n", F.coalesce(serial_to_iso(c), c)).otherwise(c)


def _amount_or_null(c: Column, vtype: Column | str) -> Column:
    kind = _type(vtype)
    text = strip(c)
    bracketed = text.startswith("(") & text.endswith(")") & (F.length(text) >= 2)
    inner = F.when(bracketed, strip(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)
    plain = strip(F.translate(inner, "$,", ""))
    number = F.when(plain.rlike(_NUMBER), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))
    signed = F.when(bracketed, -number).otherwise(number)
    return F.when(kind == "n", c.try_cast("double")).when(kind == "b", F.lit(None)).otherwise(signed)


def parse_amount(c: Column, vtype: Column | str = "s") -> Column:
    """0.0 when blank or unreadable; `(x)` is negative; `$`, thousands commas and underscores between digits are ignored.

    `nan` and `inf` are unreadable: no later sum could bear them.
    """
    return F.coalesce(_amount_or_null(c, vtype), F.lit(0.0))


def amount_was_blank(c: Column, vtype: Column | str = "s") -> Column:
    return _amount_or_null(c, vtype).isNull()


def clean_currency(c: Column) -> Column:
    return F.upper(F.coalesce(clean_text(c), F.lit("UNKNOWN")))


def none_if_blank(c: Column) -> Column:
    return F.when(strip(c) != "", c)
