"""Invoice keys hidden in row text, and tests on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .binding import bind
from .cleaning import WHITESPACE

_PREFIX_WITH_REST = r"(?is)^.*?\bINV[\s#\-.:]*([A-Z0-9][A-Z0-9\-/]{3,})(.*)$"


def normalize_key(c: Column) -> Column:
    """Upper case, leading INV and its separators removed, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.upper(c), r"^INV[\s#\-.:]*", ""), "[^A-Z0-9]", "")


def is_rejected_token(token: Column) -> Column:
    """Dates and tokens without a digit are never keys."""
    return token.rlike(vocab.DATE_SHAPED_PATTERN) | ~token.rlike("[0-9]")


def _accepted(token: Column) -> Column:
    return F.when((token != "") & ~is_rejected_token(token), token)


def inv_prefix_token(text: Column) -> Column:
    """First `INV…` token; null when that first one is rejected, even if a later one would do."""
    return _accepted(F.regexp_extract(text, vocab.INV_PREFIX_PATTERN, 1))


def leading_token(text: Column) -> Column:
    """Code at the very start, padded by two or more blanks."""
    return _accepted(F.regexp_extract(text, vocab.LEADING_TOKEN_PATTERN, 1))


def _words(text: Column) -> Column:
    blanks = F.translate(text, WHITESPACE, " " * len(WHITESPACE))
    return F.filter(F.split(blanks, " +"), lambda w: w != "")


def standalone_word(text: Column) -> Column:
    """struct(token, at_end) of the first code-like word next to an alphabetic word, else null."""
    core = lambda w: F.btrim(w, F.lit(vocab.WORD_PUNCTUATION))

    def search(words: Column) -> Column:
        neighbour = lambda i: F.coalesce(core(F.get(words, i)), F.lit(""))

        def candidate(w: Column, i: Column) -> Column:
            token = core(w)
            beside_word = F.when(i > 0, neighbour(i - 1)).otherwise("").rlike(vocab.ALPHA_WORD_PATTERN) | neighbour(
                i + 1
            ).rlike(vocab.ALPHA_WORD_PATTERN)
            fits = token.rlike(vocab.STANDALONE_PATTERN) & ~is_rejected_token(token) & beside_word
            last = (i == F.size(words) - 1) & (token == w) & text.endswith(w)
            return F.when(fits, F.struct(token.alias("token"), last.alias("at_end")))

        return F.get(F.filter(F.transform(words, candidate), lambda s: s.isNotNull()), 0)

    return bind(_words(text), search)


def _prefix_reaches_end(text: Column) -> Column:
    return F.regexp_extract(text, _PREFIX_WITH_REST, 2) == ""


def scan_text(text: Column) -> Column:
    """struct(token, at_end): prefixed token, else leading token, else standalone word."""

    def choose(found: Column) -> Column:
        prefixed, leading = found["prefixed"], found["leading"]
        cut = (F.length(text) >= vocab.TRUNCATION_LENGTH) & _prefix_reaches_end(text)
        return (
            F.when(prefixed.isNotNull(), F.struct(prefixed.alias("token"), cut.alias("at_end")))
            .when(leading.isNotNull(), F.struct(leading.alias("token"), F.lit(False).alias("at_end")))
            .otherwise(standalone_word(text))
        )

    return bind(F.struct(inv_prefix_token(text).alias("prefixed"), leading_token(text).alias("leading")), choose)


def mine_invoice_key(descrptn: Column, adddesc: Column) -> Column:
    """struct(key, truncated). A key from `descrptn` is truncated when it ends a field of full length."""

    def from_first(first: Column) -> Column:
        cut = F.coalesce(first["at_end"], F.lit(False)) & (F.length(descrptn) >= vocab.TRUNCATION_LENGTH)
        token = F.coalesce(first["token"], scan_text(adddesc)["token"])
        return F.struct(normalize_key(token).alias("key"), F.coalesce(cut, F.lit(False)).alias("truncated"))

    return bind(scan_text(descrptn), from_first)


def is_substantive_reference(c: Column) -> Column:
    """At least four letters or digits; shorter references are noise."""
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) >= vocab.MIN_REFERENCE_CHARS
