"""Page windows of a document: which pages to read, how the choice is written, what it left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .binding import bind

_BOUND = r"^\s*[+-]?[0-9]{1,9}\s*$"


def _bound(c: Column) -> Column:
    return F.when(c.rlike(_BOUND), F.trim(c).try_cast("int"))


def _split_range(part: Column) -> tuple[Column, Column]:
    """Both ends of `A-B`, split at the first dash; null ends when unreadable."""
    dash = F.instr(part, "-")
    left = F.when(dash > 0, F.substring(part, F.lit(1), dash - 1))
    right = F.when(dash > 0, F.substring(part, dash + 1, F.length(part)))
    return _bound(left), _bound(right)


def page_window(page_count: Column, hint: Column) -> Column:
    """struct(first, last): the hint clamped to the document, or the whole document when it does not fit."""
    low, high = _split_range(hint)
    first = F.greatest(F.lit(1), low)
    last = F.least(high, page_count)
    usable = low.isNotNull() & high.isNotNull() & (first <= page_count) & (first <= last)
    return F.when(usable, F.struct(first.alias("first"), last.alias("last"))).otherwise(
        F.struct(F.lit(1).alias("first"), page_count.alias("last"))
    )


def select_pages(
    page_count: Column, hint: Column, full_read: int | None = vocab.FULL_READ_PAGES, edges: int = vocab.EDGE_PAGES
) -> Column:
    """Page numbers to read: a window of up to `full_read` pages in full (None: any), a longer one by its first and last
    `edges`. The window itself is `page_window`."""

    def choose(window: Column) -> Column:
        first, last = window["first"], window["last"]
        whole = F.when(last < first, F.array().cast("array<int>"))
        if full_read is None:
            return whole.otherwise(F.sequence(first, last))
        ends = F.array_union(F.sequence(first, first + (edges - 1)), F.sequence(last - (edges - 1), last))
        return whole.when(last - first + 1 <= full_read, F.sequence(first, last)).otherwise(ends)

    return bind(page_window(page_count.cast("int"), hint), choose)


def format_pages(pages: Column) -> Column:
    """`1-2,24-25` for sorted page numbers; a lone page is written `7-7`."""

    def runs(listed: Column) -> Column:
        starts = F.filter(listed, lambda p: ~F.array_contains(listed, p - 1))
        ends = F.filter(listed, lambda p: ~F.array_contains(listed, p + 1))
        joined = F.zip_with(starts, ends, lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string")))
        return F.array_join(joined, ",")

    return bind(pages, runs)


def pages_read_count(pages_read: Column) -> Column:
    """Pages covered by `A-B,C-D`; null when absent, unreadable or when a part is empty or reversed."""

    def part_size(part: Column) -> Column:
        low, high = _split_range(part)
        return F.when(high >= low, high - low + 1)

    sizes = F.transform(F.split(pages_read, ","), part_size)
    total = F.aggregate(sizes, F.lit(0), lambda acc, n: acc + n)
    return F.when(F.coalesce(pages_read, F.lit("")) != "", total)


def has_gap(pages_read: Column) -> Column:
    """True when the pages read leave out a middle section."""

    def part_pages(part: Column) -> Column:
        low, high = _split_range(part)
        none = F.array().cast("array<int>")
        return F.when(low.isNull() | high.isNull(), None).when(high < low, none).otherwise(F.sequence(low, high))

    parts = F.transform(F.split(pages_read, ","), part_pages)
    spread = lambda pages: F.array_max(pages) - F.array_min(pages) + 1 > F.size(pages)
    gap = bind(F.array_distinct(F.flatten(parts)), spread)
    return F.coalesce(F.when(F.coalesce(pages_read, F.lit("")) != "", gap), F.lit(False))
