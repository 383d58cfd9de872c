"""Joins that stay balanced when a third of the rows share one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64
#: A side of a join is broadcast only when a written table holds at most this many short rows.
BROADCAST_ROWS = 1_000_000


def lookup_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], spread: str, how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Join `rows` to `lookup`, which holds at most one row per key.

    Catalyst broadcasts the lookup if it is below the session's threshold. Otherwise both sides shuffle on the key, and
    adaptive execution splits a partition that a hot key has swollen: the lookup side is unique, so only `rows` can be
    skewed, and an outer join allows that side to be split. Rows without a key match nothing; they are spread over
    `salts` tasks instead of meeting in one partition. With a key, the salt is made from it on both sides: a constant
    would be no key of the shuffle. `salts=0` is for rows that all have a key: a lookup that was just folded by the key then
    stays where it is.
    """
    if how == "inner" or not salts:
        return rows.join(lookup, keys, how)
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    own = F.pmod(F.xxhash64(*[F.col(key).cast("string") for key in keys]), F.lit(salts)).cast("int")
    left = rows.withColumn("_salt", F.when(missing, salt).otherwise(own))
    return left.join(lookup.withColumn("_salt", own), [*keys, "_salt"], how).drop("_salt")


def beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Frames of exactly one row each, side by side: the others become scalar subqueries of the first."""
    out = first
    for number, other in enumerate(others):
        held = f"_row{number}"
        scalar = other.select(F.struct(*other.columns)).scalar().alias(held)
        out = out.select("*", scalar).select(*out.columns, f"{held}.*")
    return out


def counted_side(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`table`, a written one of short rows, marked for broadcast if it has no more than `rows`."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table
