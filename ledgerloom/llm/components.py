"""Connected components of a large graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """`node`, `component` for every node of `edges` (columns `a`, `b`): the smallest node it is connected with.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest of them, until only stars are
    left; it takes some rounds more when components are four times as deep. A round is two aggregations, combined before
    the shuffle, and two joins on the node, whose partitions adaptive execution may split around a hub. Rounds are written
    to the shared folder. Nodes of any type that has an order will do; null ends and loops are left out, and a node that
    occurs in loops alone has no row.
    """
    ends = edges.where("a is not null and b is not null and a <> b")
    stars = materialize(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _mark(stars)
    while before[0]:
        stars = materialize(_small(_large(stars)), "edges")
        after = _mark(stars)
        if after == before:
            break
        before = after
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges; one row reaches the driver."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("v", "u").cast("long"))).head())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
