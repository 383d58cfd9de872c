"""N-gram Jaccard self-join with parity sketches.

Two sets link when their Jaccard similarity is at least num / den. Then their symmetric difference is at most
(den - num) / (den + num) of the sum of their sizes: D. A set is sketched by XOR: each shingle toggles the 64-bit pattern
of its hash in one of P > D blocks, so two sets that link differ in at most D blocks and have a block in common
(pigeonhole). Sizes fall into bands; P depends on the band of the larger set, and a set that may link with larger ones
takes part in the next band too. A second sketch of 512 single bits bounds the symmetric difference from below by its
Hamming distance and dismisses most chance meetings before any set is compared. Sets of more shingles than it has bits
fill it whatever they hold, so they have a third sketch with a bit or two for each shingle, which pairs that are left meet
before their sets do.

All sets that share a block are first compared with the smallest id among them, and links make components. Only where a
block's sets are still in different components are pairs across components looked at; of these only those are emitted whose
sketches allow a link, each at one of the blocks it shares (the first of those that are among the least keys of both sets,
or all where there is none). So every pair that could link is either joined through others or compared itself, and pairs
within a component are never made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize, release, scratch_paths
from .common import BATCH_ROWS, LOWER, hash_words, mix, shingles, small_side
from .components import components

SHINGLE, NUM, DEN = 5, 8, 10

#: 64-bit words of the single-bit sketch, and how many of its least keys a set is asked for to tell a pair's first block.
SKETCH, LEAST = 8, 4


@dataclass(frozen=True)
class Bands:
    """Size bands for a threshold: band g has sizes from starts[g] to before starts[g + 1]."""

    num: int
    den: int

    @property
    def ratio(self) -> float:
        return max(1.4, 1.2 * self.den / self.num)

    def starts(self, largest: int) -> np.ndarray:
        out = [1]
        while out[-1] <= largest:
            out.append(max(out[-1] + 1, int(np.ceil(out[-1] * self.ratio))))
        return np.array(out, np.int64)

    def differing(self, size: int) -> int:
        """Largest symmetric difference of two linking sets whose sizes add up to `size`."""
        return (self.den - self.num) * size // (self.den + self.num)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """The join keys of a set: one per occupied block of each band it takes part in."""
        n = len(hashes)
        starts = self.starts(n)
        own = len(starts) - 2
        after = max(starts[-1] + 1, int(np.ceil(starts[-1] * self.ratio)))
        parts = [self._blocks(hashes, own, int(starts[-1]) - 1)]
        if n * self.den >= starts[-1] * self.num:  # it may link with a set of the next band
            parts.append(self._blocks(hashes, own + 1, int(after) - 1))
        return np.concatenate(parts)

    def _blocks(self, hashes: np.ndarray, band: int, largest: int) -> np.ndarray:
        differ = self.differing(2 * largest)
        # A quarter more than pigeonhole needs: then more than `differ` are occupied, and empty ones, alike in all, are no keys.
        blocks = differ + 1 + -(-differ // 4)
        place = (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        first = np.flatnonzero(np.diff(place[order], prepend=-1))
        taken = place[order][first]
        value = np.bitwise_xor.reduceat(hashes[order], first)
        if len(taken) <= differ:  # the common block may be an empty one
            full = np.zeros(blocks, np.uint64)
            full[taken] = value
            taken, value = np.arange(blocks), full
        return mix(mix(value) + mix(np.uint64(band << 32) + taken.astype(np.uint64)))


def _set(text: str | None, size: int) -> np.ndarray:
    return shingles(hash_words((text or "").encode().translate(LOWER))[0], size)


def _per_row(docs: DataFrame, size: int, schema: str, make) -> DataFrame:
    """Rows made from the set of each document; `make` gets ids and sets and returns the arrays of a batch."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                sets = [_set(t, size) for t in batch.column(1).to_pylist()]
                names, arrays = make(batch.column(0).to_numpy(zero_copy_only=False), sets)
                yield pa.RecordBatch.from_arrays([pa.array(a) if not isinstance(a, pa.Array) else a for a in arrays], names)
        pa.default_memory_pool().release_unused()  # the worker goes on with other tasks

    return docs.mapInArrow(run, schema)


def _wide(own: np.ndarray) -> np.ndarray:
    """A single-bit sketch of the next power of two of bits; none for sets that the sketch of all sets has bits enough for.

    The sketch of half as many bits is the XOR of its halves.
    """
    if len(own) <= 64 * SKETCH:
        return np.empty(0, np.uint64)
    top = 1 << (len(own) - 1).bit_length()
    bits = np.bincount((own & np.uint64(top - 1)).astype(np.int64), minlength=top) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def _profile(bands: Bands):
    """Per document: the size of its set, a digest of it, its single-bit sketches, its least join keys and all of them."""

    def make(ids: np.ndarray, sets: list[np.ndarray]) -> tuple[list[str], list]:
        top = 64 * SKETCH
        bits = np.array([np.bincount((s & np.uint64(top - 1)).astype(np.int64), minlength=top) & 1 for s in sets])
        words = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64) if len(sets) else np.zeros((0, SKETCH), np.int64)
        sizes = np.array([len(s) for s in sets], np.int64)
        digests = [np.array([mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64) for salt in (1, 2)]
        keys = [bands.keys(s) if len(s) else s for s in sets]
        return (
            ["id", "n", "d1", "d2", *[f"s{k}" for k in range(SKETCH)], "wide", "least", "keys"],
            [ids, sizes, *[d.view(np.int64) for d in digests], *[np.ascontiguousarray(words[:, k]) for k in range(SKETCH)],
             _lists([_wide(s) for s in sets]), _lists([np.sort(k.view(np.int64))[:LEAST] for k in keys]), _lists(keys)],
        )

    return make


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0] + [len(a) for a in arrays])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))


def _near(a: str, b: str, num: int, den: int) -> Column:
    """Whether sizes and sketches of two profiles leave a link possible."""
    distance = sum((F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(SKETCH)), F.lit(0))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (
        (F.least(n, m) * den >= F.greatest(n, m) * num)
        & (distance * (den + num) <= (n + m) * (den - num))
    )


def link_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, num: int = NUM, den: int = DEN
) -> DataFrame:
    """`id`, `n_shingles`, `component_id` for every row: the set size, and the smallest id reachable by links.

    Words are cut at ASCII blanks after A-Z are lower-cased; a set has the distinct runs of `size` words, or the whole
    sequence if it has fewer words. Null and empty texts have no set and link with nothing. Rows with one id are one
    document; a null id links with nothing and has no component. Shingles are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    words = ", ".join(f"s{k} long" for k in range(SKETCH))
    bands = Bands(num, den)
    schema = f"id long, n long, d1 long, d2 long, {words}, wide array<long>, least array<long>, keys array<long>"
    keyed, place = _scratch(_per_row(rows, size, schema, _profile(bands)), "keys")
    profile = materialize(keyed.drop("keys"), "profiles")
    met = _met(keyed.where("id is not null and n > 0").select(F.explode("keys").alias("key"), "id"))
    release(spark, [place])
    labels = components(_links(rows.where("id is not null and text is not null"), profile, met, size, bands))
    return profile.select("id", F.col("n").alias("n_shingles")).join(
        labels, F.col("id") == F.col("node"), "left"
    ).select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def _scratch(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """A written table, and its path for `release` once its last reader is written."""
    table = materialize(df, label)
    return table, scratch_paths()[-1]


def _met(blocks: DataFrame) -> DataFrame:
    """The rows (key, id) whose key several ids have, with the smallest of them as `first`.

    Rows are sorted by key and id over all tasks, so the rows of a key follow each other, over the border of a task too if
    they are many. A task walks along its rows and leaves out keys with one row; only of its first and last key it cannot
    tell, and these, two for each task, are put together afterwards.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] | None = None
        border = True

        def runs(key: np.ndarray, ident: np.ndarray, border: bool, last: bool) -> pa.RecordBatch:
            start = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else np.empty(0, np.int64)
            size = np.diff(np.append(start, len(key)))
            of = np.repeat(np.arange(len(start)), size)
            edge = np.zeros(len(start), bool)
            if len(start):
                edge[0] |= border
                edge[-1] |= last
            several = edge | (ident[start] < ident[start + size - 1])
            kept = several[of]
            return pa.RecordBatch.from_arrays(
                [pa.array(x[kept]) for x in (key, ident, ident[start][of], edge[of])], ["key", "id", "first", "edge"]
            )

        for batch in batches:
            key, ident = (batch.column(k).to_numpy() for k in (0, 1))
            if held is not None:
                key, ident = np.concatenate([held[0], key]), np.concatenate([held[1], ident])
            if not len(key):
                continue
            if key[0] == key[-1] and border:  # the first key of the task goes on
                yield runs(key, ident, True, True)
                held = None
                continue
            if key[0] == key[-1]:
                held = key, ident
                continue
            cut = int(np.searchsorted(key, key[-1]))
            yield runs(key[:cut], ident[:cut], border, False)
            border = False
            held = key[cut:], ident[cut:]
        if held is not None:
            yield runs(*held, border, True)

    order = ["key", "id"]
    walked, place = _scratch(
        blocks.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
            walk, "key long, id long, first long, edge boolean"
        ), "walked-blocks",
    )
    edges = walked.where("edge").groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    over = walked.where("edge").drop("first", "edge").join(F.broadcast(edges.drop("last")), "key")  # two keys a task at most
    met = materialize(walked.where("not edge").drop("edge").unionByName(over), "blocks")
    release(blocks.sparkSession, [place])
    return met


def _links(rows: DataFrame, profile: DataFrame, met: DataFrame, size: int, bands: Bands) -> DataFrame:
    """Links (a, b) that connect what all links connect."""
    spark = rows.sparkSession
    num, den = bands.num, bands.den
    known = profile.where("id is not null and n > 0")
    facts = F.struct("n", "d1", "d2", *[f"s{k}" for k in range(SKETCH)])
    look = known.select("id", facts.alias("p")).distinct()
    one, two = look.withColumnRenamed("id", "a"), look.withColumnsRenamed({"id": "b", "p": "q"})
    first = met.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    links = _verified(rows, known, first.join(one, "a").join(two, "b"), size, num, den)
    # Blocks whose sets are in several components: each pair across components, at one of the blocks it shares.
    placed = met.select("key", "id").join(components(links), F.col("id") == F.col("node"), "left").select(
        "key", "id", F.coalesce("component", "id").alias("c")
    )
    several = placed.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("key")
    least = known.select("id", facts.alias("p"), "least").distinct()
    left, place = _scratch(placed.join(several, "key").join(least, "id"), "open-blocks")
    other = left.select("key", F.col("id").alias("b"), F.col("c").alias("d"), F.col("p").alias("q"), F.col("least").alias("other"))
    both = F.array_intersect("least", "other")
    once = (F.size(both) == 0) | (F.col("key") == F.array_min(both))
    rest = left.withColumnRenamed("id", "a").join(other, "key").where((F.col("c") < F.col("d")) & once)
    more = _verified(rows, known, rest, size, num, den)
    release(spark, [place])
    return links.unionByName(more)


def _within(pairs: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose wide sketches leave a link possible, or which have none; a pair may come several times."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(k).to_numpy() for k in range(4))
            (x, y), most = (_slices(batch.column(k)) for k in (4, 5)), (n + m) * (den - num)
            kept = [_distance(x(k), y(k)) * (den + num) <= most[k] for k in range(len(a))]
            yield pa.RecordBatch.from_arrays([pa.array(v[np.array(kept, bool)]) for v in (a, b)], ["a", "b"])

    wide = known.select("id", "n", "wide").distinct()
    both = pairs.join(wide.withColumnsRenamed({"id": "a", "wide": "x"}), "a").join(
        wide.withColumnsRenamed({"id": "b", "n": "m", "wide": "y"}), "b"
    )
    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(compare, "a long, b long")


def _slices(lists: pa.ListArray):
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    return lambda k: flat[at[k] : at[k + 1]]


def _distance(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two wide sketches differ, the longer one folded to the shorter; 0 where there is none."""
    if not len(x) or not len(y):
        return 0
    x, y = sorted((x, y), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())  # of signed numbers it counts the absolute value's


def _verified(rows: DataFrame, known: DataFrame, pairs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b), with their profiles p and q, that link.

    Sizes and sketches dismiss pairs; sets of one digest are equal; the others are compared, for which only documents that
    occur in such pairs are looked up. A set goes along with each pair it is in, so that long sets that meet by chance must
    be dismissed before: `known` has their wide sketches, of a sixty-fourth of the size or two.
    """
    spark = rows.sparkSession
    equal = F.col("p.d1").eqNullSafe(F.col("q.d1")) & (F.col("p.d2") == F.col("q.d2")) & (F.col("p.n") == F.col("q.n"))
    near, first = _scratch(
        pairs.where(_near("p", "q", num, den)).select("a", "b", equal.alias("equal")).distinct(), "pairs"
    )
    pairs, third = _scratch(_within(near.where("not equal").select("a", "b"), known, num, den).distinct(), "close-pairs")
    wanted, second = _scratch(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "candidates")

    def sets(ids: np.ndarray, own: list[np.ndarray]) -> tuple[list[str], list]:
        return ["id", "set"], [ids, _lists(own)]

    found = rows.join(small_side(wanted), "id", "left_semi")
    own = _per_row(found, size, "id long, set array<long>", sets)
    both = pairs.join(own.withColumnsRenamed({"id": "a", "set": "x"}), "a").join(
        own.withColumnsRenamed({"id": "b", "set": "y"}), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    compared = both.where(common * den >= union * num).select("a", "b")
    links = materialize(near.where("equal").select("a", "b").unionByName(compared).distinct(), "links")
    release(spark, [first, second, third])
    return links
