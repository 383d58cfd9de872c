"""Hard negatives from embeddings, over blocks along a Hilbert curve.

Rows are sorted by label and by their place on a Hilbert curve through the dimensions that spread most, and written as
Parquet blocks of a few hundred rows, each with a zone map: the least and the greatest value of every dimension, and of the
label. Interval arithmetic on a zone map bounds the score that any row of the block can have with an anchor. So, for each
anchor, only blocks are read that may still hold one of its positives or a row of one of its score windows; what a block's
own rows score with the anchors among them gives the first floor. Anchors are taken in slices of fixed size along the curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import materialize, scratch_path

#: Rows of a block, rows of a directory of blocks, and anchors that are sent to the tasks at a time.
BLOCK_ROWS, PART_ROWS, SLICE_ANCHORS = 512, 1 << 15, 1 << 14
#: Dimensions and bits of each that the curve goes through.
CURVE_DIMS, CURVE_BITS = 15, 4

_NO_FLOOR = np.iinfo(np.int64).min


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cell numbers (below 2 ** bits), by way of its transposed form."""
    x = cells.astype(np.uint64).copy()
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for d in range(dims):  # mirror or swap the parts of the cube that this bit chooses
            chosen = (x[:, d] & bit) != 0
            swap = np.where(chosen, np.uint64(0), (x[:, 0] ^ x[:, d]) & below)
            x[:, 0] ^= np.where(chosen, below, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] & np.uint64(1 << level)) != 0, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn[:, None]
    out = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = out << 1 | ((x[:, d] >> np.uint64(level)) & np.uint64(1)).astype(np.int64)
    return out


@dataclass(frozen=True)
class Space:
    """What is known of all rows: number, width, and of each dimension the least, greatest and how widely it spreads."""

    rows: int
    low: np.ndarray
    high: np.ndarray
    spread: np.ndarray

    @property
    def width(self) -> int:
        return len(self.low)

    @property
    def kind(self) -> type:
        """Numbers in which all scores are exact and products are fast."""
        largest = max((max(abs(int(a)), abs(int(b))) for a, b in zip(self.low, self.high, strict=True)), default=0)
        bound = largest * largest * max(self.width, 1)
        if bound >= 1 << 63:
            raise ValueError("the products of these vectors may not fit into 64 bits")
        return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64

    def curve(self, values: np.ndarray) -> np.ndarray:
        dims = np.argsort(-self.spread, kind="stable")[:CURVE_DIMS]
        if not len(dims):
            return np.zeros(len(values), np.int64)
        low, wide = self.low[dims].astype(float), (self.high[dims] - self.low[dims]).astype(float) + 1
        cells = (values[:, dims] - low) / wide * (1 << CURVE_BITS)
        return hilbert(np.clip(cells, 0, (1 << CURVE_BITS) - 1), CURVE_BITS)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _measure(rows: DataFrame) -> Space:
    """One row per dimension reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            width = int(sizes.max(initial=0))
            x = _matrix(column, width)
            y = x.astype(float)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(-1, width)), pa.array(np.append(0, x.min(0, initial=0))), pa.array(np.append(0, x.max(0, initial=0))),
                pa.array(np.append(0, y.sum(0))), pa.array(np.append(0, (y * y).sum(0))), pa.array(np.full(width + 1, len(x))),
            ], ["dim", "low", "high", "s", "q", "n"])

    found = rows.select("v").mapInArrow(run, "dim long, low long, high long, s double, q double, n long").groupBy("dim").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n")
    ).orderBy("dim").toArrow()
    n = found["n"].to_numpy()
    low, high = found["low"].to_numpy()[1:], found["high"].to_numpy()[1:]
    spread = found["q"].to_numpy()[1:] / n[0] - (found["s"].to_numpy()[1:] / n[0]) ** 2 if len(n) else np.empty(0)
    # Zero is within low and high, because shorter vectors end in zeros.
    return Space(int(n[0]) if len(n) else 0, low, high, np.round(spread, 6))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T).astype(np.int64)


class Best:
    """The greatest scores of each slot, ties by the smaller id, as blocks offer them."""

    def __init__(self, slots: int, size: int, floor: np.ndarray) -> None:
        self.size, self.floor = size, floor.copy()
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.held = np.zeros(slots, np.int64)

    def offer(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ident = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ident)))
        order = np.lexsort((ident, -score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        kept = rank < self.size
        self.slot, self.score, self.id = slot[kept], score[kept], ident[kept]
        full = rank == self.size - 1
        self.floor[slot[full]] = np.maximum(self.floor[slot[full]], score[full])


@dataclass(frozen=True)
class Anchors:
    """A slice of anchors as the tasks get it."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    floors: np.ndarray

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score with any vector between `low` and `high`."""
        wide = np.int64 if self.values.dtype == np.int64 else np.float64
        up, down = np.maximum(self.values, 0).astype(wide), np.minimum(self.values, 0).astype(wide)
        low, high = low.astype(wide), high.astype(wide)
        return up @ low + down @ high, up @ high + down @ low


def _usable(rows: DataFrame, key: str, label: str, vector: str, anchor: Column, scale: int) -> DataFrame:
    """id, label, whether an anchor, and the whole-numbered vector of rows that take part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    found = rows.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        x.alias("v"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
    return found.withColumn("v", F.transform("v", lambda c: F.floor(c * scale).cast("long")))


_BLOCK = (
    "part int, block long, n int, label_low long, label_high long, low array<long>, high array<long>, n_anchors int, "
    "ids binary, labels binary, data binary, anchors binary, floors binary"
)


def _blocks(rows: DataFrame, space: Space, positives: int) -> DataFrame:
    """The blocks, in directories of neighbouring ones, in the shared folder."""
    spark = rows.sparkSession

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            curve = space.curve(_matrix(batch.column(3), space.width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(curve)], ["id", "label", "anchor", "v", "curve"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        held: tuple | None = None

        def taken(rest: tuple, last: bool) -> Iterator[tuple]:
            at, size = 0, len(rest[0])
            while size - at >= BLOCK_ROWS or (last and at < size):
                yield tuple(x[at : at + BLOCK_ROWS] for x in rest)
                at += BLOCK_ROWS
            nonlocal held
            held = tuple(x[at:] for x in rest) if at < size else None

        def block(ids, labels, anchor, values) -> pa.RecordBatch:
            nonlocal serial
            own = _floors(ids, labels, values, np.flatnonzero(anchor), positives, space.kind)
            columns = [
                [part], [part << 32 | serial], [len(ids)], [labels.min()], [labels.max()], [values.min(0)], [values.max(0)],
                [int(anchor.sum())], [ids.tobytes()], [labels.tobytes()], [values.astype(_stored(space)).tobytes()],
                [np.flatnonzero(anchor).astype(np.int32).tobytes()], [own.tobytes()],
            ]
            serial += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], _NAMES)

        before = None
        for batch in batches:
            ids, labels = (batch.column(k).to_numpy() for k in (0, 1))
            rest = ids, labels, batch.column(2).to_numpy(zero_copy_only=False), _matrix(batch.column(3), space.width)
            rows_of = np.concatenate([ids[:, None], labels[:, None], rest[3]], 1)  # equal rows are neighbours
            shifted = np.concatenate([rows_of[:1] - 1 if before is None else before, rows_of[:-1]])
            new = (rows_of != shifted).any(1)
            before = rows_of[-1:] if len(rows_of) else before
            rest = tuple(x[new] for x in rest)
            if held is not None:
                rest = tuple(np.concatenate(x) for x in zip(held, rest, strict=True))
            for one in taken(rest, False):
                yield block(*one)
        if held is not None:
            for one in taken(held, True):
                yield block(*one)

    parts = max(spark.sparkContext.defaultParallelism, -(-space.rows // PART_ROWS))
    order = ["label", "curve", "id"]
    whole = rows.mapInArrow(placed, "id long, label long, anchor boolean, v array<long>, curve long")
    dealt = whole.repartitionByRange(parts, *order).sortWithinPartitions(*order, "v", F.desc("anchor"))
    path = scratch_path(spark, "vector-blocks")
    dealt.mapInArrow(packed, _BLOCK).write.partitionBy("part").parquet(path)
    return spark.read.schema(_BLOCK).parquet(path)


_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]
_KINDS = [
    {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}[c.split()[1]]
    for c in _BLOCK.split(", ")
]


def _stored(space: Space) -> type:
    largest = max(abs(int(space.low.min(initial=0))), abs(int(space.high.max(initial=0))))
    return np.int16 if largest < 1 << 15 else np.int32 if largest < 1 << 31 else np.int64


def _floors(ids: np.ndarray, labels: np.ndarray, values: np.ndarray, at: np.ndarray, size: int, kind: type) -> np.ndarray:
    """What each anchor of a block has at least as its last positive: the score that enough rows of the block reach."""
    score = _scores(values[at].astype(kind), values.astype(kind))
    score[(labels[at, None] != labels) | (ids[at, None] == ids)] = _NO_FLOOR
    if score.shape[1] < size or not len(at):
        return np.full(len(at), _NO_FLOOR)
    return np.partition(score, score.shape[1] - size, axis=1)[:, score.shape[1] - size]


def _slices(blocks: DataFrame, space: Space) -> Iterator[Anchors]:
    """The anchors in slices along the curve; the driver holds one slice and the number of anchors of each directory."""
    found = blocks.where("n_anchors > 0")
    counts = sorted((r["part"], r["a"], r["b"]) for r in found.groupBy("part").agg(
        F.sum("n_anchors").alias("a"), F.max("block").alias("b")
    ).toLocalIterator())
    runs: list[tuple[int, int]] = []  # of block numbers
    size = 0
    for part, n, last in counts:
        if runs and size + n <= SLICE_ANCHORS:
            runs[-1] = runs[-1][0], last + 1
            size += n
        else:  # a directory has a bounded number of rows, so also of anchors
            runs.append((part << 32, last + 1))
            size = n
    for start, end in runs:
        rows = found.where(F.col("block").between(start, end - 1)).select(
            "n", "ids", "labels", "data", "anchors", "floors"
        ).toArrow().to_pylist()
        out: list[list] = [[], [], [], []]
        for r in rows:
            at = np.frombuffer(r["anchors"], np.int32)
            out[0].append(np.frombuffer(r["ids"], np.int64)[at])
            out[1].append(np.frombuffer(r["labels"], np.int64)[at])
            out[2].append(np.frombuffer(r["data"], _stored(space)).reshape(r["n"], space.width)[at].astype(space.kind))
            out[3].append(np.frombuffer(r["floors"], np.int64))
        yield Anchors(*(np.concatenate(x) for x in out))


@dataclass(frozen=True)
class Search:
    """For each anchor, slots of score windows; a row counts in a slot if its label is the anchor's, or is another one."""

    anchors: Anchors
    same: bool
    size: int
    low: np.ndarray  # anchors x slots
    high: np.ndarray

    def wanted(self, label_low: int, label_high: int, low: np.ndarray, high: np.ndarray, floor: np.ndarray | None = None) -> np.ndarray:
        """Which anchors must read a block with this zone map."""
        labels = self.anchors.labels
        if self.same:
            fits = (labels >= label_low) & (labels <= label_high)
        else:
            fits = ~((labels == label_low) & (label_low == label_high))
        if not fits.any():
            return fits
        least, most = self.anchors.bounds(low, high)
        floor = self.low if floor is None else np.maximum(self.low, floor.reshape(self.low.shape))
        return fits & ((most[:, None] >= floor) & (least[:, None] <= self.high)).any(1)

    def run(self, blocks: DataFrame, space: Space) -> DataFrame:
        """`anchor`, `slot`, `rank`, `id`, `score`: the best rows of each slot; anchors are numbered within the slice."""
        spark = blocks.sparkSession
        shared = spark.sparkContext.broadcast(self)
        stored, kind = _stored(space), space.kind

        def zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = shared.value
            for batch in batches:
                hit = {
                    r["part"] for r in batch.to_pylist()
                    if search.wanted(r["label_low"], r["label_high"], np.array(r["low"], np.int64), np.array(r["high"], np.int64)).any()
                }
                yield pa.RecordBatch.from_arrays([pa.array(sorted(hit), pa.int32())], ["part"])

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = shared.value
            slots = search.low.shape[1]
            best = Best(search.low.size, search.size, search.low.ravel())
            for batch in batches:
                for r in batch.to_pylist():
                    low, high = np.array(r["low"], np.int64), np.array(r["high"], np.int64)
                    at = np.flatnonzero(search.wanted(r["label_low"], r["label_high"], low, high, best.floor))
                    if not len(at):
                        continue
                    ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
                    values = np.frombuffer(r["data"], stored).reshape(r["n"], space.width).astype(kind)
                    score = _scores(search.anchors.values[at], values)
                    equal = search.anchors.labels[at, None] == labels
                    other = equal & (search.anchors.ids[at, None] != ids) if search.same else ~equal
                    for s in range(slots):
                        floor = best.floor[at * slots + s]
                        row, column = np.nonzero(other & (score >= floor[:, None]) & (score <= search.high[at, s][:, None]))
                        best.offer(at[row] * slots + s, score[row, column], ids[column])
            yield pa.RecordBatch.from_arrays(
                [pa.array((best.slot // slots).astype(np.int32)), pa.array((best.slot % slots).astype(np.int32)),
                 pa.array(best.id), pa.array(best.score)], ["anchor", "slot", "id", "score"],
            )

        facts = blocks.select("part", "label_low", "label_high", "low", "high")
        parts = [r["part"] for r in facts.mapInArrow(zones, "part int").distinct().toLocalIterator()]
        found = blocks.where(F.col("part").isin(parts)).mapInArrow(read, "anchor int, slot int, id long, score long")
        order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.size)


def mine(
    rows: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """`anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`, `negative_score` for the rows that `anchor` marks.

    A component x counts as floor(scale * x); scores are inner products, exact as 64-bit numbers. The positives of an anchor
    are the `positives` other rows of its label with the greatest scores, ties by the smaller id. For each, the negatives are
    the first `negatives` rows of another label whose score is from `low` to `high` percent of the positive's, in the same
    order; a positive without any, such as one with a negative score, has no rows.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part. Shorter vectors end in
    zeros. Rows that are repeated count once; rows of one id that differ are each a row, but not "other" rows of one another.
    Other columns are not looked at. Vectors whose products might not fit into 64 bits are refused. An empty table, or one without anchors, gives no rows. Runs jobs while the frame is built.
    """
    spark = rows.sparkSession
    whole = materialize(_usable(rows, key, label, vector, anchor, scale), "vectors")
    space = _measure(whole)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], schema)
    if not space.rows:
        return out
    assert space.kind  # or the vectors are refused here
    blocks = _blocks(whole, space, positives)
    for anchors in _slices(blocks, space):
        out = out.unionByName(_one_slice(spark, blocks, space, anchors, positives, negatives, low, high))
    return out


def _one_slice(
    spark: SparkSession, blocks: DataFrame, space: Space, anchors: Anchors, positives: int, negatives: int, low: int, high: int
) -> DataFrame:
    n = len(anchors.ids)
    ends = np.full((n, 1), np.iinfo(np.int64).max)
    first = materialize(Search(anchors, True, positives, anchors.floors[:, None], ends).run(blocks, space), "positives")
    near = first.select("anchor", "rank", "score").toArrow()  # a few numbers for each anchor of the slice
    at, rank, score = (near[c].to_numpy() for c in ("anchor", "rank", "score"))
    least, most = np.full((n, positives), 1, np.int64), np.zeros((n, positives), np.int64)  # empty windows
    # 64-bit products of a score and a percentage may overflow, Python's do not.
    least[at, rank - 1] = [-(-low * int(s) // 100) for s in score]
    most[at, rank - 1] = [high * int(s) // 100 for s in score]
    second = Search(anchors, False, negatives, least, most).run(blocks, space)
    ids = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(n, dtype=np.int32)), "anchor_id": anchors.ids}))
    pairs = first.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = second.select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(pairs, ["anchor", "slot"]).join(ids, "anchor")
    return materialize(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
