"""Benchmark decontamination by Wu-Manber search for word windows.

Symbols are words, patterns are the benchmark's windows of ten words (an item of fewer words is one pattern). Shift tables
over blocks of two words say how far a search position may jump; where the shift is zero, the block at the window's end
selects a bucket of patterns, the block at its start thins the bucket out, and all words are compared. Positions of a
whole batch of documents advance together, one lane per stretch of words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import materialize
from .common import annotate

WINDOW = 10
#: Bytes of benchmark text whose tables are sent to the tasks at once; a larger benchmark takes several passes.
SLICE_BYTES = 8 << 20

#: Words searched by one lane, and words searched at once.
LANE, AT_ONCE = 128, 1 << 19

# A-Z lower-cased; every ASCII character that is no letter or digit is a blank.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ]))),
])


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_NORMAL).split() if text else []


def _block(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    x = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - bits)


@dataclass
class Tables:
    """The patterns of one length, with the shift table and the buckets by end block."""

    length: int
    bits: int
    words: np.ndarray
    shift: np.ndarray
    order: np.ndarray
    starts: np.ndarray
    head: np.ndarray

    @classmethod
    def build(cls, words: np.ndarray) -> Tables:
        n, length = words.shape
        bits = max(12, int(n * length).bit_length() + 2)
        width = min(2, length)
        shift = np.full(1 << bits, length - width + 1, np.int32)
        for end in range(width - 1, length):
            np.minimum.at(shift, _block(words[:, end - width + 1], words[:, end], bits), length - 1 - end)
        tail = _block(words[:, -width], words[:, -1], bits)
        order = np.argsort(tail, kind="stable")
        starts = np.searchsorted(tail[order], np.arange((1 << bits) + 1, dtype=np.uint64))
        return cls(length, bits, words, shift, order, starts, _block(words[:, 0], words[:, width - 1], bits))

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (first word, pattern) occurrences in `ids`."""
        width = min(2, self.length)
        if len(ids) < self.length:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.arange(self.length - 1, len(ids), LANE)
        end = np.minimum(at + LANE, len(ids))
        zero = []
        while len(at):
            step = self.shift[_block(ids[at - width + 1], ids[at], self.bits)]
            zero.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < end
            at, end = at[on], end[on]
        at = np.concatenate(zero)
        bucket = _block(ids[at - width + 1], ids[at], self.bits)
        many = self.starts[bucket + np.uint64(1)] - self.starts[bucket]
        first = np.repeat(at - self.length + 1, many)
        rank = np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
        pattern = self.order[np.repeat(self.starts[bucket], many) + rank]
        same = _block(ids[first], ids[first + width - 1], self.bits) == self.head[pattern]
        first, pattern = first[same], pattern[same]
        for k in range(self.length):
            same = ids[first + k] == self.words[pattern, k]
            first, pattern = first[same], pattern[same]
        return first, pattern


class Search:
    """The patterns of some items, by length, and which items have each pattern."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        owners: dict[tuple[int, ...], set[int]] = {}
        for k, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                owners.setdefault(tuple(ids[i : i + size]), set()).add(k)
        self.window = window
        self.tables, self.owners = [], []
        for length in sorted({len(p) for p in owners}):
            own = [p for p in owners if len(p) == length]
            self.tables.append(Tables.build(np.array(own, np.int32)))
            self.owners.append([sorted(owners[p]) for p in own])

    def batch(self, texts: list[list[bytes]], spans: list, items: list) -> list[list]:
        """Word counts, hit words, items and spans of some documents, added to the spans and items known before."""
        gap = self.window
        starts = np.cumsum([0] + [len(w) + gap for w in texts])
        ids = np.zeros(starts[-1], np.int32)
        get = self.vocabulary.get
        for start, words in zip(starts, texts, strict=False):
            ids[start : start + len(words)] = [get(w, 0) for w in words]
        edge = np.zeros(len(ids) + 1, np.int32)
        found = [set(x or ()) for x in items]
        for start, old in zip(starts, spans, strict=False):
            for span in old or ():
                edge[start + span["start"]] += 1
                edge[start + span["end"]] -= 1
        for table, owners in zip(self.tables, self.owners, strict=True):
            first, pattern = table.search(ids)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + table.length, -1)
            doc = np.searchsorted(starts, first, "right") - 1
            for d, p in np.unique(np.stack([doc, pattern], 1), axis=0).tolist():
                found[d].update(self.names[k] for k in owners[p])
        hit = (np.cumsum(edge) > 0).astype(np.int8)
        change = np.flatnonzero(np.diff(hit, prepend=0))
        doc = np.searchsorted(starts, change, "right") - 1
        covered: list[list] = [[] for _ in texts]
        for d, a, b in zip(doc[::2].tolist(), change[::2].tolist(), change[1::2].tolist(), strict=True):
            base = int(starts[d])
            covered[d].append({"start": a - base, "end": b - base})
        return [
            [len(w) for w in texts], [sum(s["end"] - s["start"] for s in c) for c in covered],
            [sorted(x) for x in found], covered,
        ]


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """`docs` with `n_words`, `n_hit`, `items` and `spans`: the benchmark items found in each text, and where.

    `spans` are runs of hit words (first, behind the last), `items` the ids of items with an occurring window, sorted as
    strings. Null and empty texts have no words; items without words or without an id occur nowhere; repeated items and
    rows count as they stand; columns of `docs` with these names are replaced. The benchmark is searched in slices of at
    most about `slice_bytes` of text, each of which is sent to the tasks whole.
    """
    spark = docs.sparkSession
    bench = benchmark.select(
        F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")
    ).where("item is not null and text is not null")
    size = bench.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    slices = max(1, -(-size // slice_bytes))
    dealt = bench.withColumn("slice", F.pmod(F.xxhash64("item", "text"), F.lit(slices)))
    docs = docs.drop("n_words", "n_hit", "items", "spans")
    for k in range(slices):
        docs = _one_pass(spark, docs, dealt.where(F.col("slice") == k), text, window, first=k == 0)
        if k < slices - 1:
            docs = materialize(docs, "decontamination")
    return docs


def _one_pass(spark: SparkSession, docs: DataFrame, items: DataFrame, text: str, window: int, first: bool) -> DataFrame:
    rows = sorted((r["item"], r["text"]) for r in items.select("item", "text").toLocalIterator())
    tables = spark.sparkContext.broadcast(Search(rows, window))
    if first:
        return annotate(docs, text, FIELDS, lambda: _worker(tables))
    packed = docs.withColumn("__known", F.to_json(F.struct(F.col(text).alias("t"), "items", "spans")))
    return annotate(packed, "__known", FIELDS, lambda: _again(tables)).drop("__known")


def _worker(tables):
    return lambda texts: _batches(tables.value, texts, [None] * len(texts), [None] * len(texts))


def _again(tables):
    import json

    def run(packed: list[str]) -> list[list]:
        rows = [json.loads(x) for x in packed]
        return _batches(
            tables.value, [r.get("t") for r in rows], [r["spans"] for r in rows], [r["items"] for r in rows]
        )

    return run


def _batches(search: Search, texts: list, spans: list, items: list) -> list[list]:
    out: list[list] = [[], [], [], []]
    at = 0
    while at < len(texts):
        words, end, size = [], at, 0
        while end < len(texts) and (end == at or size < AT_ONCE):
            words.append(words_of(texts[end]))
            size += len(words[-1])
            end += 1
        for into, new in zip(out, search.batch(words, spans[at:end], items[at:end]), strict=True):
            into.extend(new)
        at = end
    return out
