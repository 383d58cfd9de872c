"""Helpers the operators share: Arrow passes over text, word hashing, checked broadcasts."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A side of a join is broadcast only when a written table holds at most this many rows of a few numbers each.
BROADCAST_ROWS = 1_000_000

#: Distinct words a worker remembers the hashes of before it starts afresh.
REMEMBERED_WORDS = 400_000

#: Rows a worker holds the texts and results of at a time.
BATCH_ROWS = 1024

# A-Z lower-cased, all other bytes as they are.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def annotate(
    df: DataFrame, text: str, fields: T.StructType, start: Callable[[], Callable[[list], list]]
) -> DataFrame:
    """`df` with `fields` computed from its column `text` in one Arrow pass, without a shuffle.

    `start` is called once per task and returns the function that turns a list of texts (None: null) into one list or
    Arrow array per field. A column of `df` named as one of `fields` is replaced.
    """
    kept = df.drop(*[f.name for f in fields])
    width = len(kept.columns)
    # A string column that stays is read where it is, so that no text goes to the worker twice.
    there = text in kept.columns and kept.schema[text].dataType == T.StringType()
    at_text = kept.columns.index(text) if there else width
    schema = T.StructType([*kept.schema.fields, *fields.fields])
    kinds = [f.type for f in to_arrow_schema(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                new = work(batch.column(at_text).to_pylist())
                made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(new, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=schema.names)
        pa.default_memory_pool().release_unused()  # the worker goes on with other tasks

    rows = kept if there else kept.select("*", df[text].cast("string").alias("__text"))
    return rows.mapInArrow(run, schema)


_RESIDENT: dict[str, object] = {}


def resident(name: str, make: Callable[[], object]) -> object:
    """The large state that this worker keeps from task to task; the state of another name is dropped first.

    Spark reuses workers, so that without this each operator's tables would stay beside those of the next.
    """
    if name not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[name] = make()
    return _RESIDENT[name]


def hash_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of a text, and where they start. Words are runs of anything but ASCII blanks.

    Eight bytes of every word are taken in at a time, for all words at once.
    """
    padded = text + b" " * 8
    raw = np.frombuffer(padded, np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        turns = np.concatenate([[0], turns])
    starts, sizes = turns[::2], turns[1::2] - turns[::2]
    eight = np.ndarray((len(raw) - 7,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    out = mix(sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ eight[starts] & _FIRST[np.minimum(sizes, 8)])
    at, done = np.flatnonzero(sizes > 8), 8
    while len(at):
        more = eight[starts[at] + done] & _FIRST[np.minimum(sizes[at] - done, 8)]
        out[at] = mix(out[at] * np.uint64(0x9E3779B97F4A7C15) ^ more)
        done += 8
        at = at[sizes[at] > done]
    return out, starts


# Masks for the first bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; fewer words, but not none, are one run."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(out)


def code_points(kind: str) -> str:
    """The code points of a general category as ranges of a character class."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, a written table of a few numbers per row, marked for broadcast if it is within `rows`."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
