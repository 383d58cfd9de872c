"""Language identification by prediction by partial matching.

Each language has a context tree of bytes up to four deep, frozen after fitting. A byte's code length in a language is
exact: the deepest context that was ever seen predicts it or escapes to the next shorter one (escape method C), whose
counts then leave out what the deeper one could have predicted; after the empty context all other bytes are equal. Since
the statistics are frozen, a byte's code length depends on five bytes alone, so a worker computes it once per five bytes
and then only looks it up. The language with the shortest code wins.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .common import annotate, resident

#: Bytes of a context at most.
ORDER = 4
#: Bytes of text per language that a model is fitted on, at most; texts in the order of a hash of their id, the last cut.
FIT_BYTES = 2_000_000

#: Five-byte windows a worker keeps the code lengths of (slots of a table), and windows scored at once.
SLOTS, AT_ONCE = 1 << 20, 1 << 19

UNKNOWN = "und"

FIELDS = T.StructType([
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("bits_per_byte", T.DoubleType()),
])

_NO_LETTERS = re.compile(r"[\W\d_]+")
# Numbers that the pattern would take for letters, such as fractions and Roman numerals.
_NUMBERS = {c: " " for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No")}


def canonical(text: str | None) -> bytes:
    """Lower-cased text with one blank for each run of anything but letters; nothing if it has no letter.

    Combining marks that are characters of their own are no letters.
    """
    low = text.lower() if text else ""
    stripped = _NO_LETTERS.sub(" ", low if low.isascii() else low.translate(_NUMBERS)).strip()
    return b" " + stripped.encode() + b" " if stripped else b""


def _codes(data: np.ndarray, size: int) -> np.ndarray:
    """The runs of `size` bytes as numbers."""
    n = len(data) - size + 1
    out = np.zeros(max(n, 0), np.int64)
    for k in range(size):
        out = out << 8 | data[k : k + n]
    return out


def sample(docs: DataFrame, label: str, text: str, key: str, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """The first `fit_bytes` of labelled text per label, or all there is, in the order of a hash of the key.

    Of the text that crosses the bound only its beginning is taken, so a long text leaves no label short of its bytes.
    """
    # The hash without its lowest bit, so that it is positive; a text's size is what it can bring at most.
    order, size = F.shiftrightunsigned(F.xxhash64(F.col(key)), 1), F.least(F.octet_length(F.col(text)), F.lit(fit_bytes))
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).cast("string").alias("label"), F.col(text).alias("text"), size.cast("long").alias("size"),
        order.alias("order"), F.length(F.bin(order)).alias("scale"),
    )
    # Each scale holds twice the hashes of the one before; the scales up to the bound are all that the window need see.
    reach: dict[str, int] = {}
    so_far: dict[str, int] = {}
    for r in rows.groupBy("label", "scale").agg(F.sum("size").alias("bytes")).orderBy("label", "scale").collect():
        if so_far.get(r["label"], 0) < fit_bytes:
            reach[r["label"]] = r["scale"]
        so_far[r["label"]] = so_far.get(r["label"], 0) + r["bytes"]
    if not reach:
        return rows.select("label", "text").limit(0)
    last = F.create_map(*[F.lit(x) for pair in reach.items() for x in pair])
    near = rows.where(F.col("scale") <= last[F.col("label")]).withColumn("text", _first_bytes("text", F.lit(fit_bytes)))
    before = F.sum("size").over(W.partitionBy("label").orderBy("order", "text").rowsBetween(W.unboundedPreceding, -1))
    room = (fit_bytes - F.coalesce(before, F.lit(0))).cast("int")
    taken = near.withColumn("room", room).where("room > 0")
    return taken.select("label", _first_bytes("text", F.col("room")).alias("text"))


def _first_bytes(text: str, n: Column) -> Column:
    """At most `n` bytes from the beginning of a text; a character that would be cut goes too."""
    piece = F.make_valid_utf8(F.substring(F.col(text).cast("binary"), F.lit(1), n).cast("string"))
    return F.when(F.octet_length(text) <= n, F.col(text)).otherwise(F.regexp_replace(piece, "\ufffd+$", ""))


@dataclass
class Level:
    """Contexts of one length in one language: sorted codes, with totals, distinct symbols, and what they shadow in the
    next shorter context; and the strings context + symbol, sorted, with counts."""

    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    shadow: np.ndarray
    grams: np.ndarray
    counts: np.ndarray


@dataclass
class Model:
    languages: list[str]
    trees: list[list[Level]]

    @classmethod
    def fit(cls, docs: DataFrame, label: str, text: str, key: str, fit_bytes: int = FIT_BYTES) -> Model:
        """Count the strings of one to five bytes per language over the sample; the sample bounds what is collected."""
        rows = sample(docs, label, text, key, fit_bytes)
        counted = rows.mapInArrow(_count, "label string, size int, code long, n long").groupBy("label", "size", "code").agg(
            F.sum("n").alias("n")
        ).toArrow()
        labels = counted["label"].to_numpy(zero_copy_only=False)
        size, code, n = (counted[c].to_numpy() for c in ("size", "code", "n"))
        languages = sorted(set(labels))
        trees = []
        for language in languages:
            mine = labels == language
            levels: list[Level] = []
            for k in range(ORDER + 1):
                at = mine & (size == k + 1)
                order = np.argsort(code[at])
                levels.append(_level(code[at][order], n[at][order], levels[-1] if levels else None, (1 << 8 * k) - 1))
            trees.append(levels)
        return cls(languages, trees)

    def lengths(self, codes: np.ndarray) -> np.ndarray:
        """Code length in bits of the last of five bytes after the other four, in each language."""
        return np.stack([_lengths(tree, codes) for tree in self.trees], 1).astype(np.float32)


def _count(batches):
    for batch in batches:
        labels, texts = batch.column("label").to_pylist(), batch.column("text").to_pylist()
        for label in dict.fromkeys(labels):
            # Blanks before each text keep strings from running from one text into the next.
            joined = b"".join(b" " * ORDER + canonical(t) for a, t in zip(labels, texts, strict=True) if a == label)
            data = np.frombuffer(joined, np.uint8)
            for size in range(1, ORDER + 2):
                code, n = np.unique(_codes(data, size), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(code), pa.string()), pa.array(np.full(len(code), size, np.int32)), pa.array(code), pa.array(n)],
                    names=["label", "size", "code", "n"],
                )


def _level(grams: np.ndarray, counts: np.ndarray, shorter: Level | None, mask: int) -> Level:
    """`mask` keeps the bytes of a string that the next shorter context sees."""
    contexts, first = np.unique(grams >> 8, return_index=True)
    if not len(grams):
        return Level(contexts, counts, counts, counts, grams, counts)
    total, distinct = np.add.reduceat(counts, first), np.diff(np.append(first, len(grams)))
    if shorter is None:
        return Level(contexts, total, distinct, np.zeros(len(contexts), np.int64), grams, counts)
    below = _find(shorter.grams, grams & mask)
    shadow = np.add.reduceat(np.where(below >= 0, shorter.counts[below], 0), first)
    return Level(contexts, total, distinct, shadow, grams, counts)


def _find(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted number in a sorted table, or -1."""
    if not len(table):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return np.where(table[at] == wanted, at, -1)


def _lengths(tree: list[Level], codes: np.ndarray) -> np.ndarray:
    bits = np.zeros(len(codes))
    open_ = np.arange(len(codes))
    shadow = np.zeros(len(codes), np.int64)
    hidden = np.zeros(len(codes), np.int64)  # distinct symbols that deeper contexts could have predicted
    for k in range(ORDER, -1, -1):
        level, own = tree[k], codes[open_]
        context = _find(level.contexts, own >> 8 & (1 << 8 * k) - 1)
        seen = context >= 0
        gram = _find(level.grams, own & (1 << 8 * (k + 1)) - 1)
        total = np.where(seen, level.total[context] if len(level.total) else 0, 0) - shadow[open_]
        new = np.where(seen, level.distinct[context] if len(level.total) else 0, 0) - hidden[open_]
        all_ = np.maximum(total + new, 1)
        found = seen & (gram >= 0)
        escape = seen & (gram < 0) & (new > 0)
        bits[open_[found]] -= np.log2(level.counts[gram[found]] / all_[found])
        bits[open_[escape]] -= np.log2(new[escape] / all_[escape])
        shadow[open_[seen]] = level.shadow[context[seen]]
        hidden[open_[seen]] = level.distinct[context[seen]]
        open_ = open_[~found]
    bits[open_] += np.log2(np.maximum(256 - hidden[open_], 1))
    return bits


class Scorer:
    """A worker's table of code lengths: one slot per hash of five bytes, filled as they come."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.keys = np.full(SLOTS, -1, np.int64)
        self.bits = np.zeros((SLOTS, len(model.languages)), np.float32)

    def lengths(self, codes: np.ndarray) -> np.ndarray:
        slot = (codes * 0x9E3779B1 >> 11 & SLOTS - 1).astype(np.int32)
        bits = self.bits[slot]
        missing = np.flatnonzero(self.keys[slot] != codes)
        if len(missing):
            new, back = np.unique(codes[missing], return_inverse=True)
            rows = self.model.lengths(new)
            bits[missing] = rows[back]
            slot = (new * 0x9E3779B1 >> 11 & SLOTS - 1).astype(np.int32)
            self.keys[slot] = new
            own = self.keys[slot] == new  # of several that share a slot, one keeps it
            self.bits[slot[own]] = rows[own]
        return bits

    def score(self, texts: list[str | None]) -> list[list]:
        data = [canonical(t) for t in texts]
        bits = np.zeros((len(texts), len(self.model.languages)))
        at = 0
        while at < len(data) and self.model.languages:
            end, size = at, 0
            while end < len(data) and (end == at or size < AT_ONCE):
                size += len(data[end]) + ORDER
                end += 1
            self._add(data[at:end], bits[at:end])
            at = end
        names, scores, rates = [], [], []
        for d, row in zip(data, bits, strict=True):
            if not d or not len(row):
                names.append(UNKNOWN)
                scores.append(0.0)
                rates.append(None)
                continue
            best = int(np.argmin(row))
            names.append(self.model.languages[best])
            scores.append(float(1 / np.exp2(np.maximum(row[best] - row, -1000)).sum()))
            rates.append(float(row[best] / len(d)))
        return [names, scores, rates]

    def _add(self, data: list[bytes], into: np.ndarray) -> None:
        """Add the code lengths of some texts, a part of them at a time."""
        joined = np.frombuffer(b"".join(b" " * ORDER + d for d in data if d), np.uint8)
        owner = np.repeat([k for k, d in enumerate(data) if d], [len(d) + ORDER for d in data if d])
        lead = np.concatenate([np.arange(len(d) + ORDER) < ORDER for d in data if d] or [np.empty(0, bool)])
        for start in range(0, len(joined), AT_ONCE):
            stop = min(start + AT_ONCE, len(joined))
            low = max(start - ORDER, 0)
            codes = _codes(joined[low:stop], ORDER + 1)
            ends = np.arange(low + ORDER, stop)
            use = (ends >= start) & ~lead[ends]
            rows, whose = self.lengths(codes[use]), owner[ends[use]]
            first = np.flatnonzero(np.diff(whose, prepend=-1))
            if len(first):
                into[whose[first]] += np.add.reduceat(rows, first, axis=0, dtype=np.float64)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred`, `score` (its share of probability, all languages being equally likely before) and
    `bits_per_byte` in the language that won.

    A text that is null or has no letter, and any text if the model knows no language, is `und` with score 0 and no bits.
    Equal code lengths go to the language first in the alphabet. Columns of `docs` so named are replaced. The model is
    bounded by the fitting sample and goes to the tasks whole.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(model), f"ppm {uuid.uuid4().hex}"

    def start():
        return resident(name, lambda: Scorer(shared.value)).score

    return annotate(docs, text, FIELDS, start)
