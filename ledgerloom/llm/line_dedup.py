"""Line dedup by an exact set-similarity join.

A line is the set of its five-word shingles. Its tokens are put in one global order, rare ones first; two lines with
Jaccard similarity num / den or more then share a token within their prefixes. Positions in the prefix, lengths, and the
Hamming distance of small sketches dismiss pairs, the rest is verified on the sets. A line is removed if any earlier line
matches it, "earlier" being by document id and line number. So one match is enough: all lines of a token are compared with
its first line, and only lines that are then still without a match meet the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import LOWER, hash_words, mix, small_side

SHINGLE, NUM, DEN = 5, 8, 10

#: Buckets of the table of token counts that the order by rarity comes from; its size is fixed.
BUCKETS = 1 << 16
#: 64-bit words of a line's sketch.
SKETCH = 2
#: Texts whose lines a worker holds at a time.
TEXTS = 256

_SETS = "id long, line int, n int, d1 long, d2 long, s0 long, s1 long, prefix array<long>"


def _batches(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS):
            batch = whole.slice(at, TEXTS)
            yield batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()


def _tokens(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of all lines with a word: their hashes and lines; and the text and number of each line.

    A line of fewer than `size` words has its whole sequence as the one shingle.
    """
    data = [t.encode().translate(LOWER) for t in texts]
    joined = b"\n".join(data)
    words, starts = hash_words(joined)
    breaks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
    line = np.searchsorted(breaks, starts)
    token = np.full(max(len(words) - size + 1, 0), np.uint64(size))
    for k in range(size):
        token = mix(token * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(token)])
    inside = line[: len(token)] == line[size - 1 :]
    tokens, lines = [token[inside]], [line[: len(token)][inside]]
    first = np.flatnonzero(np.diff(line, prepend=-1))  # the first word of each line with one
    length = np.diff(np.append(first, len(line)))
    for n in range(1, size):
        at = first[length == n]
        token = np.full(len(at), np.uint64(n))
        for k in range(n):
            token = mix(token * np.uint64(0x9E3779B97F4A7C15) + words[at + k])
        tokens.append(token)
        lines.append(line[at])
    token, line = np.concatenate(tokens), np.concatenate(lines)
    own, of = np.unique(line, return_inverse=True)
    counts = [d.count(b"\n") + 1 for d in data]
    firsts = np.cumsum(counts) - counts  # of each text's lines among all
    text = np.searchsorted(firsts, own, "right") - 1
    return token, of, text, (own - firsts[text]).astype(np.int32)


class Lines:
    """The token sets of lines, one after the other, each from rare tokens to common ones.

    A token is the rank of its bucket's count, in steps of a factor of about 1.4, above 58 bits of its hash. So the order of
    the numbers is the order by rarity, and it is the same everywhere.
    """

    def __init__(self, ids: np.ndarray, texts: list[str], size: int, ranks: np.ndarray) -> None:
        token, of, text, self.numbers = _tokens(texts, size)
        self.ids = np.asarray(ids, np.int64)[text]
        token = ranks[_bucket(token)] << np.uint64(58) | token >> np.uint64(6)
        order = np.argsort(token)
        lines = of[order].astype(np.uint16) if len(self.ids) < 1 << 16 else of[order]
        order = order[np.argsort(lines, kind="stable")]
        token, of = token[order], of[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (of[1:] != of[:-1])
        self.tokens, self.of = token[new], of[new]
        self.sizes = np.bincount(self.of, minlength=len(self.ids))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def digest(self, salt: int) -> np.ndarray:
        """A number per line that depends on the set alone."""
        if not len(self.starts):
            return np.empty(0, np.int64)
        return np.add.reduceat(mix(self.tokens ^ np.uint64(salt)), self.starts).view(np.int64)

    def sketch(self) -> np.ndarray:
        """Per line `SKETCH` words of bits, each toggled by the tokens that hash to it."""
        bits = 64 * SKETCH
        place = self.of * bits + (self.tokens & np.uint64(bits - 1)).astype(np.int64)
        odd = (np.bincount(place, minlength=len(self.ids) * bits) & 1).astype(np.uint8).reshape(-1, bits)
        return np.packbits(odd, axis=1).view(np.int64).reshape(-1, SKETCH)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(48)).astype(np.int64)


def rarity(rows: DataFrame, size: int) -> np.ndarray:
    """The rank of each bucket of tokens by how often they occur in all lines: a table of fixed size."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for _, texts in _batches(batches):
            total += np.bincount(_bucket(_tokens(texts, size)[0]), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    found = rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return np.minimum(2 * np.log2(np.maximum(out, 1)), 63).astype(np.uint64)


def _line_sets(rows: DataFrame, size: int, num: int, den: int, ranks: np.ndarray) -> DataFrame:
    """One row per line with a set: its size, a digest of the set, a sketch, and its prefix tokens from rare to common.

    Of lines with equal sets in one batch only the first carries the prefix. A set of one token matches equal sets only
    (above a half), which digests tell, and carries none.
    """
    shared = rows.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        for ids, texts in _batches(batches):
            x = Lines(ids, texts, size, shared.value)
            n, d1, sketch = x.sizes, x.digest(1), x.sketch()
            told = np.zeros(len(n), bool)
            told[np.unique(d1, return_index=True)[1]] = True
            length = np.where(told & ((n > 1) | (2 * num <= den)), n - -(-n * num // den) + 1, 0)
            kept = np.arange(len(x.of)) - x.starts[x.of] < length[x.of]
            yield pa.RecordBatch.from_arrays([
                pa.array(x.ids), pa.array(x.numbers), pa.array(n.astype(np.int32)), pa.array(d1), pa.array(x.digest(2)),
                *[pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(SKETCH)],
                _lists(x.tokens[kept].view(np.int64), length),
            ], ["id", "line", "n", "d1", "d2", "s0", "s1", "prefix"])

    return rows.mapInArrow(run, _SETS)


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))


def _possible(num: int, den: int) -> Column:
    """Whether lengths, positions (n, p and m, q) of a shared token, and sketches leave a match possible."""
    n, m = F.col("n"), F.col("m")
    least = F.least(n - F.col("p"), m - F.col("q"))  # tokens from the shared one on
    distance = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"t{k}"))) for k in range(SKETCH)), F.lit(0))
    return (
        (F.least(n, m) * den >= F.greatest(n, m) * num) & (least * (den + num) >= (n + m) * num)
        & (distance * (den + num) <= (n + m) * (den - num))
    )


def matched_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, num: int = NUM, den: int = DEN
) -> DataFrame:
    """`id`, `line` of every line that an earlier line matches; lines are numbered from 0.

    Lines are cut at line feeds, words at ASCII blanks after A-Z are lower-cased. The set of a line of fewer than `size` words
    is its whole sequence; lines without words match nothing, nor do null texts and rows with a null id. Of lines with equal sets the first one stays. Rows with one id are
    taken as one document: their lines of one number count as the same place. Tokens are told apart by 58 bits of a hash and their rank.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where(
        "id is not null and text is not null"
    )
    ranks = rarity(rows, size)
    lines = materialize(_line_sets(rows, size, num, den, ranks), "lines")
    tokens = lines.select("d1", F.posexplode("prefix").alias("p", "token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    # One row per token on that side, so its part of a partition stays small.
    met = materialize(tokens.join(often.hint("shuffle_hash"), "token").distinct(), "shared-tokens")
    # Equal sets have one digest, so these are tokens of several sets.
    several = met.groupBy("token").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).where("x < y").select("token")
    met = met.join(several, "token")
    place = F.struct("id", "line")
    wanted = small_side(materialize(met.select("d1").distinct().withColumn("met", F.lit(True)), "set-digests"))
    sets = lines.groupBy("d1", "d2", "n").agg(
        F.min(place).alias("at"), F.count("*").alias("k"), F.min("s0").alias("s0"), F.min("s1").alias("s1")
    )
    sets = materialize(sets.join(wanted, "d1", "left").where("k > 1 or met"), "sets")
    copies = lines.select("id", "line", "d1", "d2", "n").join(
        small_side(sets.where("k > 1").select("d1", "d2", "n", "at")), ["d1", "d2", "n"]
    ).where(place > F.col("at")).select("id", "line")
    met = materialize(
        met.join(sets.where("met").select("d1", "n", "at", "s0", "s1"), "d1").select("token", "p", "n", "at", "s0", "s1"), "met"
    )
    earlier = {"at": "by", "n": "m", "p": "q", "s0": "t0", "s1": "t1"}
    heads = met.groupBy("token").agg(F.min(F.struct(*earlier)).alias("h")).select(
        "token", *[F.col(f"h.{a}").alias(b) for a, b in earlier.items()]
    )
    near = met.join(heads, "token").where((F.col("at") > F.col("by")) & _possible(num, den))
    found = _verified(rows, near.select("at", "by").distinct(), size, num, den, ranks)
    # Lines without a match so far meet every earlier line of their tokens but the first.
    left = met.join(found, "at", "left_anti").join(heads.select("token", F.col("by").alias("head")), "token").where(
        F.col("at") > F.col("head")
    )
    others = met.withColumnsRenamed(earlier)
    near = left.join(others, "token").where(
        (F.col("by") < F.col("at")) & (F.col("by") > F.col("head")) & _possible(num, den)
    )
    more = _verified(rows, near.select("at", "by").distinct(), size, num, den, ranks)
    return copies.unionByName(found.unionByName(more).select("at.id", "at.line")).distinct()


def _verified(rows: DataFrame, pairs: DataFrame, size: int, num: int, den: int, ranks: np.ndarray) -> DataFrame:
    """`at` of the pairs (at, by) whose sets match; only documents that occur in pairs are read again."""
    pairs = materialize(pairs, "line-pairs")
    lines = materialize(pairs.select("at").union(pairs.select("by")).distinct().select("at.id", "at.line"), "wanted-lines")
    docs = materialize(lines.select("id").distinct(), "wanted-documents")
    shared = rows.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        for ids, texts in _batches(batches):
            x = Lines(ids, texts, size, shared.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.ids), pa.array(x.numbers), _lists(x.tokens.view(np.int64), x.sizes)], ["id", "line", "tokens"]
            )

    read = rows.join(small_side(docs), "id", "left_semi").mapInArrow(run, "id long, line int, tokens array<long>")
    own = read.join(small_side(lines), ["id", "line"], "left_semi").select(F.struct("id", "line").alias("at"), "tokens")
    own = materialize(own, "line-sets")
    both = pairs.join(own.withColumnRenamed("tokens", "x"), "at").join(
        own.withColumnsRenamed({"at": "by", "tokens": "y"}), "by"
    )
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return materialize(both.where(common * den >= union * num).select("at").distinct(), "matched-lines")


def remove_matched_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, num: int = NUM, den: int = DEN
) -> DataFrame:
    """`docs` with the matched lines cut out of the text, and `n_lines`, `n_removed`; see `matched_lines`.

    Columns named `n_lines` or `n_removed` are replaced; null texts stay null and have no lines.
    """
    removed = materialize(matched_lines(docs, key, text, size, num, den), "removed-lines")
    own = removed.groupBy("id").agg(F.collect_set("line").alias("__lines"))  # a part of the lines of one text
    if removed.limit(1_000_001).count() <= 1_000_000:
        own = F.broadcast(own)
    kept = docs.drop("n_lines", "n_removed").join(
        own.withColumnRenamed("id", "__id"), F.col(key).cast("long") == F.col("__id"), "left"
    )
    lines = F.split(F.col(text), "\n")
    gone = F.coalesce("__lines", F.array().cast("array<int>"))
    marks = F.map_from_arrays(gone, F.transform(gone, lambda _: F.lit(True)))
    rest = F.filter(lines, lambda _, i: F.element_at(marks, i.cast("int")).isNull())
    return kept.withColumns({
        "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
        "n_removed": F.size(gone).cast("long"),
        text: F.when(F.col("__lines").isNull(), F.col(text)).otherwise(F.array_join(rest, "\n")),
    }).drop("__id", "__lines")
