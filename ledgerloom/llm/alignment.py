"""Alignment of the tokens of two tokenizers.

A text is tokenised as a whole by a byte-level BPE (A) and by a piece model (B). Wherever a token of both ends and the next
token of both begins with a blank, the text is cut: such shared ends are verified on the byte offsets, and between them lie
windows, mostly single words, whose alignment depends on their token ids alone. So it is worked out once per pair of id
tuples and remembered. Within a window, all shared ends cut groups, and tokens whose bytes overlap are linked.

How often two ids are linked in the whole corpus is counted over blocks of documents: a block has a dictionary of its id
pairs, its documents are lists of window numbers, and only dictionaries are exchanged between the tasks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize
from .bpe import _byte_letters
from .common import mix

#: Bytes of text that are tokenised at a time, and after which a block of documents ends. A longer text is one block.
AT_ONCE, BLOCK_BYTES = 1 << 20, 4 << 20
#: Window alignments a worker remembers before it starts afresh, and the most tokens of a window that is remembered.
REMEMBERED, LONGEST = 250_000, 64

_COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")])
_INNER = T.StructType([
    # Lists of numbers are packed: see `_pack`.
    T.StructField("__block", T.LongType()), T.StructField("__windows", T.BinaryType()),
    # A row for each block, without a document: its id pairs, how often they are linked, and the pairs of each window.
    T.StructField("__pairs", T.ArrayType(T.LongType())), T.StructField("__times", T.ArrayType(T.LongType())),
    T.StructField("__window_pairs", T.BinaryType()), T.StructField("__window_sizes", T.BinaryType()),
])


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, each in as many bytes as the greatest needs; the first byte says how many."""
    wide = 1 if (top := int(numbers.max(initial=0))) < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([wide]) + numbers.astype(f"<u{wide}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


#: The rule by which byte-level BPE cuts a text before any merge; a fixed value of that format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a: str, b: bytes) -> None:
        import sentencepiece
        import tiktoken

        model = json.loads(a)["model"]
        letter = {c: bytes([k]) for k, c in enumerate(_byte_letters())}
        # Special tokens are ordinary text here; they are no product of a merge.
        merged = {"".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]}
        ranks = {
            b"".join(letter[c] for c in token): k for token, k in model["vocab"].items() if len(token) == 1 or token in merged
        }
        order = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if order != sorted(order):
            raise ValueError("ids of this vocabulary do not follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.bytes_a[k] = token
        pieces = range(self.b.get_piece_size())
        self.bytes_b = [
            bytes([int(self.b.id_to_piece(k)[3:-1], 16)]) if self.b.is_byte(k)
            else self.b.id_to_piece(k).replace("▁", " ").encode() for k in pieces
        ]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.blank_a, self.blank_b = (np.array([x[:1] == b" " for x in t]) for t in (self.bytes_a, self.bytes_b))
        # Ids as text, and whether they end their part of a group.
        self.text_a, self.text_b = (
            np.array([[f"{k}{sign}" for k in range(len(t))] for sign in signs], object)
            for t, signs in ((self.bytes_a, ",|"), (self.bytes_b, ",;"))
        )

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of each text with a blank before it; none where the bytes of the tokens do not give it back.

        The tokens of A always give it back; those of B are joined and compared.
        """
        none = np.empty(0, np.int32)
        ids_a, ids_b = [none] * len(texts), [none] * len(texts)
        some = [k for k, t in enumerate(texts) if t]
        for k, b in zip(some, self.b.encode([texts[k] for k in some], num_threads=1) if some else [], strict=True):
            if b"".join(map(self.bytes_b.__getitem__, b)) == b" " + texts[k].encode():
                ids_a[k] = self.a.encode_to_numpy(" " + texts[k], disallowed_special=()).view(np.int32)
                ids_b[k] = np.array(b, np.int32)
        return ids_a, ids_b


class Numbers(dict):
    """Numbers its keys in the order in which they are asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


class Block:
    """The windows that a block of documents has met, by their id tuples: how many are of A, these, and those of B."""

    def __init__(self) -> None:
        self.number = Numbers()
        self.groups: list[str] = []
        self.n_groups: list[int] = []
        self.links: list[bytes] = []
        self.used: list[np.ndarray] = []
        self.size = 0

    def dictionary(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Id pairs, how often they are linked, the place of each window's links among the pairs, and their numbers."""
        sizes = np.array([len(x) // 8 for x in self.links], np.int64)
        used = np.bincount(np.concatenate(self.used), minlength=len(sizes)) if self.used else np.zeros(0, np.int64)
        pairs, place = np.unique(np.frombuffer(b"".join(self.links), np.int64), return_inverse=True)
        times = np.bincount(place, np.repeat(used, sizes), len(pairs)).astype(np.int64)
        return pairs, times, place, sizes


def _alike(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of equal windows each, and for every window its place among these."""
    if not len(cut_a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sums = np.zeros(len(cut_a), np.uint64)
    sides = []
    for ids, cut, salt in ((a, cut_a, 1), (b, cut_b, 2)):
        start = np.append(0, cut[:-1])
        place = np.arange(len(ids)) - np.repeat(start, cut - start)
        sums += np.add.reduceat(mix((ids.astype(np.uint64) << np.uint64(32)) + (place * 4 + salt).astype(np.uint64)), start)
        sides.append((ids, start, cut - start, place))
    _, first, of = np.unique(sums, return_index=True, return_inverse=True)
    for ids, start, size, place in sides:  # equal sums are not taken for granted
        same = (size[first][of] == size).all() and (ids[np.repeat(start[first][of], size) + place] == ids).all()
        if not same:
            return np.arange(len(cut_a)), np.arange(len(cut_a))
    return first, of


class Aligner:
    """One task's work: windows by their id tuples, and what this worker remembers of them."""

    def __init__(self, both: Tokenizers, memo: dict) -> None:
        self.both, self.memo = both, memo

    def _worked_out(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[tuple[str, int, bytes]]:
        """The alignments of windows, whose ids are given one after the other: groups, their number, and links."""
        ends_a, ends_b = np.cumsum(self.both.sizes_a[a]), np.cumsum(self.both.sizes_b[b])
        window = np.repeat(np.arange(len(n_a)), n_a)
        # Between any two neighbouring ends lies one token of each, and these overlap.
        ends = np.union1d(ends_a, ends_b)
        of_a, of_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        links = (a[of_a].astype(np.int64) << 32 | b[of_b]).tobytes()
        link_stops = np.cumsum(np.bincount(window[of_a], minlength=len(n_a))) * 8
        shared = ends[(ends_a[of_a] == ends) & (ends_b[of_b] == ends)]
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        n_groups = np.bincount(window[np.searchsorted(ends_a, shared)], minlength=len(n_a))
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        written = np.concatenate([self.both.text_a[last_a.astype(int), a], self.both.text_b[last_b.astype(int), b]])
        written = written[order].tolist()
        stops = np.cumsum(n_a + n_b).tolist()
        return [
            ("".join(written[s:e])[:-1], n, links[x:y]) for s, e, n, x, y in zip(
                [0, *stops], stops, n_groups.tolist(), [0, *link_stops.tolist()], link_stops.tolist(), strict=False
            )
        ]

    def _remember(self, keys: list[bytes]) -> list[tuple[str, int, bytes]]:
        """The alignments of windows; those not met before are worked out together."""
        memo = self.memo
        new = [k for k in keys if k not in memo]
        if len(memo) + len(new) > REMEMBERED:
            out = [memo.get(k) for k in keys]
            memo.clear()
        else:
            out = None
        if new:
            flat = np.frombuffer(b"".join(new), np.int32)
            sizes = np.array([len(k) for k in new], np.int64) // 4
            starts = np.cumsum(sizes) - sizes
            n_a = flat[starts].astype(np.int64)
            place = np.arange(len(flat)) - np.repeat(starts, sizes)
            of_a = place <= np.repeat(n_a, sizes)
            a, b = flat[of_a & (place > 0)], flat[~of_a]
            found = self._worked_out(a, b, n_a, sizes - 1 - n_a)
            memo.update(zip(new, found, strict=True))
        out = [memo[k] for k in keys] if out is None else [memo[k] if x is None else x for k, x in zip(keys, out, strict=True)]
        for k in np.flatnonzero(sizes > LONGEST).tolist() if new else ():
            del memo[new[k]]
        return out

    def align(self, texts: list[str | None], block: Block) -> list[list]:
        """For each text the numbers of tokens, groups and links, the groups, and its windows in the block."""
        ids_a, ids_b = self.both.tokens(texts)
        a, b = (np.concatenate([np.empty(0, np.int32), *ids]) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.both.sizes_a[a]), np.cumsum(self.both.sizes_b[b])
        # A window ends where a token of both ends, and both next tokens begin with a blank or another text begins.
        at_a = np.searchsorted(ends_a, ends_b)
        shared = np.flatnonzero(ends_a[at_a] == ends_b)
        next_a, next_b = at_a[shared] + 1, shared + 1
        blank = np.append(self.both.blank_a[a], True)[next_a] & np.append(self.both.blank_b[b], True)[next_b]
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        cut = blank | np.isin(next_b, np.cumsum(n_b))
        cut_a, cut_b = next_a[cut], next_b[cut]
        first, numbers = _alike(a, b, cut_a, cut_b)
        # The id tuples of the windows that differ, one after the other.
        (from_a, of_a), (from_b, of_b) = (
            (start, x[first] - start) for x in (cut_a, cut_b) for start in [np.append(0, x)[:-1][first]]
        )
        stops = np.cumsum(1 + of_a + of_b)
        starts = stops - 1 - of_a - of_b
        packed = np.empty(int(stops[-1]) if len(stops) else 0, np.int32)
        packed[starts] = of_a
        for ids, start, size, into in ((a, from_a, of_a, starts + 1), (b, from_b, of_b, starts + 1 + of_a)):
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            packed[np.repeat(into, size) + place] = ids[np.repeat(start, size) + place]
        whole = packed.tobytes()
        known = len(block.number)
        keys = [whole[i:j] for i, j in zip((starts * 4).tolist(), (stops * 4).tolist(), strict=True)]
        numbers = np.array(list(map(block.number.__getitem__, keys)), np.int32)[numbers]
        for text, groups, links in self._remember(list(islice(block.number, known, None))):
            block.groups.append(text)
            block.n_groups.append(groups)
            block.links.append(links)
        block.used.append(numbers)
        stops = np.searchsorted(cut_b, np.cumsum(n_b), "right")
        starts = np.append(0, stops[:-1]) if len(stops) else stops
        n_groups = np.append(0, np.cumsum(np.array(block.n_groups, np.int64)[numbers]))
        n_links = np.append(0, np.cumsum(np.array([len(x) // 8 for x in block.links], np.int64)[numbers]))
        texts_of = block.groups.__getitem__
        return [
            n_a, n_b, n_groups[stops] - n_groups[starts], n_links[stops] - n_links[starts],
            [";".join(map(texts_of, numbers[s:e].tolist())) for s, e in zip(starts, stops, strict=True)],
            [_pack(numbers[s:e]) for s, e in zip(starts, stops, strict=True)],
        ]


_WORKERS: dict[int, tuple[Tokenizers, dict]] = {}


def _aligner(a: str, b: bytes) -> Aligner:
    """This worker's tokenizers and memory; later tasks of the same worker go on with them."""
    key = hash((a, b))
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = Tokenizers(a, b), {}
    return Aligner(*_WORKERS[key])


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about `AT_ONCE` characters."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= AT_ONCE):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


@dataclass(frozen=True)
class Alignment:
    """The rows of the documents with their own alignment, and what it takes to count over all of them."""

    rows: DataFrame

    def documents(self) -> DataFrame:
        """The documents with `n_a`, `n_b`, `n_groups`, `n_links` and `groups`; no shuffle."""
        return self.rows.where("__pairs is null").drop(*_INNER.names)

    def with_counts(self) -> DataFrame:
        """`documents()` with `n_best` and `count_sum` over the links of each.

        The count of an id pair is the number of links in all documents that hold it; a link is best if no pair with its B
        id has a greater count. The rows are written once on the way, and all but the text goes through a shuffle.
        """
        rows = materialize(self.rows, "aligned")
        known = rows.where("__pairs is not null").select("__block", F.posexplode(F.arrays_zip("__pairs", "__times"))).select(
            "__block", F.col("pos").alias("__pos"), F.col("col.__pairs").alias("pair"), F.col("col.__times").alias("times")
        )
        counts = materialize(known.groupBy("pair").agg(F.sum("times").alias("__count")), "pair-counts")
        id_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("id_b")
        most = counts.groupBy(id_b).agg(F.max("__count").alias("most"))
        scored = counts.withColumn("id_b", id_b).join(most, "id_b").select(
            "pair", "__count", (F.col("__count") == F.col("most")).alias("__best")
        )
        values = known.select("__block", "__pos", "pair").join(scored, "pair").drop("pair")
        both = rows.drop("__pairs", "__times").unionByName(values, allowMissingColumns=True)
        kept = [f for f in rows.schema.fields if f.name not in _INNER.names]
        sums = [T.StructField(n, T.LongType()) for n in ("n_best", "count_sum")]
        return both.groupBy("__block").applyInArrow(_summed([f.name for f in kept]), T.StructType([*kept, *sums]))


def _summed(kept: list[str]):
    """Adds up, for each document of a block, what its windows' pairs count."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("__pos").is_valid()
        values = table.filter(kind).sort_by("__pos")
        rest = table.filter(pc.invert(kind))
        windows = rest.filter(rest.column("__window_sizes").is_valid())
        docs = rest.filter(rest.column("__windows").is_valid())
        place, sizes = (_unpacked(windows.column(c)[0].as_py()) for c in ("__window_pairs", "__window_sizes"))
        ends = np.append(0, np.cumsum(sizes))
        lists = [_unpacked(x) for x in docs.column("__windows").to_pylist()]
        used, stops = np.concatenate([np.empty(0, np.int64), *lists]), np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
        out = docs.select(kept)
        for name, column in (("n_best", "__best"), ("count_sum", "__count")):
            value = values.column(column).to_numpy().astype(np.int64)
            upto = np.append(0, np.cumsum(value[place]))
            per_window = upto[ends[1:]] - upto[ends[:-1]]
            total = np.append(0, np.cumsum(per_window[used]))
            out = out.append_column(name, pa.array(total[stops[1:]] - total[stops[:-1]]))
        return out

    return run


def align(docs: DataFrame, a: str, b: str, text: str = "text", digest: bool = False) -> Alignment:
    """The alignment of the tokens of each text by two tokenizers.

    `a` is the path of a byte-level BPE in the tokenizers library's JSON form, `b` that of a sentencepiece model that puts a
    blank before a text; both are read by the driver, have a fixed size, and go to the tasks whole. A text is tokenised with
    a blank before it and without special tokens. `groups` are the ids between shared ends, `a1,a2|b1` joined by `;`; they
    are several times as long as the text. With `digest` their SHA-256 stands in their place, and an empty text if there are none.

    Null and empty texts, and texts that the tokens' bytes do not give back, have no tokens, groups or links. A very long
    text is a block of its own; an unbroken one is one window, whose work and memory are in proportion to its tokens. Rows
    that are repeated count as they stand. The text is not carried on; columns of `docs` named as those added are replaced.
    """
    spark = docs.sparkSession
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        shared = spark.sparkContext.broadcast((f.read(), g.read()))
    added = [*_COUNTS.names, "groups", "n_best", "count_sum", *_INNER.names]
    kept = docs.drop(text, *added)
    fields = [*(T.StructField(f.name, f.dataType) for f in kept.schema.fields), *_COUNTS.fields, T.StructField("groups", T.StringType()), *_INNER.fields]
    names = kept.columns
    arrow = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shared.value)
        block, serial = Block(), TaskContext.get().partitionId() << 32

        def row(columns: dict, n: int) -> pa.RecordBatch:
            arrays = [
                columns[f.name].cast(f.type) if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type)
                if f.name in columns else pa.nulls(n, f.type) for f in arrow
            ]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        def closed() -> pa.RecordBatch:
            pairs, times, place, sizes = block.dictionary()
            return row({
                "__block": [serial], "__pairs": [pairs], "__times": [times], "__window_pairs": [_pack(place)],
                "__window_sizes": [_pack(sizes)],
            }, 1)

        for whole in batches:
            texts = whole.column(len(names)).to_pylist()
            for at, end in _runs(texts):
                *counts, groups, windows = aligner.align(texts[at:end], block)
                mine = whole.slice(at, end - at)
                if digest:
                    groups = [g and hashlib.sha256(g.encode()).hexdigest() for g in groups]
                yield row({
                    **{n: mine.column(k) for k, n in enumerate(names)},
                    **dict(zip(_COUNTS.names, counts, strict=True)), "groups": groups, "__block": [serial] * (end - at),
                    "__windows": windows,
                }, end - at)
                block.size += sum(len(t or "") for t in texts[at:end])
                if block.size >= BLOCK_BYTES:
                    yield closed()
                    block, serial = Block(), serial + 1
        if block.used:
            yield closed()

    rows = docs.select(*[F.col(f"`{n}`") for n in names], F.col(text).cast("string").alias("__text"))
    return Alignment(rows.mapInArrow(run, T.StructType(fields)))
