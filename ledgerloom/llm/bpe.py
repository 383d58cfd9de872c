"""Byte-pair encoding with a pair occurrence index, and decoding.

A worker gathers the distinct pieces of some texts that it has not met before and encodes them together: every adjacent pair
that has a rank is entered in an index from rank to all its positions, the active ranks are applied in ascending order,
each to all its positions from left to right, and the lists of the pairs that a merge makes are extended.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import annotate, code_points, resident

#: Distinct stretches of text a worker remembers the ids of; those not met for long go first. Longer ones are not kept.
REMEMBERED, LONGEST = 600_000, 64

#: Characters that a worker holds cut into stretches at a time.
AT_ONCE = 1 << 18

FIELDS = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType()),
])

# The code points with the property White_Space.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class Pieces:
    """The byte-level rule that cuts a text into pieces before any merge."""

    def __init__(self) -> None:
        letter, number = code_points("L"), code_points("N")
        #: Runs of anything but space, with one blank before them, and runs of space: pieces never cross their borders.
        self.stretches = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
        #: Places where space begins: what is on the left is cut into the same stretches with or without the rest.
        self.border = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])").search
        self.pieces = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+|[{_SPACE}]+"
        ).findall


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself if it is visible Latin-1, else a later one."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class Codec:
    """A vocabulary with its merges, and what this worker has encoded so far."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = {c: bytes([b]) for b, c in enumerate(_byte_letters())}
        self.bytes_of = {i: b"".join(letters[c] for c in token) for token, i in vocab.items()}
        self.first_ids = np.array([vocab[c] for c in _byte_letters()], np.int64)
        self.bytes_of.update((t["id"], t["content"].encode()) for t in spec["added_tokens"])
        self.added = {t["content"]: np.int32(t["id"]).tobytes() for t in spec["added_tokens"]}
        parts = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.rank = {vocab[a] << 32 | vocab[b]: k for k, (a, b) in enumerate(parts)}
        self.pair = [(vocab[a], vocab[b], vocab[a + b]) for a, b in parts]
        codes = np.array(list(self.rank), np.int64)
        self.pair_ranks = np.argsort(codes)
        self.pairs = codes[self.pair_ranks]
        self.cut = Pieces()
        self.split_added = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})").split
        # A special token's string is in no other stretch, so that both can be looked up in one place.
        self.known: dict[str, bytes] = dict(self.added)
        self.older: dict[str, bytes] = {}

    def merge_all(self, pieces: list[str]) -> list[bytes]:
        """The ids (as 32-bit numbers) of some pieces, by one pair occurrence index over all of them."""
        rank, pair = self.rank.get, self.pair
        raw = [p.encode() for p in pieces]
        ends = np.cumsum([len(b) + 1 for b in raw])
        # A border of -1 after each piece keeps pairs from crossing it.
        marks = np.ones(ends[-1] if len(ends) else 0, bool)
        marks[ends - 1] = False
        symbols = np.full(len(marks), -1, np.int64)
        symbols[marks] = self.first_ids[np.frombuffer(b"".join(raw), np.uint8)]
        index = self._occurrences(symbols)
        sym = symbols.tolist()
        after = list(range(1, len(sym) + 1))
        before = list(range(-1, len(sym) - 1))
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, ab = pair[r]
            for at in sorted(index.pop(r)):
                right = after[at]
                if sym[at] != a or sym[right] != b:
                    continue  # another merge took one of the two
                sym[at], sym[right] = ab, -2
                right = after[at] = after[right]
                before[right] = at
                left = before[at]
                if left >= 0 and (s := sym[left]) >= 0 and (k := rank(s << 32 | ab)) is not None:
                    if k in index:
                        index[k].append(left)
                    else:
                        index[k] = [left]
                        heapq.heappush(active, k)
                if (s := sym[right]) >= 0 and (k := rank(ab << 32 | s)) is not None:
                    if k in index:
                        index[k].append(at)
                    else:
                        index[k] = [at]
                        heapq.heappush(active, k)
        symbols = np.array(sym, np.int32)
        left_over = symbols >= 0
        packed = symbols[left_over].tobytes()
        stops = (np.cumsum(left_over)[ends - 1] * 4).tolist() if len(ends) else []
        return [packed[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def _occurrences(self, symbols: np.ndarray) -> dict[int, list[int]]:
        """The pair index at the start: the positions of each rank."""
        pairs = symbols[:-1] << 32 | symbols[1:]
        place = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        at = np.flatnonzero((self.pairs[place] == pairs) & (symbols[:-1] >= 0) & (symbols[1:] >= 0))
        ranks = self.pair_ranks[place[at]]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        first = np.flatnonzero(np.diff(ranks, prepend=-1))
        return {
            int(ranks[a]): at[a:b].tolist() for a, b in zip(first, [*first[1:], len(at)], strict=True)
        }

    def learn(self, stretches: set[str]) -> None:
        """Encode stretches of text not met before."""
        cut = {s: self.cut.pieces(s) for s in stretches}
        new = list({p for pieces in cut.values() for p in pieces})
        ids = dict(zip(new, self.merge_all(new), strict=True))
        for s, pieces in cut.items():
            self.known[s] = ids[pieces[0]] if len(pieces) == 1 else b"".join([ids[p] for p in pieces])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        runs: list[list[bytes]] = [[] for _ in texts]
        group, size = [], 0
        for own, text in zip(runs, texts, strict=True):
            for k, part in enumerate(self.split_added(text) if text else ()):
                # Every second part is a special token's string.
                for piece in [part] if k % 2 else self._segments(part):
                    group.append((own, [piece] if k % 2 else self.cut.stretches(piece)))
                    size += len(piece)
                    if size >= AT_ONCE:
                        self._look_up(group)
                        group, size = [], 0
        self._look_up(group)
        return [np.frombuffer(b"".join(own), np.int32) for own in runs]

    def _segments(self, part: str) -> Iterator[str]:
        """A long text in segments that have its stretches."""
        at = 0
        while len(part) - at > AT_ONCE and (border := self.cut.border(part, at + AT_ONCE)):
            yield part[at : border.start()]
            at = border.start()
        yield part[at:] if at else part

    def _look_up(self, group: list[tuple[list[bytes], list[str]]]) -> None:
        """Append the ids of the stretches beside each list to it."""
        met = set().union(*[stretches for _, stretches in group])
        new = met.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED // 2:
            self.known, self.older = dict(self.added), self.known
            new = met.difference(self.known)
        back = new.intersection(self.older)
        self.known.update((s, self.older[s]) for s in back)
        new -= back
        if new:
            self.learn(new)
        get = self.known.__getitem__
        for own, stretches in group:
            own.append(b"".join(map(get, stretches)))
        for s in new:
            if len(s) > LONGEST:
                del self.known[s]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """`docs` with `ids`, the token ids of each text, and `decoded`, the text that the ids decode to.

    `tokenizer` is the path of a byte-level BPE file in the tokenizers library's JSON form, read by the driver; it is a
    vocabulary of fixed size and goes to the tasks whole. A special token's string in a text becomes that token. Null and
    empty texts have no ids and decode to the empty text. Columns of `docs` so named are replaced.
    """
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    name = f"bpe {uuid.uuid4().hex}"

    def start():
        codec = resident(name, lambda: Codec(vocabulary.value))

        def work(texts: list) -> list:
            ids = codec.encode(texts)
            offsets = np.cumsum([0] + [len(x) for x in ids])
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()),
                type=pa.list_(pa.field("element", pa.int32(), False)),
            )
            return [lists, [codec.decode(x) for x in ids]]

        return work

    return annotate(docs, text, FIELDS, start)
