"""Quality rules on repetition, by suffix arrays over words.

The suffixes of a text's words are sorted by prefix doubling, ranks are kept per round, and the longest common prefixes of
neighbours follow from the ranks. The intervals of the suffix array whose common prefix is longer than that of their
surroundings are the repeated runs of words that cannot be made longer to the right; those whose occurrences are not all
preceded by the same word are maximal. The union of their occurrences and the longest of them are limited. Inside long
words, which stand for text without blanks, repeated strings of characters are part of that union.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import annotate, mix

#: Windows of so many words are looked for by the base rule.
WINDOW = 8
#: Shorter repeats are no repeats to the method: words, and characters inside words of more than `LONG_WORD` characters.
LEAST_WORDS, LEAST_CHARS, LONG_WORD = 4, 20, 40
#: The base rule: fewest words, and most words in repeated windows, in percent.
FEWEST_WORDS, MOST_REPEATED = 20, 30
#: The method's limits: share of a text's characters in maximal repeats, and words of the longest repeat.
MOST_COVERED, LONGEST_REPEAT = 0.3, 100

#: Words whose suffixes are sorted together, and characters of long words looked at together.
AT_ONCE, CHARS_AT_ONCE = 1 << 18, 1 << 20

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"

FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("n_repeats", T.LongType()),
    T.StructField("longest_repeat", T.LongType()),
    T.StructField("covered_chars", T.LongType()),
    T.StructField("repeat_spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ]))),
])


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the common prefix of each with the one before it (0 for the first).

    Prefix doubling: a round sorts only suffixes that still share their rank with another. A word that ends a text must
    have an id that occurs nowhere else, so that no common prefix runs on into the next text.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    new = np.diff(ids[order], prepend=ids[order[:1]] - 1) != 0
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    ranks, step = [rank], 1
    while True:
        place = rank[order]
        tied = np.flatnonzero((place != np.arange(n)) | np.append(place[1:] == place[:-1], False))
        if not len(tied):
            break
        own = order[tied]
        # A suffix too short for the second half has a unique end before, so it is not tied.
        second = rank[own + step]
        by = np.lexsort((second, rank[own]))
        order[tied] = own = own[by]
        first, second = rank[own], second[by]
        new = np.ones(len(own), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank = rank.copy()
        rank[own] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        ranks.append(rank)
        step *= 2
    common = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    open_ = np.arange(n - 1)
    for k in range(len(ranks) - 1, -1, -1):
        same = (a[open_] + common[open_ + 1] < n) & (b[open_] + common[open_ + 1] < n)
        at = open_[same]
        at = at[ranks[k][a[at] + common[at + 1]] == ranks[k][b[at] + common[at + 1]]]
        common[at + 1] += 1 << k
    return order, common


def maximal_repeats(ids: np.ndarray, order: np.ndarray, common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first place in the suffix array, behind the last) of every maximal repeat of `least` words or more.

    A stack walks the places with a common prefix of that length; the others close all intervals.
    """
    before = np.where(order > 0, ids[order - 1], -1)
    places = np.flatnonzero(common >= least).tolist()
    lengths = common[places].tolist()
    left = before[places].tolist()
    neighbour = before[np.array(places, np.int64) - 1].tolist()
    found: list[tuple[int, int, int]] = []
    stack: list[list] = []  # length, first place, the word before all occurrences or None if they differ

    def close(down_to: int, end: int) -> tuple[int, object] | None:
        """Close the intervals longer than `down_to`; the first place and the preceding word of the last one closed."""
        last = None
        while stack and stack[-1][0] > down_to:
            length, first, word = stack.pop()
            if last is not None:
                word = word if word == last[1] else None
            if word is None:
                found.append((length, first, end))
            last = (first, word)
            if stack and stack[-1][0] >= down_to and word != stack[-1][2]:
                stack[-1][2] = None
        return last

    previous = -2
    for place, length, word, other in zip(places, lengths, left, neighbour, strict=True):
        if place != previous + 1:
            close(0, previous + 1)
            stack.clear()
        last = close(length, place)
        if stack and stack[-1][0] == length:
            top = stack[-1]
            if top[2] != word:
                top[2] = None
        else:
            start, known = last if last is not None else (place - 1, other)
            stack.append([length, start, word if word == known else None])
        previous = place
    close(0, previous + 1)
    return found


class Rules:
    """Counts and repeats of a batch of texts: windows of `window` words, repeats of `least` words or more."""

    def __init__(self, window: int, least: int | None = None) -> None:
        self.window, self.least = window, window if least is None else least

    def __call__(self, texts: list[str | None]) -> list[list]:
        rows: list[list] = []
        at = 0
        while at < len(texts):
            words, end, size = [], at, 0
            while end < len(texts) and (end == at or size < AT_ONCE):
                words.append(texts[end].encode().split() if texts[end] else [])
                size += len(words[-1])
                end += 1
            for text, own, repeats in zip(texts[at:end], words, self._repeats(words), strict=True):
                rows.append(_counts(text, own) + repeats)
            at = end
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in FIELDS]

    def _repeats(self, texts: list[list[bytes]]) -> list[list]:
        """Per text: words in repeated windows, maximal repeats, the longest, characters and spans in their union."""
        ids: dict[tuple[int, bytes] | bytes, int] = {}
        flat: list[int] = []
        for k, words in enumerate(texts):
            local: dict[bytes, int] = {}
            base = len(ids) + k
            flat += [base + local.setdefault(w, len(local)) for w in words]
            ids.update(((k, w), 0) for w in local)
            flat.append(-1 - k)
        data = np.array(flat, np.int64)
        sizes = np.array([len(w) for w in texts])
        starts = np.cumsum(sizes + 1) - sizes - 1
        order, common = suffix_array(data)
        reach = np.zeros(len(data), np.int64)  # the longest repeat that starts at each word
        reach[order] = np.maximum(common, np.append(common[1:], 0))
        window = self._cover(np.where(reach >= self.window, self.window, 0))
        whole = self._cover(np.where(reach >= self.least, reach, 0))
        lengths = np.array([len(w.decode()) for words in texts for w in [*words, b""]])
        covered = np.where(whole, lengths, 0)
        long = np.flatnonzero((lengths > LONG_WORD) & ~whole)
        if len(long):
            covered[long] = self._inside(texts, starts, np.flatnonzero(lengths > LONG_WORD), lengths)[long]
        repeats = maximal_repeats(data, order, common, self.least)
        number = np.bincount(
            np.searchsorted(starts, order[[r[1] for r in repeats]], "right") - 1, minlength=len(texts)
        ) if repeats else np.zeros(len(texts), np.int64)
        longest = np.zeros(len(texts), np.int64)
        if repeats:
            owner = np.searchsorted(starts, order[[r[1] for r in repeats]], "right") - 1
            np.maximum.at(longest, owner, [r[0] for r in repeats])
        out = []
        for k, (start, size) in enumerate(zip(starts, sizes, strict=True)):
            own = whole[start : start + size]
            edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
            spans = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
            out.append([
                int(window[start : start + size].sum()), int(number[k]), int(longest[k]),
                int(covered[start : start + size].sum()), spans,
            ])
        return out

    def _inside(
        self, texts: list[list[bytes]], starts: np.ndarray, long: np.ndarray, lengths: np.ndarray
    ) -> np.ndarray:
        """Per word, the characters of a long one in strings that occur more than once in the long words of its text.

        The union of all repeats of `LEAST_CHARS` or more is that of the repeated strings of just so many characters; these
        are told apart by 64-bit hashes. `long` are the places of the long words.
        """
        out = np.zeros(len(lengths), np.int64)
        owner = np.searchsorted(starts, long, "right") - 1
        at = 0
        while at < len(long):
            end, size = at, 0
            while end < len(long) and (size < CHARS_AT_ONCE or owner[end] == owner[end - 1]):
                size += lengths[long[end]]
                end += 1
            own, places = owner[at:end], long[at:end]
            words = [texts[k][place - starts[k]].decode() for k, place in zip(own, places, strict=True)]
            codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
            word = np.repeat(np.arange(len(words)), lengths[places])
            n = len(codes) - LEAST_CHARS + 1
            token = own[word[:n]].astype(np.uint64)
            for k in range(LEAST_CHARS):
                token = mix(token * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n])
            inside = np.flatnonzero(word[:n] == word[LEAST_CHARS - 1 :])
            _, back, count = np.unique(token[inside], return_inverse=True, return_counts=True)
            reach = np.zeros(len(codes), np.int64)
            reach[inside[count[back] > 1]] = LEAST_CHARS
            out[places] = np.bincount(word[self._cover(reach)], minlength=len(words))
            at = end
        return out

    @staticmethod
    def _cover(reach: np.ndarray) -> np.ndarray:
        """Which words lie within `reach` words from an earlier one or themselves."""
        edge = np.zeros(len(reach) + 1, np.int64)
        at = np.flatnonzero(reach)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + reach[at], -1)
        return np.cumsum(edge[:-1]) > 0


def _counts(text: str | None, words: list[bytes]) -> list[int]:
    """Words, their characters, symbols, and lines with a word that equal an earlier one."""
    if not text:
        return [0, 0, 0, 0]
    raw = text.encode()
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    return [
        len(words), len(text) - (len(raw) - len(raw.translate(None, _SPACE))),
        len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)),
    ]


def judge(
    docs: DataFrame, text: str = "text", window: int = WINDOW, most_covered: float = MOST_COVERED,
    longest_repeat: int = LONGEST_REPEAT, least: int = LEAST_WORDS,
) -> DataFrame:
    """`docs` with the counts in `FIELDS`, `base_failed` and `kept`.

    Words are runs of anything but ASCII blanks. `repeat_spans` are the runs of words in maximal repeats of `least` words
    or more (first, behind the last); `covered_chars` are the characters of these words, and of other long words those in
    repeated strings of `LEAST_CHARS` or more. The base rule looks for windows of `window` words. A text is kept unless it
    fails the base rule, more than `most_covered` of its word characters are covered, or its longest repeat has more than
    `longest_repeat` words. Null, empty and blank texts have no words and fail the base rule. Columns so named are replaced.
    """
    counted = annotate(docs.drop("base_failed", "kept"), text, FIELDS, lambda: Rules(window, least))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    fine = (F.col("covered_chars") <= most_covered * F.col("word_chars")) & (F.col("longest_repeat") <= longest_repeat)
    return counted.withColumns({"base_failed": failed, "kept": ~failed & fine})
