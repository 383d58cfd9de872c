"""Secret scans that look through encodings.

The layers of a text form a worklist. A layer is scanned for secrets, and it may give rise to further layers: itself with
its URL and Unicode escapes undone, and one layer for each stretch of base64 in it, whose bytes are unpacked first if they
are compressed. This goes on until no layer brings a new one. A layer that was met before, the same characters for the same
place of the text, is not taken again, so circles end. Each layer knows for every character which part of the text it
comes from, and all spans are given in the text itself.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import html
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import annotate

#: Kinds in the order in which spans of one start are listed: pattern, group that is measured, least characters of it.
KINDS: dict[str, tuple[re.Pattern, int, int]] = {
    "assign": (
        re.compile(
            r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
        ), 2, 8,
    ),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),  # maximal runs, as the run has only these characters
}

#: Characters one text may unpack to, over all its layers.
UNPACKED = 64 << 20
#: Shortest stretch of base64 that is tried, and fewest characters of a text found in one.
LEAST_ENCODED, LEAST_DECODED = 16, 8

SPAN = T.StructType([
    T.StructField("kind", T.StringType(), False), T.StructField("start", T.IntegerType(), False),
    T.StructField("end", T.IntegerType(), False), T.StructField("layers", T.StringType(), False),
])
FIELDS = T.StructType([
    T.StructField("secrets", T.ArrayType(SPAN, False), False), T.StructField("n_layers", T.IntegerType(), False),
    T.StructField("n_unread", T.IntegerType(), False),
])

_ESCAPES = re.compile(
    r"(?P<url>(?:%[0-9A-Fa-f]{2})+)|(?P<code>(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\})"
    r"|(?P<byte>(?:\\x[0-9A-Fa-f]{2})+)|(?P<mark>&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});)"
)
_MAY_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&#[0-9xX]")
# Lines of base64 as mail writes them, then a last one; or one run.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{60,76}\r?\n)*[A-Za-z0-9+/_-]{16,}={0,2}")
_SEPARATORS = re.compile(r"[+/_-]+")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_URL_SAFE = bytes.maketrans(b"-_", b"+/")


@dataclass
class Layer:
    """Characters, the way that led to them, and the places they come from.

    Piece k of the characters starts at `at[k]` and comes from the text from `low[k]` to before `high[k]`: character by
    character where `exact[k]`, as a whole elsewhere.
    """

    text: str
    way: str
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    exact: np.ndarray

    def places(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of the text that the characters from `starts` to before `ends` come from."""
        k, m = np.searchsorted(self.at, starts, "right") - 1, np.searchsorted(self.at, ends - 1, "right") - 1
        return (
            np.where(self.exact[k], self.low[k] + starts - self.at[k], self.low[k]),
            np.where(self.exact[m], self.low[m] + ends - self.at[m], self.high[m]),
        )

    def place(self, start: int, end: int) -> tuple[int, int]:
        low, high = self.places(np.array([start]), np.array([end]))
        return int(low[0]), int(high[0])

    def key(self) -> tuple:
        return hash(self.text), len(self.text), *self.place(0, len(self.text))


def _layer(text: str, way: str, at, low, high, exact) -> Layer:
    return Layer(text, way, *(np.asarray(x, np.int64) for x in (at, low, high)), np.asarray(exact, bool))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The matches of each kind, leftmost and without overlap, that are long enough."""
    out = []
    for kind, (pattern, group, least) in KINDS.items():
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((kind, m.start(), m.end()))
    return out


def _escapes_undone(layer: Layer) -> Iterator[Layer]:
    """The layer with every URL and Unicode escape that stands for characters replaced by them."""
    text = layer.text
    if not _MAY_ESCAPE.search(text):
        return
    pieces: list[str] = []
    rows: list[tuple[int, int, int, bool]] = []  # start and end in the layer, place in the new one, whether it stays
    size = done = 0
    for m in _ESCAPES.finditer(text):
        units = _units(m)
        if units is None:
            continue
        for piece, start, end, stays in (
            (text[done : m.start()], done, m.start(), True),
            *((c, m.start() + low, m.start() + high, False) for c, low, high in units),
        ):
            if piece:
                pieces.append(piece)
                rows.append((start, end, size, stays))
                size += len(piece)
        done = m.end()
    if not rows:
        return
    if done < len(text):
        pieces.append(text[done:])
        rows.append((done, len(text), size, True))
        size += len(text) - done
    start, end, at, stays = np.array(rows, np.int64).T
    # What stays is cut where a piece of the layer begins, because the pieces' places may be whole ones.
    k = np.maximum(np.searchsorted(start, layer.at, "right") - 1, 0)
    inside = (stays[k] == 1) & (layer.at > start[k]) & (layer.at < end[k])
    k, cut = k[inside], layer.at[inside]
    start, at = np.append(start, cut), np.append(at, at[k] + cut - start[k])
    end, stays = np.append(end, end[k]), np.append(stays, stays[k]).astype(bool)
    order = np.argsort(at, kind="stable")
    start, at, end, stays = start[order], at[order], end[order], stays[order]
    end = np.where(stays, start + np.append(at[1:], size) - at, end)
    low, high = layer.places(start, end)
    exact = stays & layer.exact[np.searchsorted(layer.at, start, "right") - 1]
    yield _layer("".join(pieces), layer.way + "escape/", at, low, high, exact)


def _units(m: re.Match) -> list[tuple[str, int, int]] | None:
    """The characters of a match of `_ESCAPES`, each with its part of the match; None if it stands for none."""
    found = m.group()
    if m.lastgroup in ("url", "byte"):
        wide = 3 if m.lastgroup == "url" else 4
        try:
            decoded = bytes(int(found[k + wide - 2 : k + wide], 16) for k in range(0, len(found), wide)).decode()
        except UnicodeDecodeError:
            return None
        out, byte = [], 0
        for c in decoded:
            n = len(c.encode())
            out.append((c, byte * wide, (byte + n) * wide))
            byte += n
        return out
    if m.lastgroup == "mark":
        plain = html.unescape(found)
        return None if plain == found or not plain else [(plain, 0, len(found))]
    if found.startswith("\\u{") or found.startswith("\\U"):
        code = int(found.strip("\\uU{}"), 16)
        return None if code > 0x10FFFF or 0xD800 <= code < 0xE000 else [(chr(code), 0, len(found))]
    codes = [int(found[k + 2 : k + 6], 16) for k in range(0, len(found), 6)]
    out, k = [], 0
    while k < len(codes):
        if 0xD800 <= codes[k] < 0xDC00 and k + 1 < len(codes) and 0xDC00 <= codes[k + 1] < 0xE000:
            out.append((chr(0x10000 + ((codes[k] - 0xD800) << 10) + codes[k + 1] - 0xDC00), 6 * k, 6 * k + 12))
            k += 2
        elif 0xD800 <= codes[k] < 0xE000:
            out.append((found[6 * k : 6 * k + 6], 6 * k, 6 * k + 6))  # half of a pair stays as it is written
            k += 1
        else:
            out.append((chr(codes[k]), 6 * k, 6 * k + 6))
            k += 1
    return out


class TooLarge(Exception):
    """What is packed holds more than may be unpacked."""


def unpacked(data: bytes, most: int) -> tuple[bytes, bool]:
    """`data` decompressed, layer after layer, and whether it was compressed at all."""
    packed = False
    while True:
        if data[:2] == b"\x1f\x8b":
            make = lambda: zlib.decompressobj(31)
        elif len(data) > 5 and data[0] == 0x78 and int.from_bytes(data[:2], "big") % 31 == 0:
            make = zlib.decompressobj
        elif data[:3] == b"BZh":
            make = bz2.BZ2Decompressor
        elif data[:6] == b"\xfd7zXZ\x00":
            make = lzma.LZMADecompressor
        else:
            return data, packed
        try:
            reader = make()
            out = reader.decompress(data, most + 1)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            return data, packed
        if len(out) > most:
            raise TooLarge
        if not reader.eof or out == data:
            return data, packed
        data, packed = out, True


def _plain(data: bytes) -> str | None:
    """The text that bytes are, if they are one."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if len(text) >= LEAST_DECODED and not _CONTROL.search(text) else None


def _encoded_parts(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that may be base64, each followed by its rests behind a sign, in case something else stands before."""
    for m in _BASE64.finditer(text):
        yield m.span()
        if "\n" not in m.group():
            for sign in _SEPARATORS.finditer(text, *m.span()):
                if m.end() - sign.end() >= LEAST_ENCODED:
                    yield sign.end(), m.end()


def _decoded(text: str, start: int, end: int) -> bytes | None:
    """The bytes of base64; None once they turn out to be neither text nor compressed, however long the rest is."""
    size = 64
    while size < end - start:
        head = base64.b64decode(text[start : start + size].encode().translate(_URL_SAFE))
        if not head.startswith((b"\x1f\x8b", b"x", b"BZh", b"\xfd7zXZ")):
            try:
                codecs.utf_8_decode(head, "strict", False)
            except UnicodeDecodeError:
                return None
        size *= 4
    raw = text[start:end].rstrip("=").encode().translate(_URL_SAFE)
    return None if len(raw) % 4 == 1 else base64.b64decode(raw + b"=" * (-len(raw) % 4))


def _base64_layers(layer: Layer, most: int, refused: Callable[[], None]) -> Iterator[Layer]:
    taken = -1  # where the last stretch that was a text ends
    for start, end in _encoded_parts(layer.text):
        if start < taken:
            continue
        lines = layer.text.find("\n", start, end) >= 0
        letters = layer.text[start:end].replace("\r", "").replace("\n", "") if lines else ""
        data = _decoded(letters, 0, len(letters)) if lines else _decoded(layer.text, start, end)
        if data is None:
            continue
        try:
            inner, packed = unpacked(data, most)
        except TooLarge:
            refused()
            taken = end
            continue
        text = _plain(inner)
        if text is None:
            continue
        taken = end
        if packed:
            yield _layer(text, layer.way + "base64/packed/", [0], *([x] for x in layer.place(start, end)), [False])
            continue
        place = np.arange(start, end)
        if lines:
            place = place[[c not in "\r\n" for c in layer.text[start:end]]]
        raw = np.frombuffer(inner, np.uint8)
        first = np.flatnonzero(raw & 0xC0 != 0x80)  # the first byte of each character
        behind = np.append(first[1:], len(raw))
        low, high = layer.places(place[first * 4 // 3], place[(behind * 8 - 1) // 6] + 1)
        yield _layer(text, layer.way + "base64/", np.arange(len(first)), low, high, np.zeros(len(first), bool))


def scan(text: str, most: int = UNPACKED) -> tuple[list[tuple[str, int, int, str]], int, int]:
    """Spans (kind, start, end, layers) of a text, how many layers were read, and how many were too large to be.

    Spans are ordered by start, kind and end; a span that several layers show is listed once, with the first of them.
    """
    rank = {kind: k for k, kind in enumerate(KINDS)}
    found: dict[tuple[str, int, int], str] = {}
    unread = 0
    left = most

    def refused() -> None:
        nonlocal unread
        unread += 1

    work = [_layer(text, "", [0], [0], [len(text)], [True])] if text else []
    met = {layer.key() for layer in work}
    for layer in work:  # grows while it is read
        for kind, start, end in base_spans(layer.text):
            found.setdefault((kind, *layer.place(start, end)), layer.way.rstrip("/"))
        for makers in (_escapes_undone(layer), _base64_layers(layer, left, refused)):
            for new in makers:
                if not new.text or new.key() in met:
                    continue
                if "packed" in new.way and len(new.text) > left:
                    refused()
                    continue
                left -= len(new.text) if "packed" in new.way else 0
                met.add(new.key())
                work.append(new)
    spans = sorted(found, key=lambda s: (s[1], rank[s[0]], s[2]))
    return [(*s, found[s]) for s in spans], len(work), unread


def find_secrets(docs: DataFrame, text: str = "text", most: int = UNPACKED) -> DataFrame:
    """`docs` with `secrets`, `n_layers` and `n_unread`.

    `secrets` are spans of the text in code points, end exclusive: kind, start, end, and the `layers` that had to be undone
    (empty for what the text shows itself; "escape", "base64", "packed" joined by "/"). All that the patterns match in the
    text itself is among them; a span that a layer shows at the same place is not repeated. Undone are runs of %XX and \\xXX
    that are UTF-8, \\uXXXX, \\u{X}, \\UXXXXXXXX and &#N; escapes; base64 of both alphabets from 16 letters on, over several
    lines too, whose bytes are text without control characters; in base64 also gzip, zlib, bz2 and xz. A `+` is never a
    blank.

    Null and empty texts have no layers and no spans; a long text costs time and memory in proportion to it, and its layers
    in proportion to what they hold. What is packed may take at most `most` characters of one text; layers beyond are not
    read, and `n_unread` counts them, so nothing is left out unseen. Columns of `docs` so named are replaced; rows that
    are repeated are scanned as they stand.
    """

    def start():
        def work(texts: list) -> list:
            out: list[list] = [[], [], []]
            for t in texts:
                spans, layers, unread = scan(t or "", most)
                out[0].append([{"kind": k, "start": a, "end": b, "layers": way} for k, a, b, way in spans])
                out[1].append(layers)
                out[2].append(unread)
            return out

        return work

    return annotate(docs, text, FIELDS, start)


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
