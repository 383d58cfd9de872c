"""Token alignment against a pairwise comparison of all tokens, and corpus counts against plain counting."""

from __future__ import annotations

import collections
import hashlib
import random

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from ledgerloom.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """Per text: numbers of tokens, groups and links, groups as text, and the links themselves."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    out = []
    letters = {c: bytes([b]) for b, c in enumerate(alignment._byte_letters())}
    for text in texts:
        spans = []
        if text:
            a = one.encode(" " + text, add_special_tokens=False).ids
            b = two.encode(text)
            parts_a = [b"".join(letters[c] for c in one.id_to_token(k)) for k in a]
            parts_b = [
                bytes([int(two.id_to_piece(k)[3:-1], 16)]) if two.is_byte(k) else two.id_to_piece(k).replace("\u2581", " ").encode()
                for k in b
            ]
            if b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
                for ids, parts in ((a, parts_a), (b, parts_b)):
                    at, own = 0, []
                    for k, p in zip(ids, parts, strict=True):
                        own.append((at, at + len(p), k))
                        at += len(p)
                    spans.append(own)
        if not spans:
            out.append((0, 0, 0, 0, "", []))
            continue
        x, y = spans
        links = [(k, m) for s, e, k in x for t, f, m in y if s < f and t < e]
        shared = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        groups, start = [], 0
        for end in shared:
            groups.append("|".join(",".join(str(k) for s, e, k in z if start <= s and e <= end) for z in spans))
            start = end
        out.append((len(x), len(y), len(shared), len(links), ";".join(groups), links))
    return out


ODD = [
    None, "", " ", "  x", "a", "token of a word", "<|endoftext|> and <s> </s> <unk>", "tab\tand\nline\r\n\x0b\x00 null", "é漢字🙂🙂 ½ Ⅷ \u2581 marked",
    "under\u2581score", "   many    blanks   ", "\u00a0no-break\u2003wide\u3000", "e\u0301 combining", "\ufeffmark", "x" * 500, "naïve café " * 50,
    "🙂" * 40, "\ufb01 ligature \uff21", "1234567890 12,345.67", "don't we'll I'M",
]


def test_the_rule_of_cutting_is_that_of_the_library():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        both = alignment.Tokenizers(f.read(), g.read())
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    for start in range(0, 0x3000, 64):
        text = " ".join(f"a{c}b 1{c}2 {c} .{c}{c} {c}x\n{c}'s" for c in map(chr, range(start, start + 64)))
        assert both.a.encode_to_numpy(text, disallowed_special=()).tolist() == library.encode(text, add_special_tokens=False).ids


def random_texts(n):
    rnd = random.Random(5)
    words = ["the", "window", "tokenisation", "Straße", "función", "漢", "a1b2", "--", "x\n", "", "🙂", "supercalifragilistic"]
    return [" ".join(rnd.choices(words, k=rnd.randrange(0, 30))) for _ in range(n)]


def test_windows_against_all_pairs():
    texts = ODD + random_texts(60)
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        aligner = alignment.Aligner(alignment.Tokenizers(f.read(), g.read()), {})
    want = brute(texts)
    assert sum(w[0] > 0 for w in want) > 70 and any(t and not w[0] for t, w in zip(texts, want, strict=True))
    for _ in range(2):  # the second time from memory
        block = alignment.Block()
        for some in (slice(0, 30), slice(30, None)):
            got = aligner.align(texts[some], block)
            assert [tuple(r) for r in zip(*(list(c) for c in got[:5]), strict=True)] == [w[:5] for w in want[some]]
        pairs, times, place, sizes = block.dictionary()
        counted = collections.Counter(link for w in want for link in w[5])
        assert {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(n) for p, n in zip(pairs, times, strict=True)} == counted
        assert sizes.sum() == len(place)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        aligner = alignment.Aligner(alignment.Tokenizers(f.read(), g.read()), {})
    texts = random_texts(20) + ["y" * 400]
    for _ in range(3):
        got = aligner.align(texts, alignment.Block())
        assert got[4] == [w[4] for w in brute(texts)]


def expected(rows):
    found = brute([t for _, t in rows])
    count = collections.Counter(link for w in found for link in w[5])
    most = collections.defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted(
        (i, *w[:4], sum(count[x] == most[x[1]] for x in w[5]), sum(count[x] for x in w[5]),
         hashlib.sha256(w[4].encode()).hexdigest() if w[0] else "")
        for (i, _), w in zip(rows, found, strict=True)
    )


def test_counts_over_the_corpus(spark, monkeypatch, tmp_path):
    rows = list(enumerate([t for t in ODD if t != "x" * 500] + random_texts(80)))
    rows += [(3, "  x"), (None, "a word without an id"), (200, rows[30][1])]
    frame = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_a int").repartition(5)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in queries.op13_alignment(spark, str(tmp_path)).collect()), key=lambda r: (r[0] is not None, *r[1:], r[0] or 0))
    want = sorted(
        [w for w in expected([(i if i is not None else -1, t) for i, t in rows])], key=lambda r: (r[0] != -1, *r[1:], r[0])
    )
    assert [(r[0] if r[0] is not None else -1, *r[1:]) for r in got] == want


def test_awkward_tables(spark, docs, all_rows):
    table = docs.withColumnsRenamed({"n_words": "groups", "score": "__block", "component_id": "n_best"})
    found = alignment.align(table, A, B)
    assert sorted(found.documents().columns) == sorted(["doc_id", "lang", "source", "n_a", "n_b", "n_groups", "n_links", "groups"])
    want = sorted((i, *w[:5]) for (i, _, _), w in zip(all_rows, brute([t if len(t or "") < 9000 else "" for _, t, _ in all_rows]), strict=True))
    got = sorted(tuple(r) for r in found.documents().select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups").collect())
    short = {i for i, t, _ in all_rows if len(t or "") < 9000}
    assert [r for r in got if r[0] in short] == [r for r in want if r[0] in short]
    whole = found.with_counts()
    assert whole.count() == len(all_rows)
    assert whole.where("n_a = 0 and (n_links > 0 or n_best > 0 or count_sum > 0 or groups <> '')").count() == 0
    assert alignment.align(table.limit(0), A, B).with_counts().count() == 0
