"""The pipeline against a brute-force version, and the awkward cases in every stage."""

from __future__ import annotations

import itertools
import random

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from test_joins import classes, mutated, shingles, words
from test_text_operators import ITEM_WORD, lower
from tokenizers import Tokenizer

import corpus_pipeline


def brute(rows, items):
    """(id, text) that the stages leave of (id, text); every text with a letter is in a known language."""
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    lines = [
        (i, k, shingles(words(x), 5)) for i, t in rows for k, x in enumerate(t.split("\n"))
    ]
    gone = {
        (i, k) for i, k, s in lines for j, m, o in lines if (j, m) < (i, k) and s and o and 10 * len(s & o) >= 8 * len(s | o)
    }
    cut = []
    for i, t in rows:
        left = [x for k, x in enumerate(t.split("\n")) if (i, k) not in gone]
        if len(left) == len(t.split("\n")) or words("\n".join(left)):
            cut.append((i, "\n".join(left)))
    sets = [(i, shingles(words(t), 5)) for i, t in cut]
    label = classes({i for i, _ in sets}, [
        (a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and 10 * len(x & y) >= 8 * len(x | y)
    ])
    out = []
    for i, t in cut:
        own = ITEM_WORD.findall(lower(t))
        hit = False
        for content in items:
            w = ITEM_WORD.findall(lower(content))
            n = min(10, len(w))
            windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            hit |= any(tuple(own[k : k + n]) in windows for k in range(len(own) - n + 1)) if n else False
        if label[i] == i and not hit:
            out.append((i, t))
    return out


def test_pipeline_rows(spark, rows, tmp_path):
    table = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows[:-2] if i != 14] + [
        (i, t.replace(" ", "\n", 1) if i % 7 == 0 else t, "en", "s", len(t)) for i, t, _ in mutated(random.Random(9), 40)
    ]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    items = ["sigma tau upsilon phi chi psi more words that never come", "one two"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = brute([(i, t) for i, t, *_ in table], items)
    assert sorted((r.doc_id, r.text, r.ids) for r in got.collect()) == sorted(
        (i, t, library.encode(t, add_special_tokens=False).ids) for i, t in want
    )
    assert got.where("not round_trip or n_chars <> length(text)").count() == 0


def test_stages_take_awkward_tables(spark, docs, tmp_path):
    items = spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = docs.withColumns({c: F.lit("old") for c in ("ids", "n_hit", "items", "n_removed", "lang_pred", "__id")})
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == table.columns, name
            assert out.where("n_hit = 'old' and ids = 'old'").count() == out.count(), name
        last = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path))
        assert last.count() == table.count() and last.columns.count("ids") == 1


def test_stages_send_bounded_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    stage = corpus_pipeline._tidy(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "n long, size long"))
    docs = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    try:
        spark.conf.unset(name)
        got = stage(spark, docs, "").collect()
        assert sum(r.n for r in got) == 3000 and max(r.size for r in got) < 5 << 20
        spark.conf.set(name, "1m")  # the caller's own bound stays
        stage(spark, docs, "")
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
