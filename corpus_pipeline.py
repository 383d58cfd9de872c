"""A corpus pipeline of five stages over `documents`; each stage reads what the one before it wrote."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.llm import bpe, decontaminate, line_dedup, parity_join, ppm
from ledgerloom.session import bound_batches, materialize, release, scratch_paths

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: A text whose code in the best language is no shorter than its bytes is in none of the languages.
MOST_BITS = 8.0


def _packed(docs: DataFrame) -> DataFrame:
    """Id and text, and the rest of the row beside them, so that no column of the documents meets one that a stage adds."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__row"))


def _rows(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of the documents again, some of them changed."""
    return [
        changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed
        else F.col("text" if c == "text" else f"__row.`{c}`").alias(c)
        for c in docs.columns
    ]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are in a language known from the labelled ones; `lang` becomes the predicted language.

    Texts that are null, have no letter or fit no language are rejected. Without any labelled document nothing can be
    judged, and all stay as they are.
    """
    model = ppm.Model.fit(docs, "lang", "text", "doc_id")
    if not model.languages:
        return docs
    judged = ppm.predict(_packed(docs), model)
    kept = judged.where((F.col("lang_pred") != ppm.UNKNOWN) & (F.col("bits_per_byte") < MOST_BITS))
    return kept.select(*_rows(docs, lang=F.col("lang_pred")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out lines that match an earlier line; documents that lose all their lines with words go."""
    cut = line_dedup.remove_matched_lines(_packed(docs))
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    kept = cut.where(~emptied)
    return kept.select(*_rows(docs, text=F.col("text"), n_chars=F.length("text")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each class of near copies the document with the smallest id; rows with one id stay or go together."""
    found = parity_join.link_components(docs)
    copies = materialize(found.where("id <> component_id").select("id").distinct(), "near-copies")
    rest = _packed(docs).join(copies, F.col("doc_id").cast("long") == F.col("id"), "left_anti")
    return rest.select(*_rows(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = decontaminate.contamination(_packed(docs), items).where("n_hit = 0")
    return clean.select(*_rows(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and whether decoding them gives the text back; columns so named are replaced."""
    coded = bpe.encode_decode(_packed(docs), TOKENIZER)
    old = [c for c in docs.columns if c.lower() not in ("ids", "n_tokens", "round_trip")]
    return coded.select(
        *_rows(docs.select(*old)), "ids", F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


_LEFT: list[str] = []


def _tidy(stage):
    """`stage`, which first drops the scratch tables of the stage called before it: that one's result is written by then.

    Its batches of text are bounded in bytes. That setting of the session stays, because the caller writes the result.
    """

    @wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _LEFT)
        _LEFT.clear()
        bound_batches(spark)
        before = set(scratch_paths())
        out = stage(spark, docs, sf_dir)
        _LEFT.extend(p for p in scratch_paths() if p not in before)
        return out

    return call


#: A stage's result must be written before the next stage is called.
STAGES = [
    ("language", _tidy(language)), ("line dedup", _tidy(lines)), ("near copies", _tidy(near_copies)),
    ("benchmark", _tidy(benchmark)), ("tokens", _tidy(tokens)),
]

#: Language models and token ids have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other; each result is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
