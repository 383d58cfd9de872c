"""Finding the file behind a mined invoice key.

Candidates are never paired up. Every file announces the keys it can answer to (prefixes of its stem in the lengths that
keys have, its normalised stem); per key only counts and one file number are kept. There are as many announcements per
file as keys have different lengths up to its own, and counting absorbs prefixes that a large share of all files share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import strip
from ..functions.mining import normalize_key
from ..session import materialize
from .joins import lookup_join


def lookup_index(lookup: DataFrame) -> DataFrame:
    """Lookup rows by normalised invoice key, and by normalised vendor number where that differs."""
    tidy = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    names = F.array_distinct(F.array(normalize_key(tidy("invoice_key")), normalize_key(tidy("vendor_invoice_no"))))
    return lookup.select(
        F.explode(F.filter(names, lambda k: k != "")).alias("index_key"), "csv_row", "gnl_ref",
        F.when(F.col("pages") != "", F.col("pages")).alias("pages"), "gl_entityids",
    )


def file_index(files: DataFrame) -> DataFrame:
    """Files by normalised stem."""
    return files.select(normalize_key(F.col("stem")).alias("file_key"), "stem").where("file_key <> ''")


def match_lookup_rows(files: DataFrame, index: DataFrame) -> DataFrame:
    """Each file with the pages and entities of its lookup row.

    The stem up to `__` names the key. A single row of that key is the match; among several, the first whose reference
    equals the part after `__`.
    """
    at = F.instr("stem", "__")
    true_key = F.when(at > 0, F.substring(F.col("stem"), F.lit(1), at - 1)).otherwise(F.col("stem"))
    ref = F.when(at > 0, F.substring(F.col("stem"), at + 2, F.length("stem")))
    row = F.struct("pages", "gl_entityids")
    by_ref = index.groupBy("index_key", "gnl_ref").agg(F.count(F.lit(1)).alias("n"), F.min_by(row, "csv_row").alias("row"))
    by_key = by_ref.groupBy("index_key").agg(
        F.sum("n").alias("n"), F.any_value("row").alias("only")
    ).withColumnRenamed("index_key", "true_key")
    by_ref = by_ref.select(F.col("index_key").alias("true_key"), F.col("gnl_ref").alias("file_ref"), F.col("row").alias("by_ref"))
    named = files.select("stem", true_key.alias("true_key"), ref.alias("file_ref"))
    joined = lookup_join(named, by_key, ["true_key"], "stem", salts=0)
    joined = lookup_join(joined, by_ref, ["true_key", "file_ref"], "stem")
    match = F.when(F.col("n") == 1, F.col("only")).when(F.col("n") > 1, F.col("by_ref"))
    return joined.select("stem", match.alias("row")).select("stem", "row.pages", "row.gl_entityids")


def numbered_files(files: DataFrame, lookup: DataFrame) -> DataFrame:
    """Files with their lookup rows and a number each, written once so that the numbers hold."""
    matched = match_lookup_rows(files, lookup_index(lookup))
    return materialize(matched.withColumn("file_no", F.monotonically_increasing_id()), "invoice-files")


def key_lengths(keys: DataFrame) -> list[int]:
    """The lengths that keys looked for have: one small number per length that occurs."""
    lengths = keys.select(F.length("key").alias("n")).where(F.col("n") > 0).distinct()
    return sorted(r.n for r in lengths.collect())


def _prefixes(stem: Column, lengths: list[int]) -> Column:
    known = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(stem))
    return F.transform(known, lambda n: F.substring(stem, F.lit(1), n))


def file_answers(files: DataFrame, lengths: list[int]) -> DataFrame:
    """Per key: the file of exactly that stem, how many stems start with it, how many normalise to it.

    `prefix_no` and `norm_no` are the file where the count is one. Only numbers are aggregated.
    """
    say = lambda k, normalised: F.struct(k.alias("key"), F.lit(normalised).alias("normalised"))
    said = F.concat(
        F.transform(_prefixes(F.col("stem"), lengths), lambda k: say(k, False)),
        F.array(say(normalize_key(F.col("stem")), True)),
    )
    rows = files.select(F.explode(said).alias("said"), "stem", "file_no").select("said.*", "stem", "file_no").where("key <> ''")
    by_norm, by_stem, number = F.col("normalised"), ~F.col("normalised"), F.col("file_no")
    return rows.groupBy("key").agg(
        F.max(F.when(by_stem & (F.col("key") == F.col("stem")), number)).alias("exact_no"),
        F.count_if(by_stem).alias("n_prefix"), F.max(F.when(by_stem, number)).alias("prefix_no"),
        F.count_if(by_norm).alias("n_norm"), F.max(F.when(by_norm, number)).alias("norm_no"),
    )


def entity_answers(files: DataFrame, lengths: list[int]) -> DataFrame:
    """Per key and entity: how many files start with the key and list the entity, and the file if it is one."""
    listed = F.filter(F.transform(F.split("gl_entityids", "[;,]"), strip), lambda e: e != "")
    with_entity = files.select("stem", "file_no", F.explode(F.array_distinct(listed)).alias("entityid"))
    return with_entity.select(
        F.explode(_prefixes(F.col("stem"), lengths)).alias("key"), "entityid", "file_no"
    ).groupBy("key", "entityid").agg(F.count(F.lit(1)).alias("n_entity"), F.max("file_no").alias("entity_no"))


def resolve_keys(wanted: DataFrame, files: DataFrame, lookup: DataFrame) -> DataFrame:
    """Distinct (key, entityid) of `wanted` with `status`, `stem` and the page hint.

    Exact stem, else stems starting with the key, else the normalised stem. Several prefix hits are settled by the
    entity when exactly one candidate lists it. An ambiguous key is reported, never guessed.
    """
    pairs = materialize(
        wanted.select("key", F.coalesce(strip(F.col("entityid")), F.lit("")).alias("entityid")).distinct(), "invoice-keys"
    )
    known, lengths = numbered_files(files, lookup), key_lengths(pairs)
    pairs = lookup_join(pairs, file_answers(known, lengths), ["key"], "entityid", salts=0)
    pairs = lookup_join(pairs, entity_answers(known, lengths), ["key", "entityid"], "entityid", salts=0)
    hit = (
        F.when(F.col("exact_no").isNotNull(), F.col("exact_no"))
        .when(F.col("n_prefix") == 1, F.col("prefix_no"))
        .when((F.col("n_prefix") > 1) & (F.col("n_entity") == 1), F.col("entity_no"))
        .when((F.col("n_prefix") == 0) & (F.col("n_norm") == 1), F.col("norm_no"))
    )
    several = (F.col("n_prefix") > 1) | (F.col("n_norm") > 1)
    status = F.when(hit.isNotNull(), "resolved").when(several, "ambiguous").otherwise("no_match")
    found = pairs.select("key", "entityid", status.alias("status"), hit.alias("file_no"))
    named = known.select("file_no", "stem", F.col("pages").alias("hint"))
    return lookup_join(found, named, ["file_no"], "key").select("key", "entityid", "status", "stem", "hint")


def resolve_rows(rows: DataFrame, files: DataFrame, lookup: DataFrame) -> DataFrame:
    """`rows` with `status`, `stem`, `hint`; a row without a key has status no_match."""
    keyed = rows.where("key is not null")
    answers = resolve_keys(keyed, files, lookup).withColumnRenamed("entityid", "_entity")
    joined = lookup_join(
        rows.withColumn("_entity", F.coalesce(strip(F.col("entityid")), F.lit(""))), answers, ["key", "_entity"], "row_idx"
    )
    return joined.drop("_entity").withColumn("status", F.coalesce("status", F.lit("no_match")))
