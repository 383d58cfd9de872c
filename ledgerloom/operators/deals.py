"""The deal vocabulary: names and identifiers heard in the M&A account, merged, listed, and found again in row text.

The merged vocabulary is kept long: one row per deal, field and value. Lists are only nested for the export tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.cleaning import strip
from ..functions.periods import quarter_of
from .joins import beside, lookup_join
from .ordering import global_positions

LIST_FIELDS = ("aliases", "matter_numbers", "invoice_numbers", "properties", "entityids", "advisors_seen")
INDEX_FIELDS = (("aliases", "aliases"), ("matter#", "matter_numbers"), ("inv#", "invoice_numbers"), ("props", "properties"))
# Fixed value: first line of the index text.
INDEX_HEADER = "KNOWN DEALS — identifiers to recognize in a row's own text or invoice:"
_BUCKET = 1 << 14


def clean_list(values: Column) -> Column:
    """Trimmed, non-empty strings; a missing list is empty."""
    trimmed = F.filter(F.transform(values, lambda v: strip(v.cast("string"))), lambda v: v != "")
    return F.coalesce(trimmed, F.array().cast("array<string>"))


def valid_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions with evidence and a name; `deal_key` is the lower-cased name.

    Expects ord, batch_id, name, the list fields, evidence (array of ref and quote) and supporting_row_idxs.
    """
    name = strip(F.col("name"))
    kept = mentions.where((F.size(F.coalesce("evidence", F.array())) > 0) & (F.coalesce(name, F.lit("")) != ""))
    return kept.withColumns({"name": name, "deal_key": F.lower(name), **{f: clean_list(F.col(f)) for f in LIST_FIELDS}})


def deal_names(mentions: DataFrame) -> DataFrame:
    """The name as first heard."""
    return mentions.groupBy("deal_key").agg(F.min_by("name", "ord").alias("name"))


def deal_terms(mentions: DataFrame) -> DataFrame:
    """Distinct values per deal and field with the place of their first appearance (`ord`, `at`)."""

    def placed(field: str) -> Column:
        entry = lambda v, i: F.struct(F.lit(field).alias("field"), v.alias("value"), i.alias("at"))
        return F.transform(F.col(field), entry)

    values = mentions.select("deal_key", "ord", F.explode(F.flatten(F.array(*map(placed, LIST_FIELDS)))).alias("t"))
    first = F.min(F.struct("ord", "t.at"))
    return values.groupBy("deal_key", "t.field", "t.value").agg(first.alias("first")).select(
        "deal_key", "field", "value", "first.ord", "first.at"
    )


def deal_evidence(mentions: DataFrame) -> DataFrame:
    """Distinct evidence per deal with the place of its first appearance."""
    quotes = mentions.select("deal_key", "ord", F.posexplode("evidence").alias("at", "e"))
    first = F.min(F.struct("ord", "at"))
    return quotes.groupBy("deal_key", "e.ref", "e.quote").agg(first.alias("first")).select(
        "deal_key", "ref", "quote", "first.ord", "first.at"
    )


def deal_support(mentions: DataFrame, batch_rows: DataFrame) -> DataFrame:
    """Distinct supporting rows per deal; an id counts only if it was in the batch that named it."""
    claimed = mentions.select("deal_key", "batch_id", F.explode("supporting_row_idxs").alias("claim")).select(
        "deal_key", "batch_id", F.col("claim").cast("string").try_cast("bigint").alias("row_idx")
    ).where("row_idx is not null").distinct()
    allowed = batch_rows.select("batch_id", "row_idx")
    return claimed.join(allowed, ["batch_id", "row_idx"], "left_semi").select("deal_key", "row_idx").distinct()


def deal_quarters(support: DataFrame, ledger: DataFrame) -> DataFrame:
    """Supporting rows per deal and quarter (null where the period gives none)."""
    periods = ledger.select("row_idx", quarter_of(F.col("period")).alias("quarter"))
    return support.join(periods, "row_idx", "left").groupBy("deal_key", "quarter").agg(F.count(F.lit(1)).alias("n"))


def deal_entries(mentions: DataFrame, batch_rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row per deal: name, its value lists in order of appearance, supporting rows, sorted quarters.

    Values are distinct before they are listed; supporting rows are only counted.
    """
    valid = valid_mentions(mentions)
    place = F.struct("ord", "at", "value")
    lists = deal_terms(valid).groupBy("deal_key").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, place))), lambda p: p["value"]).alias(f)
        for f in LIST_FIELDS
    ])
    counted = deal_quarters(deal_support(valid, batch_rows), ledger).groupBy("deal_key").agg(
        F.sum("n").alias("supporting_rows"), F.array_sort(F.collect_set("quarter")).alias("quarters")
    )
    joined = deal_names(valid).join(lists, "deal_key", "left").join(counted, "deal_key", "left")
    empty = F.array().cast("array<string>")
    return joined.select(
        "deal_key", "name", *[F.coalesce(f, empty).alias(f) for f in LIST_FIELDS],
        F.coalesce("supporting_rows", F.lit(0)).alias("supporting_rows"), F.coalesce("quarters", empty).alias("quarters"),
    )


def period_range(rows: DataFrame, earlier: str = "") -> DataFrame:
    """`min-max` of the periods, widened by an earlier range; the earlier one when there is no period."""
    named = F.when(F.col("period") != "", F.col("period"))
    parts = [F.lit(p) for p in earlier.split("-")] if earlier else []
    low = F.least(F.col("low"), *parts) if parts else F.col("low")
    high = F.greatest(F.col("high"), *parts) if parts else F.col("high")
    return rows.agg(F.min(named).alias("low"), F.max(named).alias("high")).select(
        F.coalesce(F.concat(low, F.lit("-"), high), F.lit(earlier)).alias("period_range")
    )


def sweep_stats(items: DataFrame, failures: DataFrame, mentions: DataFrame) -> DataFrame:
    """Rows selected, ok, failed, documents read, batches (also fully failed ones), entries. `items` has batch_id."""
    rows = items.join(failures.select("row_idx", F.lit(True).alias("failed")), "row_idx", "left")
    failed = F.coalesce("failed", F.lit(False))
    per_batch = rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("bad"),
        F.count_if(F.col("invoice_accessed") == "yes").alias("read"),
    )
    sums = per_batch.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_selected"), F.coalesce(F.sum(F.col("n") - F.col("bad")), F.lit(0)).alias("rows_ok"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("rows_failed"), F.coalesce(F.sum("read"), F.lit(0)).alias("invoices_read"),
        F.count(F.lit(1)).alias("batches_total"), F.count_if(F.col("n") == F.col("bad")).alias("batches_failed"),
    )
    entries = deal_names(valid_mentions(mentions)).agg(F.count(F.lit(1)).alias("entries"))
    return beside(sums, entries)


def evidence_text(evidence: DataFrame, limit: int | None = None) -> DataFrame:
    """All evidence of a deal as lines `ref: quote`, one text per deal; `deal_evidence` has one row per line.

    A spreadsheet's cell takes `limit` characters (`vocab.CELL_MAX_CHARS`); a longer text is then cut and ends in `...`.
    Only the lines that can reach into the cell are brought together in that case: line lengths are added up per range of
    `ord`, ranges that begin beyond the limit are dropped, and what is left fits one cell and one range.
    """
    line = F.concat(F.coalesce("ref", F.lit("?")), F.lit(": "), F.coalesce("quote", F.lit("")))
    lines = evidence.select(
        "deal_key", "ord", "at", line.alias("line"), F.floor(F.col("ord") / _BUCKET).alias("low"),
        F.floor(F.col("ord") / (_BUCKET * _BUCKET)).alias("high"),
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "at", "line"))), lambda s: s["line"]), "\n")
    if limit is None:
        return lines.groupBy("deal_key").agg(text.alias("evidence"))
    lows = lines.groupBy("deal_key", "high", "low").agg(F.sum(F.length("line") + 1).alias("chars"))
    highs = lows.groupBy("deal_key", "high").agg(F.sum("chars").alias("chars"))
    earlier = lambda by, order: F.coalesce(F.sum("chars").over(
        Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = highs.withColumn("before", earlier(["deal_key"], "high")).where(F.col("before") <= limit)
    kept = lows.join(near.select("deal_key", "high", "before"), ["deal_key", "high"]).withColumn(
        "start", F.col("before") + earlier(["deal_key", "high"], "low")
    ).where(F.col("start") <= limit).select("deal_key", "low")
    whole = lines.join(kept, ["deal_key", "low"]).groupBy("deal_key").agg(text.alias("text"))
    cut = F.concat(F.substring("text", 1, limit - 3), F.lit("..."))
    return whole.select("deal_key", F.when(F.length("text") > limit, cut).otherwise(F.col("text")).alias("evidence"))


def profile_table(entries: DataFrame, evidence: DataFrame, cell_limit: int | None = None) -> DataFrame:
    """The exported table: lists joined by `; `, evidence as text, which a spreadsheet export cuts at `cell_limit`."""
    joined = lambda c: F.array_join(c, "; ").alias(c)
    return entries.join(evidence_text(evidence, cell_limit), "deal_key", "left").select(
        "name", "supporting_rows", joined("matter_numbers"), joined("invoice_numbers"), joined("quarters"),
        joined("aliases"), joined("properties"), joined("entityids"), joined("advisors_seen"),
        F.coalesce("evidence", F.lit("")).alias("evidence"),
    )


def index_line() -> Column:
    """`- name | aliases: … | matter#: …`; empty parts are left out."""
    parts = [
        F.when(F.size(f) > 0, F.concat(F.lit(f"{label}: "), F.array_join(f, ", "))) for label, f in INDEX_FIELDS
    ]
    return F.concat_ws(" | ", F.concat(F.lit("- "), F.col("name")), *parts)


def deal_order() -> list[Column]:
    """Latest quarter first, then more support, then name."""
    latest = F.coalesce(F.array_max("quarters"), F.lit(""))
    return [latest.desc(), F.desc("supporting_rows"), F.asc("name"), F.asc("deal_key")]


def ordered_deals(entries: DataFrame) -> DataFrame:
    return global_positions(entries, deal_order(), "line_no")


def index_lines(entries: DataFrame) -> DataFrame:
    """`line_no` and text of the known-deal index, header first. Written out by `write_index`."""
    lines = ordered_deals(entries).select((F.col("line_no") + 1).alias("line_no"), index_line().alias("line"))
    header = entries.sparkSession.createDataFrame([(0, INDEX_HEADER)], "line_no long, line string")
    return header.unionByName(lines)


def write_index(lines: DataFrame, path: str) -> None:
    """Text files whose names sort in line order."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(parts, "line_no").sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)


def index_report(entries: DataFrame) -> DataFrame:
    """Entries and estimated tokens of the index text; nothing is listed when there is no entry."""
    chars = F.coalesce(F.sum(F.length(index_line()) + 1), F.lit(0)) + len(INDEX_HEADER)
    counted = F.count(F.lit(1))
    return entries.agg(
        counted.alias("entries_total"), counted.alias("entries_full"),
        F.when(counted > 0, F.floor(chars / vocab.CHARS_PER_TOKEN)).otherwise(0).alias("est_tokens"),
    )


# -- finding known deals in row text -----------------------------------------------------------------------------


def words(c: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def deal_dictionary(names: DataFrame, terms: DataFrame) -> DataFrame:
    """Phrases that stand for a deal: its name, aliases, matter and invoice numbers, properties.

    A phrase shared by deals belongs to the least deal key, so a phrase is unique.
    """
    fields = [f for _, f in INDEX_FIELDS]
    said = names.select("deal_key", F.col("name").alias("value")).unionByName(
        terms.where(F.col("field").isin(fields)).select("deal_key", "value")
    )
    phrased = said.select("deal_key", words(F.col("value")).alias("w")).where(F.size("w") > 0)
    return phrased.groupBy(F.array_join("w", " ").alias("phrase"), F.size("w").alias("n_words")).agg(
        F.min("deal_key").alias("deal_key")
    )


def match_deals(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows whose text holds a known phrase, on word borders: the deal of the longest phrase, and how many matched.

    Rows are cut into phrases of the lengths the dictionary uses and joined by equality. The lengths are read first: one
    small integer per phrase length.
    """
    lengths = sorted(r.n_words for r in dictionary.select("n_words").distinct().collect())
    if not lengths:
        return rows.select("row_idx", F.lit(None).cast("string").alias("deal_key"), F.lit(0).cast("bigint").alias("n_phrases")).where("false")
    text = F.concat_ws(" ", "descrptn", "adddesc")

    def grams(w: Column) -> Column:
        def of_length(n: int) -> Column:
            starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

        return F.array_distinct(F.flatten(F.array(*[of_length(n) for n in lengths])))

    spoken = rows.select("row_idx", words(text).alias("w")).select("row_idx", F.explode(grams(F.col("w"))).alias("phrase"))
    hits = lookup_join(spoken, dictionary, ["phrase"], "row_idx", how="inner")
    best = F.min(F.struct((-F.length("phrase")).alias("rank"), F.col("deal_key")))
    return hits.groupBy("row_idx").agg(best.alias("best"), F.count(F.lit(1)).alias("n_phrases")).select(
        "row_idx", "best.deal_key", "n_phrases"
    )
