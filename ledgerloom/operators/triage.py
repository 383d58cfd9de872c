"""Rule triage: rows settled by rules alone, and rows left for the scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.cleaning import strip
from ..functions.mining import mine_invoice_key


def is_reclass(descrptn: Column, adddesc: Column) -> Column:
    word = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(vocab.RECLASS_WORD)
    return word(descrptn) | word(adddesc)


def close_guard_trips(category: Column, descrptn: Column) -> Column:
    """A system close entry that reads like a deal must not be cleared by rule."""
    reads = lambda c: F.coalesce(c.rlike(vocab.CLOSE_GUARD_PATTERN), F.lit(False))
    return reads(category) | reads(descrptn)


def has_invoice_reference(invoice_url: Column, key: Column) -> Column:
    return (F.coalesce(invoice_url, F.lit("")) != "") | key.isNotNull()


def with_mined_key(rows: DataFrame) -> DataFrame:
    """Adds `key` and `truncated`. Unreferenced, the column is pruned and nothing is mined."""
    mined = mine_invoice_key(F.col("descrptn"), F.col("adddesc"))
    return rows.withColumn("_mined", mined).withColumns(
        {"key": F.col("_mined.key"), "truncated": F.col("_mined.truncated")}
    ).drop("_mined")


def _quoted(c: Column) -> Column:
    """Text in quotes, or None."""
    return F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))


def triage(rows: DataFrame) -> DataFrame:
    """Adds `rule` and, for settled rows, the decision: reclass, then close entries, then negatives, else `scorer`.

    Expects `key` from `with_mined_key`. One projection, so scope filters above it still reach the scan.
    """
    closing = F.coalesce(F.upper(strip(F.col("userid"))) == vocab.CLOSE_USER, F.lit(False))
    guarded = close_guard_trips(F.col("category"), F.col("descrptn"))
    rule = (
        F.when(is_reclass(F.col("descrptn"), F.col("adddesc")), "reclass")
        .when(closing & guarded, "close_guard")
        .when(closing, "close")
        .when(F.col("amount") < 0, "negative")
        .otherwise("scorer")
    )
    referenced = has_invoice_reference(F.col("invoice_url"), F.col("key"))
    flag = lambda name, test: F.when(test, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    is_rule = lambda *names: F.col("rule").isin(*names)
    flags = F.concat(
        flag("amount_blank", F.col("amount_was_blank")),
        flag("reclass_rule", is_rule("reclass")),
        flag("had_invoice", ~is_rule("scorer") & referenced),
        flag("closegl_user", is_rule("close", "close_guard")),
        flag("skipped_negative", is_rule("negative")),
    )

    def per_rule(reclass, guard, close, negative) -> Column:
        pick = lambda v: v if isinstance(v, Column) else F.lit(v)
        return (
            F.when(is_rule("reclass"), pick(reclass)).when(is_rule("close_guard"), pick(guard))
            .when(is_rule("close"), pick(close)).when(is_rule("negative"), pick(negative))
        )

    reclass_evidence = F.concat(
        F.lit("[row] descrptn="), _quoted(F.col("descrptn")), F.lit(" adddesc="), _quoted(F.col("adddesc"))
    )
    guard_evidence = F.concat(
        F.lit("[row] category="), _quoted(F.col("category")), F.lit(" descrptn="), _quoted(F.col("descrptn"))
    )
    return rows.withColumn("rule", rule).withColumns({
        "classification": per_rule("reclass", "human_review", "recurring", "skipped_negative"),
        "basis": per_rule("reclass_rule", "none", "closegl_rule", "none"),
        "reasoning": per_rule(vocab.RECLASS_TEXT, vocab.GUARD_TEXT, vocab.CLOSE_TEXT, vocab.NEGATIVE_TEXT),
        "evidence": per_rule(reclass_evidence, guard_evidence, vocab.CLOSE_EVIDENCE, "none"),
        "missing_info": F.when(is_rule("close_guard"), vocab.GUARD_MISSING_TEXT),
        "had_invoice": F.when(~is_rule("scorer"), F.when(referenced, "yes").otherwise("no")),
        "flags": flags,
    })


def flaw(amount: Column) -> Column:
    """Why a row cannot be prepared, else null: its fingerprint and estimate need an amount of at most 32 digits."""
    return F.when(amount.isNull(), "amount is missing").when(
        amount.try_cast("decimal(38,6)").isNull(), F.concat(F.lit("amount is no sum of money: "), amount.cast("string"))
    )


def sound(rows: DataFrame) -> DataFrame:
    """Rows that can be prepared."""
    return rows.where(flaw(F.col("amount")).isNull())


def flawed(rows: DataFrame) -> DataFrame:
    """The other rows, with `error`."""
    return rows.withColumn("error", flaw(F.col("amount"))).where("error is not null")


def prepared(ledger: DataFrame) -> DataFrame:
    return triage(with_mined_key(ledger))


def settled(triaged: DataFrame) -> DataFrame:
    return triaged.where(F.col("rule") != "scorer")


def scorer_bound(triaged: DataFrame) -> DataFrame:
    """Rows without a verdict yet, with the decision columns dropped."""
    return triaged.where(F.col("rule") == "scorer").drop(
        "classification", "basis", "reasoning", "evidence", "missing_info", "had_invoice"
    )
