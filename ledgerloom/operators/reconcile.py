"""Checking what the external scorer returned, and turning it into decision records.

A decision record is one flat row per ledger row; `nest_records` gives the stored shape.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.cleaning import strip
from ..functions.documents import INVOICE_TYPE, invoice_summary, is_readable
from ..functions.pages import has_gap
from ..session import materialize

LEDGER_FIELDS = (
    "row_idx", "period", "acctnum", "ref", "entityid", "department", "category", "amount", "amount_was_blank",
    "currency", "descrptn", "adddesc", "source", "entrdate", "userid", "invoice_url",
)
_LEDGER_TYPES = {"row_idx": "bigint", "amount": "double", "amount_was_blank": "boolean"}
HIDDEN_FROM_SCORER = ("amount_was_blank", "userid")
ANSWER_FIELDS = (
    "classification", "basis", "recognized_deal", "invoice_read", "invoice_date", "reasoning", "evidence", "missing_info",
)
SUMMARY_TYPE = INVOICE_TYPE.replace("text:string,", "").replace("text_tokens:bigint,", "").replace("est_input_tokens:bigint,", "")
# Decision columns beside the ledger fields, with their types.
RECORD_FIELDS = {
    "phase": "string", "model_version": "string", "error": "string", "had_invoice": "string",
    "invoice_accessed": "string", "invoice": SUMMARY_TYPE, "classification": "string", "basis": "string",
    "recognized_deal": "string", "invoice_read": "string", "invoice_date": "string", "reasoning": "string",
    "evidence": "string", "missing_info": "string", "override": "struct<from:string,reason:string>",
    "flags": "array<string>", "row_hash": "string", "input_tokens": "bigint", "output_tokens": "bigint",
}
_DEFAULTS = {"recognized_deal": "none", "invoice_read": "none_attached", "input_tokens": 0, "output_tokens": 0}
CONFLATED = "row_idx set mismatch (anti-conflation)"


def scorer_view(rows: DataFrame) -> DataFrame:
    """`row_idx` and the row as JSON with sorted keys, without the columns kept for auditors."""
    shown = sorted(c for c in LEDGER_FIELDS if c not in HIDDEN_FROM_SCORER)
    return rows.select("row_idx", F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("row_json"))


def score_batches(
    rows: DataFrame, score: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Call `score` once per batch; it gets the rows of one batch and returns its answers.

    The token target bounds a batch, so a group is a few dozen rows.
    """
    return rows.groupBy("batch_id").applyInPandas(score, schema)


def collapse_answers(answers: DataFrame) -> DataFrame:
    """One row per batch and row id with the number of times it was returned."""
    fields = F.struct(*ANSWER_FIELDS).alias("answer")
    return answers.groupBy("batch_id", "row_idx").agg(F.count(F.lit(1)).alias("returned"), F.any_value(fields).alias("answer"))


def match_answers(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Every expected and every returned row of each batch: full outer join on batch and row."""
    return _match(items, collapse_answers(answers))


def _match(items: DataFrame, collapsed: DataFrame) -> DataFrame:
    expected = items.select("batch_id", "row_idx", F.lit(True).alias("expected"))
    return expected.join(collapsed, ["batch_id", "row_idx"], "full_outer")


def batch_verdicts(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Missing, extra and repeated ids per batch; a batch is usable only when all three are zero."""
    return _verdicts(items, collapse_answers(answers))


def _verdicts(items: DataFrame, collapsed: DataFrame) -> DataFrame:
    returned = F.coalesce("returned", F.lit(0))
    expected = F.coalesce("expected", F.lit(False))
    counted = _match(items, collapsed).groupBy("batch_id").agg(
        F.count_if(expected & (returned == 0)).alias("missing"),
        F.count_if(~expected & (returned > 0)).alias("extra"),
        F.count_if(returned > 1).alias("repeated"),
    )
    return counted.withColumn("ok", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("repeated") == 0))


def as_records(rows: DataFrame) -> DataFrame:
    """Ledger fields plus every decision column, missing ones at their defaults."""
    def column(name: str, kind: str) -> Column:
        value = F.col(name) if name in rows.columns else F.lit(_DEFAULTS.get(name))
        return value.cast(kind).alias(name)

    return rows.select(*LEDGER_FIELDS, *[column(n, t) for n, t in RECORD_FIELDS.items()])


def settled_records(settled: DataFrame) -> DataFrame:
    """Records of the rows that rules settled; no document is ever read for them."""
    from ..functions.reporting import row_fingerprint

    return as_records(settled.withColumns({
        "phase": F.lit("phase0"), "invoice_accessed": F.lit("no"),
        "row_hash": row_fingerprint(F.lit(None).cast("string")),
    }))


def error_records(flawed: DataFrame) -> DataFrame:
    """Records of rows that could not be prepared (`error` says why): they go to a human, none is dropped.

    Their fingerprint is that of the row without its amount.
    """
    from ..functions.reporting import HASHED_FIELDS, row_fingerprint

    fields = {name: F.col(name) for name in HASHED_FIELDS} | {"amount": F.lit(None).cast("double")}
    text = F.concat(F.lit("phase0_resolution_error: "), F.col("error"))
    return as_records(flawed.withColumns({
        "row_hash": row_fingerprint(F.lit(None).cast("string"), fields), "error": text, "missing_info": text,
        "phase": F.lit("phase0"), "classification": F.lit("human_review"), "basis": F.lit("none"),
        "reasoning": F.lit(vocab.ERROR_TEXT), "evidence": F.lit("none"), "had_invoice": F.lit("no"),
        "invoice_accessed": F.lit("no"), "flags": F.array().cast("array<string>"),
    }))


def _add_flag(flags: Column, name: str, test: Column) -> Column:
    return F.when(test, F.array_union(flags, F.array(F.lit(name)))).otherwise(flags)


def reconcile(items: DataFrame, answers: DataFrame, default_model: str = vocab.FLOOR_MODEL) -> DataFrame:
    """Decision records of classified items.

    Items of a batch whose ids do not match, and items whose label is not allowed, become error records that go to a
    human; no row is dropped. `items` carries `batch_id`, and `model` if batches ran on different models. Answers are
    written once, folded by row, so that who gives them is asked once.
    """
    collapsed = materialize(collapse_answers(answers), "answers")
    verdicts = _verdicts(items, collapsed).select("batch_id", "ok")
    model = F.col("model") if "model" in items.columns else F.lit(default_model)
    rows = (
        items.join(collapsed.drop("returned"), ["batch_id", "row_idx"], "left")
        .join(verdicts, "batch_id", "left").withColumn("_model", model)
    )
    said = F.col("answer.classification")
    valid = F.coalesce(said.isin(*vocab.SCORER_CLASSIFICATIONS), F.lit(False))
    quoted = F.coalesce(F.concat(F.lit("'"), said, F.lit("'")), F.lit("None"))
    error = F.when(~F.coalesce("ok", F.lit(False)), CONFLATED).when(
        ~valid, F.concat(F.lit("model returned invalid/missing classification: "), quoted)
    )
    deal = F.when(F.coalesce(strip(F.col("answer.recognized_deal")), F.lit("")) != "", F.col("answer.recognized_deal")).otherwise("none")
    basis = F.when(F.col("answer.basis").isin(*vocab.SCORER_BASES), F.col("answer.basis")).otherwise("none")
    sent = is_readable(F.col("invoice"))
    rows = rows.withColumns({"_error": error, "_deal": deal, "_basis": basis, "_sent": sent})
    claimed = F.col("answer.invoice_read")
    known = F.coalesce(claimed.isin(*vocab.SCORER_INVOICE_READ), F.lit(False))
    mismatch = known & F.when(F.col("_sent"), claimed != "read").otherwise(claimed == "read")
    named = F.col("_deal") != "none"
    groundless = (F.col("_basis") == "deal_profile") & ~named
    unverified = F.array_contains("flags", "invoice_unavailable") & named & (said != "human_review")
    label = F.when(unverified, "human_review").otherwise(said)
    flags = F.col("flags")
    for name, test in (
        ("invoice_read_mismatch", mismatch), ("invoice_truncated", F.col("_sent") & has_gap(F.col("invoice.pages_read"))),
        ("deal_profile_match", named), ("basis_mismatch", groundless),
    ):
        flags = _add_flag(flags, name, test)
    missing = F.col("answer.missing_info")
    missing = F.when((label == "human_review") & (F.coalesce(missing, F.lit("")) == ""), vocab.MISSING_INFO_TEXT).otherwise(missing)
    override = F.when(unverified, F.struct(said.alias("from"), F.lit(vocab.OVERRIDE_TEXT).alias("reason")))
    usable = F.col("_error").isNull()
    either = lambda good, bad: F.when(usable, good).otherwise(bad)
    none = F.lit(None)
    date = F.col("answer.invoice_date")
    done = rows.withColumns({
        "phase": F.lit("classify"), "error": F.col("_error"), "model_version": either(F.col("_model"), none),
        "classification": either(label, "human_review"),
        "basis": either(F.when(groundless, "none").otherwise(F.col("_basis")), "none"),
        "recognized_deal": either(F.col("_deal"), "none"),
        "invoice_read": either(
            F.when(known, claimed).otherwise(F.when(F.col("_sent"), "read").otherwise("none_attached")), "none_attached"
        ),
        "invoice_date": either(F.when(F.coalesce(strip(date), F.lit("")) != "", date), none),
        "reasoning": either(F.coalesce("answer.reasoning", F.lit("")), vocab.ERROR_TEXT),
        "evidence": either(F.coalesce("answer.evidence", F.lit("")), "none"),
        "missing_info": either(missing, F.col("_error")),
        "override": either(override, none),
        "flags": either(flags, F.col("flags")),
        "invoice": invoice_summary(F.col("invoice")),
    })
    return as_records(done)


def sweep_records(items: DataFrame, quarters: list[str], failures: DataFrame, model: str = vocab.FLOOR_MODEL) -> DataFrame:
    """Records of the M&A account: always non_recurring by rule, swept, failed (with reason) or left out.

    `items` carries `selected`; `failures` holds row_idx and reason.
    """
    rows = items.join(failures.select("row_idx", "reason"), "row_idx", "left").withColumn(
        "_state",
        F.when(~F.col("selected"), "skipped").when(F.col("reason").isNotNull(), "failed").otherwise("ok"),
    )
    state = F.col("_state")
    flags = _add_flag(_add_flag(F.col("flags"), "deal_sweep_failed", state == "failed"), "deal_sweep_skipped", state == "skipped")
    failed_text = F.concat(F.lit(vocab.SWEEP_FAILED_TEXT + " reason: "), F.col("reason"))
    return as_records(rows.withColumns({
        "phase": F.lit("deal_profile"), "classification": F.lit("non_recurring"), "basis": F.lit("ma_account_rule"),
        "reasoning": F.when(state == "skipped", vocab.SWEEP_SKIPPED_TEXT.format(", ".join(quarters)))
        .when(state == "failed", failed_text).otherwise(vocab.SWEEP_TEXT),
        "evidence": F.lit(vocab.SWEEP_EVIDENCE), "flags": flags,
        "model_version": F.when(state == "ok", model), "invoice": invoice_summary(F.col("invoice")),
    }))


_DECISION = (
    "classification", "basis", "recognized_deal", "invoice_read", "invoice_date", "reasoning", "evidence",
    "missing_info", "override",
)
_USAGE = ("input_tokens", "output_tokens")


def log_schema() -> str:
    """The stored shape as a schema, for readers."""
    packet = ",".join(f"{name}:{_LEDGER_TYPES.get(name, 'string')}" for name in LEDGER_FIELDS)
    struct = lambda names: f"struct<{','.join(f'{n}:{RECORD_FIELDS[n]}' for n in names)}>"
    plain = {n: t for n, t in RECORD_FIELDS.items() if n not in _DECISION + _USAGE}
    columns = {"row_idx": "bigint", "packet": f"struct<{packet}>", **plain, "decision": struct(_DECISION), "usage": struct(_USAGE)}
    return ", ".join(f"`{n}` {t}" for n, t in columns.items())


def nest_records(records: DataFrame) -> DataFrame:
    """The stored shape: packet, decision and usage as structs."""
    return records.select(
        "row_idx", F.struct(*LEDGER_FIELDS).alias("packet"), "phase", "model_version", "error", "had_invoice",
        "invoice_accessed", "invoice", F.struct(*_DECISION).alias("decision"), "flags", "row_hash",
        F.struct(*_USAGE).alias("usage"),
    )


def flatten_records(nested: DataFrame) -> DataFrame:
    """Inverse of `nest_records`."""
    return nested.select(
        "packet.*", "phase", "model_version", "error", "had_invoice", "invoice_accessed", "invoice", "decision.*",
        "flags", "row_hash", "usage.*",
    ).select(*LEDGER_FIELDS, *RECORD_FIELDS)
