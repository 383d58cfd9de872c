"""Ledger rows for tests: a plain rent row with some values changed."""

from __future__ import annotations

LEDGER_SCHEMA = (
    "row_idx long, period string, acctnum string, ref string, entityid string, department string, category string, "
    "amount double, amount_was_blank boolean, currency string, descrptn string, adddesc string, source string, "
    "entrdate string, userid string, invoice_url string"
)


def ledger_row(row_idx: int, **values):
    row = {
        "row_idx": row_idx, "period": "202601", "acctnum": "MR70000001", "ref": str(row_idx), "entityid": "7",
        "department": None, "category": "Rent", "amount": 1500.0, "amount_was_blank": False, "currency": "USD",
        "descrptn": "Monthly rent", "adddesc": None, "source": "AP", "entrdate": "2026-01-15", "userid": "jdoe",
        "invoice_url": None,
    }
    row.update(values)
    return tuple(row.values())
