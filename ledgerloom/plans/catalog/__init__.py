"""Checked queries, one module per topic. `load()` imports them all and so fills the registry."""

from __future__ import annotations

import importlib

TOPICS = (
    "scalars", "scope", "triage", "invoices", "resolution", "batching", "reconcile", "scorecard", "review", "deals",
    "rules", "cells", "outputs", "log", "streams", "jobs",
)


def load() -> None:
    for topic in TOPICS:
        importlib.import_module(f"{__name__}.{topic}")
