"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledger_rows import LEDGER_SCHEMA, ledger_row  # noqa: E402

from ledgerloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_ledger(spark):
    return lambda rows: spark.createDataFrame([ledger_row(i, **v) for i, v in enumerate(rows, start=2)], LEDGER_SCHEMA)
