"""Registry of checked queries: a name, the Spark plan, and (where SQL can say it) the same result as SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..session import materialize
from ..sources import fixtures

Plan = Callable[["Context"], DataFrame]


@dataclass
class Context:
    """Hands a query its input tables and views."""

    spark: SparkSession
    sf_dir: str
    _views: dict[str, DataFrame] = field(default_factory=dict)

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            self._views[name] = fixtures.read_view(self.spark, self.sf_dir, name)
        return self._views[name]


    def shared(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table several queries of one session start from, written on first use."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in SHARED:
            SHARED[key] = materialize(build(), name)
        return SHARED[key]


SHARED: dict[tuple[str, str, str], DataFrame] = {}
QUERIES: dict[str, Plan] = {}
CHECKS: dict[str, str] = {}
# Shared parts of checking SQL: name -> (needed parts or views, text).
PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, needs: tuple[str, ...], text: str) -> None:
    PARTS[name] = (needs, text.strip())


def derive(prefix: str, names: tuple[str, ...], given: tuple[str, ...], swaps: dict[str, str] | None = None) -> None:
    """Copies of the parts `names` under `prefix`, reading each other and the prefixed `given` instead.

    `swaps` replaces other text in them.
    """
    moved = (*names, *given)
    pattern = re.compile(rf"\b(from|join) ({'|'.join(moved)})\b")
    for name in names:
        needs, text = PARTS[name]
        for old, new in (swaps or {}).items():
            text = text.replace(old, new)
        part(prefix + name, tuple(prefix + n if n in moved else n for n in needs), pattern.sub(rf"\1 {prefix}\2", text))


def _needs(name: str) -> tuple[str, ...]:
    if name in PARTS:
        return PARTS[name][0]
    return fixtures.VIEWS[name][0] if name in fixtures.VIEWS else ()


def check_sql(select: str, needs: tuple[str, ...]) -> str:
    """`select` preceded by every part it needs, each once, in order of need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered or (name not in PARTS and name not in fixtures.VIEWS):
            return
        for need in _needs(name):
            visit(need)
        ordered.append(name)

    for need in needs:
        visit(need)
    if not ordered:
        return select.strip()
    texts = [
        f"{name} as materialized (\n{PARTS[name][1] if name in PARTS else fixtures.view_sql(name, fixtures.CHECK)}\n)"
        for name in ordered
    ]
    return "with recursive " + ",\n".join(texts) + "\n" + select.strip()


def query(name: str, *needs: str, check: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; `check` is its SQL over the parts in `needs`."""

    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = plan
        if check is not None:
            CHECKS[name] = check_sql(check, needs)
        return plan

    return register
