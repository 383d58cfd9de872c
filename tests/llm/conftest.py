"""Small tables with the awkward cases every operator must take."""

from __future__ import annotations

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi"


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang): nulls, blanks, ties, copies, near copies, repeats, a long text, odd characters."""
    w = WORDS.split()
    base = " ".join(w * 2)
    near = base.replace("omicron", "OTHER", 1)
    lines = "\n".join(" ".join(w[k : k + 8]) for k in range(8))
    return [
        (1, base, "en"), (2, base, "en"), (3, near, "en"), (4, base.upper(), "en"), (5, None, "en"), (6, "", None),
        (7, " \t\n ", "en"), (8, "one two", "en"), (9, "one two", "en"), (10, lines, "en"), (11, lines + "\nmore of it", "en"),
        (12, "x " * 3000, "en"), (13, " ".join(f"w{k}" for k in range(20_000)), "en"), (14, "é漢🙂 \x1c\x85  <|endoftext|> a\x00b", None),
        (15, "same line of exactly seven words here\n" * 3, "en"), (16, " ".join(w[5:20]) + " tail that differs", "en"),
        (17, " ".join(w[:10]) + " and then " + " ".join(w[10:]), "en"), (17, " ".join(w[:10]), "en"), (18, None, None),
    ]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows twice over columns that clash with those the operators add, in several partitions."""
    table = [(i, t, lang, "src0", k, "kept", 1.5) for k, (i, t, lang) in enumerate([*rows, rows[0]])]
    return spark.createDataFrame(
        table, "doc_id long, text string, lang string, source string, n_words int, component_id string, score double"
    ).repartition(3)


@pytest.fixture(scope="session")
def all_rows(rows):
    return [*rows, rows[0]]
