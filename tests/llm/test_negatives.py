"""Hard negatives against all pairs, the curve against its definition, and zone maps against scores."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, scale=256, positives=5, count=3, low=50, high=95, anchor=lambda i: i % 50 == 0):
    usable = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.add((i, label, tuple(math.floor(scale * float(np.float32(x))) for x in v)))
    out = []
    for i, label, v in usable:
        if not anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j, m) for j, m, w in usable if j != i or m != label)
        for s, j, m in [x for x in scored if x[2] == label and x[1] != i][:positives]:
            fits = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:count]
            out += [(i, j, k, x[1], -s, -x[0]) for k, x in enumerate(fits, 1)]
    return sorted(out)


def clustered(n, width, labels, seed=1):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [
        (i, [c + rnd.gauss(0, 0.3) for c in centres[rnd.randrange(6)]], rnd.randrange(labels)) for i in range(n)
    ]


def mined(spark, rows, parts=3, **more):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    found = negatives.mine(frame, more.pop("anchor", F.col("vec_id") % 50 == 0), **more)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("labels", [1, 2, 40])
def test_against_all_pairs(spark, monkeypatch, labels):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(negatives, "PART_ROWS", 100)
    monkeypatch.setattr(negatives, "SLICE_ANCHORS", 20)  # several slices
    rows = clustered(700, 6, labels)
    assert mined(spark, rows, anchor=F.col("vec_id") % 10 == 0) == brute(rows, anchor=lambda i: i % 10 == 0)


def test_ties_copies_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 8)
    hot = [0.5, 0.25, -0.125]
    rows = [(i, hot if i % 3 else [0.25, 0.5, 0.0], i % 2) for i in range(240)] + [(i, [0.4, 0.2, 0.0], 3) for i in range(240, 260)]
    rows += rows[:60] + [(50, [0.75, 0.5, 0.0], 1), (-50, hot, 1), (0, hot, 7)]  # repeated rows, and ids with two vectors
    assert mined(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    good = clustered(120, 4, 3, seed=2)
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0] * 4, 0), (200, None, 0), (201, [1.0] * 4, None), (202, [1.0, None, 1.0, 1.0], 0), (203, [nan, 1.0, 1.0, 1.0], 1),
           (204, [inf, 0.0, 0.0, 0.0], 1), (205, [], 1), (250, [1.0], 2), (206, [1.0, 2.0], 0), (300, [], 0), (207, [0.0] * 4, 1)]
    assert mined(spark, good + odd) == brute(good + odd)
    assert mined(spark, good[1:40]) == [] and mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == brute([(0, [], 1), (1, [], 1), (2, [], 2)])
    wide = spark.createDataFrame([(*r, 1, 2, "x") for r in good], SCHEMA + ", id int, rank int, part string")
    found = negatives.mine(wide, F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute(good)


@pytest.mark.parametrize("size", [100.0, 30_000.0, 1e6])
def test_large_numbers_stay_exact(spark, size):
    rows = [(i, [x * size for x in v], label) for i, v, label in clustered(150, 5, 2, seed=4)]
    assert mined(spark, rows) == brute(rows)
    with pytest.raises(ValueError):
        mined(spark, [(0, [1e9], 1), (1, [1e9], 1)])


def test_curve():
    for dims, bits in ((2, 4), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        place = negatives.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        walk = cells[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()  # neighbours on the curve are neighbours in space


def test_bounds_hold_and_blocks_are_skipped():
    rng = np.random.default_rng(3)
    anchors = negatives.Anchors(np.arange(20), np.arange(20) % 2, rng.integers(-9, 9, (20, 5)).astype(np.float32), np.zeros(20, np.int64))
    values = rng.integers(-5, 7, (50, 5))
    low, high = anchors.bounds(values.min(0), values.max(0))
    score = anchors.values @ values.T
    assert (low[:, None] <= score).all() and (score <= high[:, None]).all()
    ends = np.full((20, 1), 10**6)
    far = negatives.Search(anchors, True, 5, np.full((20, 1), int(high.max()) + 1), ends)
    assert not far.wanted(0, 1, values.min(0), values.max(0)).any()
    near = negatives.Search(anchors, True, 5, np.full((20, 1), -(10**6)), ends)
    assert near.wanted(0, 1, values.min(0), values.max(0)).all() and not near.wanted(5, 9, values.min(0), values.max(0)).any()
    assert near.wanted(1, 1, values.min(0), values.max(0)).sum() == 10
    other = negatives.Search(anchors, False, 5, np.full((20, 1), -(10**6)), ends)
    assert other.wanted(1, 1, values.min(0), values.max(0)).sum() == 10 and other.wanted(0, 1, values.min(0), values.max(0)).all()
