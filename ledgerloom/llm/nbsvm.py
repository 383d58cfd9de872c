"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by naive Bayes log-count ratios.

Tokens are words and runs of other signs. The n-grams are single tokens and pairs of tokens, and pairs and triples of token
shapes (letter case, digits, or the signs themselves) with a mark for a token that repeats the one before. Their indicators are multiplied by
the log ratio of their smoothed shares in the two classes, and the weights are fitted by dual coordinate descent. A
sigmoid that is fitted on margins of rows kept apart turns the margin into a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import REMEMBERED_WORDS, annotate, mix

#: Labelled rows that a model is fitted on at most: the first by a hash of their id.
FIT_ROWS = 8_000
FEATURES = 1 << 18
#: Smoothing of the counts, cost of errors, passes, and parts of the rows whose margins come from a fit on the others.
ALPHA, COST, PASSES, PARTS = 1.0, 0.1, 20, 5

_TOKENS = re.compile(r"\w+|[^\w\s]+").findall


class _Tokens(dict):
    """Token to 64 bits: a hash above, the token's shape in the last byte."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        digest = xxhash.xxh64_intdigest(token.lower() if token[0].isalnum() else token)
        if token.isdigit():
            shape = 0
        elif not token[0].isalnum():
            shape = 8 + digest % 248
        else:
            shape = 1 + (token.islower(), token.istitle(), token.isupper()).index(True) if token.isalpha() and (
                token.islower() or token.istitle() or token.isupper()
            ) else 4
        value = self[token] = digest & ~0xFF | shape
        return value

    def features(self, text: str | None) -> np.ndarray:
        """The distinct n-grams of a text as feature numbers, sorted; none for a null or empty text."""
        tokens = _TOKENS(text) if text else []
        if not tokens:
            return np.empty(0, np.int32)
        value = np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))
        follows = mix(mix(value[:-1]) * np.uint64(0x9E3779B97F4A7C15) ^ value[1:])
        shape = value & np.uint64(0xFF)
        shape[1:] |= (value[1:] == value[:-1]).astype(np.uint64) << np.uint64(8)
        pairs = shape[:-1] << np.uint64(9) | shape[1:]
        triples = pairs[:-1] << np.uint64(9) | shape[2:]
        grams = [mix(value ^ np.uint64(1)), follows, mix(np.unique(pairs) ^ np.uint64(2 << 56)), mix(np.unique(triples) ^ np.uint64(3 << 56))]
        return np.unique(np.concatenate(grams) >> np.uint64(46)).astype(np.int32)


@dataclass
class Model:
    """Weights per feature, with the bias and the sigmoid's slope and offset."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, features: np.ndarray) -> float:
        margin = float(self.weights[features].sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit on the features of some rows; with one class only, the score is that class's smoothed share."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    flat = Model(np.zeros(FEATURES), 0.0, 0.0, float(np.log(share / (1 - share))))
    if not 0 < labels.sum() < len(labels):
        return flat
    signs = np.where(labels > 0, 1.0, -1.0)
    part = np.arange(len(rows)) % PARTS
    margins = np.zeros(len(rows))
    for k in range(PARTS):
        apart = np.flatnonzero(part == k)
        weights, bias = _fit(rows, signs, np.flatnonzero(part != k))
        margins[apart] = [weights[rows[i]].sum() + bias for i in apart]
    return Model(*_fit(rows, signs, np.arange(len(rows))), *_sigmoid(margins, labels))


def _fit(rows: list[np.ndarray], signs: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias from some of the rows."""
    counts = [np.full(FEATURES, ALPHA), np.full(FEATURES, ALPHA)]
    for k in own:
        counts[int(signs[k] > 0)][rows[k]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    return _descend([rows[k] for k in own], signs[own], ratio)


def _descend(rows: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared hinge loss; weights come back times the ratios.

    The rows' order in each pass comes from a fixed seed, so a retried task fits the same model.
    """
    values = [ratio[r] for r in rows]
    square = np.array([v @ v for v in values]) + 1 + 0.5 / COST
    weights, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    random = np.random.default_rng(7)
    for _ in range(PASSES):
        moved = 0.0
        for k in random.permutation(len(rows)):
            slope = signs[k] * (values[k] @ weights[rows[k]] + bias) - 1 + alpha[k] * 0.5 / COST
            new = max(alpha[k] - slope / square[k], 0.0)
            step = (new - alpha[k]) * signs[k]
            if step:
                weights[rows[k]] += step * values[k]
                bias += step
                alpha[k] = new
                moved = max(moved, abs(step))
        if moved < 1e-6:
            break
    return weights * ratio, bias


def _sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest sigmoid, with smoothed targets, by Newton's method."""
    n1 = labels.sum()
    n0 = len(labels) - n1
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.array([1.0, 0.0])
    design = np.stack([margins, np.ones(len(margins))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ x, -30, 30)))
        gradient = design.T @ (p - target) + 1e-3 * x
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), gradient)
        x = x - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(x[0]), float(x[1])


def fit(
    docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS
) -> Model:
    """Fit on at most `rows` labelled documents, in one task; only the model comes to the driver.

    Null ids and labels are left out; of several texts or labels with one id the smallest is taken.
    """
    own = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__key")).agg(
        F.min(F.col(label).cast("int")).alias("label")
    ).orderBy(F.xxhash64("__key"), "__key").limit(rows)
    texts = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(own), "__key"  # at most `rows` rows of two numbers
    ).groupBy("__key", "label").agg(F.min("text").alias("text"))
    schema = T.StructType([T.StructField("features", T.ArrayType(T.IntegerType()))])
    ready = annotate(texts, "text", schema, _extract).select("__key", "label", "features")
    out = ready.repartition(1).mapInArrow(_fit_task, "weights binary, bias double, slope double, offset double").head()
    return Model(np.frombuffer(out["weights"], np.float64), out["bias"], out["slope"], out["offset"])


def _extract():
    tokens = _Tokens()
    return lambda texts: [[tokens.features(t) for t in texts]]


def _fit_task(batches):
    found = []
    for b in batches:
        lists = b.column("features")
        for k, key, label in zip(range(b.num_rows), b.column("__key").to_pylist(), b.column("label").to_pylist(), strict=True):
            found.append((xxhash.xxh64_intdigest(str(key)), label, lists[k].values.to_numpy(zero_copy_only=False)))
    found.sort(key=lambda x: x[0])
    model = fit_rows([f for _, _, f in found], np.array([label for _, label, _ in found], np.int64))
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.weights.tobytes()], pa.binary()), *[pa.array([x]) for x in (model.bias, model.slope, model.offset)]],
        ["weights", "bias", "slope", "offset"],
    )


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `score`, from 0 to 1: how likely label 1 is. Null and empty texts get the score of a text without any
    n-gram; a column named `score` is replaced. The model has a fixed size and goes to the tasks whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        tokens, own = _Tokens(), shared.value
        return lambda texts: [[own.score(tokens.features(t)) for t in texts]]

    return annotate(docs, text, T.StructType([T.StructField("score", T.DoubleType())]), start)
