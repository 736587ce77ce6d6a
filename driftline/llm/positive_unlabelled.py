"""Quality classifier from trusted positives and unlabelled text.

The text is read once into a short vector of counts per document (``text_features``), written to
the shared folder; training works on that table alone. With the logistic loss, the unbiased
positive-unlabelled risk of a linear score g is

    prior * mean_P(-g) + mean_U(log(1 + exp g)),

since log(1 + exp -g) - log(1 + exp g) = -g; it is convex and Newton steps minimise it. The part
that stands for the negatives, mean_U log(1 + exp g) - prior * mean_P log(1 + exp g), cannot be
negative for a true risk (the non-negative estimator): where a step makes it so, the prior was too high, and is
lowered to the largest one that the step allows. The class prior is first estimated from the scores of a first model
of P against U: the share of U at or above a score, divided by the share of P there, bounds the
prior from above, and the least such bound is taken.

Every step is one aggregation over all rows of the feature table into a fixed number of sums.

Defined cases: a null or empty text has the features of no words and a score like any other;
equal texts get equal scores; without positives or without rows the score is the start
prior everywhere; columns other than id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from driftline.llm.texts import Words, give_back, mix, pieces, text_bytes
from driftline.session import materialise

_CLASSES = [b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!", b"0123456789", b".,;:?", bytes(range(128, 256)), b"\n", b"'\"()-/@=_{}[]\\^~`+"]
#: At which value a share counts half.
_HALF = np.array([0.01, 0.1, 0.1, 0.05, 0.1, 0.2, 0.1, 0.05])
N_FEATURES = 20
_BINS = 400


def text_features(column: pa.Array) -> np.ndarray:
    """One row of ``N_FEATURES`` numbers between 0 and 1 (the first is 1) for each text."""
    data, at = text_bytes(column)
    n = len(column)
    words = Words(data, at, lower=True)
    size, count = np.diff(at).astype(float), np.diff(words.bounds).astype(float)
    x = np.zeros((n, N_FEATURES))
    x[:, 0] = 1
    some = np.maximum(count, 1)

    def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)

    def share(flags, half, whole):
        return flags / (flags + half * whole + 1e-12)

    total = None
    for k, chars in enumerate(_CLASSES):
        flag = np.zeros(256, bool)
        flag[list(chars)] = True
        held = flag[data]
        x[:, 1 + k] = share(per_text(held, at), _HALF[k], np.maximum(size, 1))
        if k == 0:
            total = np.concatenate([[0], np.cumsum(held)])
    marked = total[words.end] > total[words.start]
    x[:, 9] = share(per_text(marked, words.bounds), 0.1, some)
    owner = words.owner()

    def distinct(keys: np.ndarray, who: np.ndarray) -> np.ndarray:
        """How many distinct keys each text has."""
        order = np.lexsort((keys, who))
        k, w = keys[order], who[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
        return np.bincount(w[new], minlength=n).astype(float)

    kinds = distinct(words.hash, owner)
    x[:, 10] = np.where(count > 0, kinds / some, 0)
    x[:, 11] = x[:, 10] ** 2
    if len(words.hash) > 2:
        same = (owner[2:] == owner[:-2])
        keys = mix(words.hash[:-2]) + mix(words.hash[1:-1] + np.uint64(1)) * np.uint64(3) + words.hash[2:] * np.uint64(7)
        windows = np.bincount(owner[2:][same], minlength=n).astype(float)
        x[:, 12] = share(windows - distinct(keys[same], owner[2:][same]), 0.1, some)
    lines = Words(data, at, lower=False, separator=np.bincount([10], minlength=256).astype(bool))
    many = np.diff(lines.bounds).astype(float)
    x[:, 13] = share(many - distinct(lines.hash, lines.owner()), 0.2, np.maximum(many, 1))
    length = per_text(words.end - words.start, words.bounds) / some
    x[:, 14] = length / (length + 8)
    x[:, 15] = np.abs(length - 6) / (np.abs(length - 6) + 4)
    x[:, 16] = count / (count + 30)
    x[:, 17] = count / (count + 1000)
    x[:, 18] = many / (many + 0.1 * some + 1e-12)
    x[:, 19] = count == 0
    return x


@dataclass(frozen=True)
class Model:
    """A linear score over the features; ``prior`` is the estimated share of positives."""

    weights: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))

    def column(self, text: str = "text") -> Column:
        """The score of a text column, in Arrow batches."""
        model = self

        @F.arrow_udf(DoubleType())
        def score(column: pa.Array) -> pa.Array:
            parts = [model.scores(text_features(b.column(0)).astype(np.float32).astype(float)) for b in
                     pieces(iter([pa.RecordBatch.from_arrays([column.cast(pa.string())], ["t"])]), "t")]
            return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

        return score(F.col(text))


def score_packed(model: Model):
    """The score of a column of packed features."""
    @F.arrow_udf(DoubleType())
    def score(column: pa.Array) -> pa.Array:
        x = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(float)
        return pa.array(model.scores(x), pa.float64())

    return score


def feature_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``x`` (packed float32 features) of every document, written to the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in pieces(batches, "t"):
            x = text_features(b.column(1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])
        give_back()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    return materialise(rows.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, x binary"), "features")


def _sums(rows: DataFrame, count) -> np.ndarray:
    """The sum of ``count(x, positive)`` (a vector) over all batches, added up by Spark."""
    def run(batches):
        total = None
        for b in batches:
            x = np.frombuffer(b"".join(b.column(0).to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(float)
            part = count(x, np.array(b.column(1), bool))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], ["k", "v"])

    found = rows.select("x", "positive").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(max((r.k for r in found), default=-1) + 1)
    for r in found:
        out[r.k] = r.v
    return out


def _newton(rows: DataFrame, prior: float, non_negative: bool, rounds: int, ridge: float) -> tuple[np.ndarray, float]:
    """Minimise the risk above over all rows (U) and the positives among them (P); weights and the prior in the end."""
    d, weights, step, last = N_FEATURES, np.zeros(N_FEATURES), None, np.inf
    taken = weights  # the last ones that passed
    for _ in range(rounds):
        w = weights

        def count(x, positive):
            g = np.clip(x @ w, -30, 30)
            s, loss = 1 / (1 + np.exp(-g)), np.logaddexp(0, g)
            return np.concatenate([[len(x), positive.sum(), loss.sum(), loss[positive].sum(), g[positive].sum()],
                                   x[positive].sum(0), s @ x, ((x * (s * (1 - s))[:, None]).T @ x).ravel()])

        t = _sums(rows, count)
        if not len(t) or not t[1]:
            return np.concatenate([[np.log(prior / (1 - prior))], np.zeros(d - 1)]), prior
        n, p = t[0], t[1]
        if non_negative and t[2] / n < prior * t[3] / p:
            prior, last = 0.999 * (t[2] / n) / (t[3] / p), np.inf
        risk = -prior * t[4] / p + t[2] / n + ridge / 2 * w @ w
        if step is not None and risk > last + 1e-9:
            step = step / 2
            weights = weights - step
            if np.abs(step).max() < 1e-3:
                break
            continue
        last, taken = risk, weights
        slope = t[5 + d:5 + 2 * d] / n - prior * t[5:5 + d] / p + ridge * w
        step = -np.linalg.solve(t[5 + 2 * d:].reshape(d, d) / n + ridge * np.eye(d), slope)
        if np.abs(step).max() < 1e-2:
            break
        weights = weights + step
    return taken, prior


def estimate_prior(rows: DataFrame, weights: np.ndarray) -> float:
    """Least ratio of the tails of U and P over the scores of ``weights``.

    Each tail is moved by its 95 % bound (Dvoretzky, Kiefer, Wolfowitz) to the safe side, so that thin tails of few rows
    do not decide.
    """
    def count(x, positive):
        b = np.minimum((1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))) * _BINS).astype(int), _BINS - 1)
        return np.concatenate([np.bincount(b, minlength=_BINS), np.bincount(b[positive], minlength=_BINS)]).astype(float)

    t = _sums(rows, count)
    if not len(t) or not t[_BINS:].sum():
        return 0.5
    u, p = (np.cumsum(x[::-1]) / x.sum() for x in (t[:_BINS], t[_BINS:]))
    slack_u, slack_p = (np.sqrt(np.log(20) / (2 * x.sum())) for x in (t[:_BINS], t[_BINS:]))
    ratio = ((u + slack_u) / np.maximum(p - slack_p, 1e-9))[p > 2 * slack_p]
    return float(np.clip(ratio.min(initial=0.98), 0.05, 0.98))


def fit(features: DataFrame, positives: DataFrame, doc_id: str = "doc_id", rounds: int = 25, ridge: float = 1e-4) -> Model:
    """Train on all of ``features`` as unlabelled and the ids in ``positives`` as trusted."""
    trusted = positives.select(F.col(doc_id).alias("doc_id")).distinct().withColumn("positive", F.lit(True))
    rows = features.join(trusted, "doc_id", "left").select("x", F.coalesce("positive", F.lit(False)).alias("positive"))
    rows = materialise(rows, "pu-rows")
    first, _ = _newton(rows, 0.5, False, 8, 1e-2)
    return Model(*_newton(rows, estimate_prior(rows, first), True, rounds, ridge))
