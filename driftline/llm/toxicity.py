"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Words are runs of letters and digits in lower case (A-Z; other bytes stay). A text's features are the
distinct hashes, modulo 2^20, of its words, of the words' first letters (a stem), of pairs of
neighbours and of pairs with one or two words between. FTRL-proximal gives each coordinate its own
rate and keeps a weight at zero until its gradients outweigh the L1 penalty, so the model that
is broadcast is a few thousand weights, and at most 2^20.

Training uses a bounded sample of the labelled rows (``most_rows``, the smallest by a hash of the id;
all rows where there are fewer). Shards of ``shard_rows`` rows train apart and their weights are
averaged. Scoring reads every whole text once, in place, without a shuffle.

Defined cases: null and empty texts get the bias alone; equal texts get equal scores; of the rows that share an
id, the one with the least features (in byte order) trains, once per label of the id; with no labelled rows every score is one half; other columns are
passed through or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from driftline.llm.texts import Words, mix, pieces, separators, text_bytes
from driftline.session import materialise

BUCKET_BITS = 20
STEM_BYTES = 5
MOST_ROWS = 20_000
SHARD_ROWS = 5_000
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def text_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all texts and the text of each; repeats are kept."""
    data, at = text_bytes(column)
    words = Words(data, at, lower=True, separator=separators(_PUNCTUATION))
    owner, h = words.owner(), words.hash
    stems = words.hashes(np.minimum(words.end, words.start + STEM_BYTES))
    keys, who = [h, mix(stems + np.uint64(11))], [owner, owner]
    for gap in (1, 2, 3):
        if len(h) > gap:
            same = owner[gap:] == owner[:-gap]
            keys.append(mix(mix(h[:-gap] + np.uint64(gap)) + h[gap:])[same])
            who.append(owner[gap:][same])
    return (np.concatenate(keys) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.concatenate(who)


def _scores(index: np.ndarray, value: np.ndarray, bias: float, column: pa.Array) -> np.ndarray:
    table = np.zeros(1 << BUCKET_BITS)
    table[index] = value
    buckets, who = text_buckets(column)
    hit = np.flatnonzero(table[buckets])
    pair = np.unique((who[hit] << BUCKET_BITS) | buckets[hit])
    z = bias + np.bincount(pair >> BUCKET_BITS, table[pair & ((1 << BUCKET_BITS) - 1)], len(column))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Model:
    """Sparse weights: ``index`` (buckets) and ``value``, and the ``bias``."""

    index: np.ndarray
    value: np.ndarray
    bias: float

    def column(self, text: str = "text") -> Column:
        """The score of a text column, in Arrow batches; the weights are broadcast."""
        shared = SparkSession.getActiveSession().sparkContext.broadcast((self.index, self.value, self.bias))

        @F.arrow_udf(DoubleType())
        def score(column: pa.Array) -> pa.Array:
            texts = pa.RecordBatch.from_arrays([column.cast(pa.string())], ["t"])
            parts = [_scores(*shared.value, b.column(0)) for b in pieces(iter([texts]), "t")]
            return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

        return score(F.col(text))


def ftrl(examples: list[tuple[np.ndarray, int]], alpha: float, beta: float, l1: float, l2: float, rounds: int) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (distinct buckets, label) in the given order; the last coordinate is the bias."""
    size = (1 << BUCKET_BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(i):
        out = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        out[np.abs(z[i]) <= l1] = 0
        return out

    for _ in range(rounds):
        for i, label in examples:
            w = weight(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weight(np.arange(size))
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", most_rows: int = MOST_ROWS,
        shard_rows: int = SHARD_ROWS, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1, rounds: int = 5) -> Model:
    """Train on the rows of ``labels`` (id and 0/1 label, nulls left out) that the sample takes."""
    order = F.xxhash64(F.col(doc_id).cast("string"), F.lit(17))
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y"), order.alias("place"))
    known = materialise(known.orderBy("place", "doc_id", "y").limit(most_rows), "toxic-labels")
    shards = max(1, -(-known.count() // shard_rows))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    rows = rows.join(F.broadcast(known), "doc_id").select(F.pmod("place", F.lit(shards)).cast("int").alias("shard"), "place", "y", "t")

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t"):
            keys, who = text_buckets(b.column(3))
            pair = np.unique((who << BUCKET_BITS) | keys)
            cut = np.searchsorted(pair >> BUCKET_BITS, np.arange(b.num_rows + 1))
            low = (pair & ((1 << BUCKET_BITS) - 1)).astype(np.int32)
            packed = pa.array([low[cut[i]:cut[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], packed], ["shard", "place", "y", "x"])

    def train(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["place"].to_pylist(), table["y"].to_pylist(), table["x"].to_pylist()))
        bias = np.array([1 << BUCKET_BITS])
        w, b = ftrl([(np.concatenate([np.frombuffer(x, np.int32), bias]), y) for _, y, x in rows], alpha, beta, l1, l2, rounds)
        at = np.flatnonzero(w)
        return pa.table({"k": pa.array([*at, 1 << BUCKET_BITS], pa.int32()), "w": pa.array([*w[at], b], pa.float64())})

    features = rows.mapInArrow(buckets, "shard int, place long, y int, x binary")
    # Map tasks keep one row of an id and label each, so an id that very many rows share is one row of its shard.
    once = features.groupBy("shard", "place", "y").agg(F.min("x").alias("x"))
    found = once.groupBy("shard").applyInArrow(train, "k int, w double")
    weights = found.groupBy("k").agg((F.sum("w") / shards).alias("w")).orderBy("k").collect()
    k, w = np.array([r.k for r in weights], np.int64), np.array([r.w for r in weights])
    bias = float(w[k == 1 << BUCKET_BITS].sum())
    return Model(k[k < 1 << BUCKET_BITS], w[k < 1 << BUCKET_BITS], bias)
