import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators.blocks import (
    arrange, following, last_seen, next_seen, position, previous, running, series_start,
)

from driftline.operators.quantiles import exact_quantiles, long_quantiles
from driftline.session import materialise


def _series(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for key, n in ((1, 300), (2, 1), (3, 2), (4, 40), (5, 5), (6, 6)):
        at = 0
        for _ in range(n):
            at += rng.randint(1, 50)
            rows.append((key, at, rng.random() if rng.random() > 0.2 else None))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "key long, at long, v double").repartition(7)


@pytest.mark.parametrize("keys", [["key"], []])
def test_blocked_steps_equal_plain_ones(spark, keys):
    frame = _series(spark)
    if not keys:
        frame = frame.withColumn("at", F.col("at") * 10 + F.col("key"))

    def run(rows):
        o = arrange(frame, keys, "at", rows)
        o = o.extend(
            prev=previous("at", "v"), next=following("at", "v"), k=position(),
            total=running(F.col("v")), t0=series_start(F.col("at")),
            before=last_seen(F.col("v")), after=next_seen(F.col("v")),
            before2=last_seen(F.when(F.col("at") % 7 == 0, F.struct("at", "v"))))
        o = o.extend(change=previous("before"), k2=position(-1))
        assert o.heavy == (rows < 100)
        r = o.result().withColumn("total", F.round("total", 9))
        cols = sorted(r.columns)
        return sorted(map(repr, r.select(cols).collect()))

    plain, cut = run(10_000), run(5)
    assert plain == cut


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    data = {1: rng.normal(size=4001), 2: np.repeat([1.0, 2.0, 3.0], 50), 3: np.array([5.0]),
            4: rng.normal(size=8)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [(9, None), (1, None)]
    frame = spark.createDataFrame(rows, "key long, v double").repartition(5)
    for limit in (100_000, 20):
        got = {r.key: r for r in exact_quantiles(frame, ["key"], "v", [0.01, 0.5, 0.99, 0.0, 1.0], limit).collect()}
        assert set(got) == {1, 2, 3, 4}
        for key, vs in data.items():
            assert got[key].n == len(vs)
            assert np.allclose(got[key].quantiles, np.percentile(vs, [1, 50, 99, 0, 100]), atol=1e-12)
    pooled = np.concatenate(list(data.values()))
    for limit in (100_000, 20):
        r = exact_quantiles(frame, [], "v", [0.25], limit).head()
        assert r.n == len(pooled) and abs(r.quantiles[0] - np.percentile(pooled, 25)) < 1e-12


def test_radix_selection_of_any_doubles(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=900), rng.normal(size=300) * 1e-310, rng.normal(size=300) * 1e300, [0.0, -0.0] * 40, [7.5] * 500,
                             [np.inf, -np.inf] * 3])
    frame = spark.createDataFrame([(k, float(v)) for k in (1, None) for v in values] + [(2, 3.0)], "key long, v double")
    ranks = [0, 1, 7, 800, 1000, 1500, 1900, len(values) - 4, len(values) - 1]
    got = {r.key: r for r in long_quantiles(frame, ["key"], "v", [r / (len(values) - 1) for r in ranks]).collect()}
    want = np.sort(values)[ranks]
    assert set(got) == {1, 2, None} and got[2].quantiles == [3.0] * len(ranks)
    for key in (1, None):
        assert got[key].n == len(values) and all(a == b for a, b in zip(got[key].quantiles, want))


def test_radix_selection_counts_digits_only(spark, monkeypatch):
    """Whatever the values, what is written between passes is a table of digits."""
    from driftline.operators import quantiles
    written = []

    def spy(df, name):
        out = materialise(df, name)
        if name == "digit-counts":
            written.append(out.agg(F.count("*").alias("n"), F.max("_digit").alias("top")).head())
        return out

    monkeypatch.setattr(quantiles, "materialise", spy)
    frame = spark.range(300_000).select(F.rand(3).alias("v"), F.lit(1).alias("key"))
    found = long_quantiles(frame, ["key"], "v", [0.25, 0.5]).head()
    assert np.allclose(found.quantiles, np.percentile([r.v for r in frame.collect()], [25, 50]), atol=1e-12)
    assert len(written) == 4 and all(w.top < 65_536 and w.n <= 4 * 65_536 for w in written)
