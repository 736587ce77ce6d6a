"""Long series of many small blocks: what a call of Python costs must not count once per block."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.group import GroupedData

from driftline.operators import kalman, lowess, robust
from driftline.operators.blocks import arrange, position
from driftline.operators.lowess import smooth, smooth_array
from driftline.operators.peaks import keep_distant, local_maxima, suppress_near, with_prominence
from driftline.operators.per_series import map_groups, whole_groups
from driftline.operators.quantiles import run_medians
from driftline.operators.steps import with_steps
from driftline.operators.tiles import ranges, tile
from driftline.plans.detect import compare_methods, detect_keplerian


@pytest.fixture
def calls(monkeypatch):
    """The plans with one call per group that were asked for."""
    seen, real = [], GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, f, schema: seen.append(f) or real(self, f, schema))
    return seen


@pytest.fixture
def samples(spark):
    rng = random.Random(5)
    rows = [(norad, dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.uniform(0, 900)), 42000 + rng.gauss(0, 3), float(rng.randint(0, 9)))
            for norad in range(40) for _ in range(30)]
    return spark.createDataFrame(rows, "norad long, epoch timestamp_ntz, sma double, x double")


def filtered(samples):
    out = kalman.detect_kalman(arrange(samples, ["norad"], "epoch"))
    return out, {(r.norad, r.k): (r.innovation, r.nis, r.rate) for r in out.rows.collect()}


def test_blocks_of_a_filter_share_calls(spark, samples, calls, tiny_blocks):
    out, cut = filtered(samples)
    assert out.short.count() == 0 and len({(r.norad, r._block) for r in out.long.select("norad", "_block").collect()}) > 200
    # Only the table of short series, empty here, takes a call per series.
    assert len(calls) == 1
    spark.conf.set("driftline.rowsPerBlock", "1000")
    _, whole = filtered(samples)
    assert len(whole) == 40 * 29 and cut.keys() == whole.keys()
    for key, values in whole.items():
        assert cut[key] == pytest.approx(values, rel=1e-6, abs=1e-6)


def test_combined_runs_and_carried_states():
    rng = np.random.default_rng(3)
    bounds = np.array([0, 1, 8, 10, 31])
    steps = kalman.single_steps(rng.uniform(0.1, 2, 31), rng.normal(42000, 3, 31), 0.13, 1.0)
    before = steps.copy()
    runs = kalman.combine_runs(steps, bounds)
    assert (steps == before).all()
    for i, run in enumerate(runs):
        one = steps[bounds[i]:bounds[i + 1]]
        while len(one) > 1:
            odd = one[-1:] if len(one) % 2 else one[:0]
            even = one[:len(one) - len(odd)]
            one = np.concatenate([kalman.combine(even[0::2], even[1::2]), odd])
        assert run == pytest.approx(one[0], rel=1e-12)
    x0, x1 = rng.normal(42000, 3, 31), rng.normal(0, 1, 31)
    states = kalman.carried_states(x0, x1, steps, bounds, 1000.0)
    for a, b in zip(bounds[:-1], bounds[1:]):
        mean, cover = np.array([x0[a], x1[a]]), np.diag([1000.0, 1000.0])
        for i in range(a, b):
            assert states[i] == pytest.approx([*mean, cover[0, 0], cover[0, 1], cover[1, 1]], rel=1e-9)
            mean, cover = kalman.apply_step(mean, cover, steps[i])


def test_whole_groups_across_batches():
    key = [None, None, 1.0, 1.0, 1.0, 1.0, float("nan"), float("nan"), 2.0]
    other = ["a", "a", "a", "b", "b", "b", "b", "b", "b"]
    rows = pa.RecordBatch.from_pydict({"key": pa.array(key, pa.float64()), "other": other, "at": range(9)})
    wanted = [[0, 1], [2], [3, 4, 5], [6, 7], [8]]
    for step in range(1, 10):
        tables = list(whole_groups(iter([rows.slice(i, step) for i in range(0, 9, step)] + [rows.slice(0, 0)]), ["key", "other"]))
        assert [x for t in tables for x in t["at"].to_pylist()] == list(range(9))
        ends = [t["at"][-1].as_py() for t in tables]
        assert set(ends) <= {group[-1] for group in wanted}


def test_many_groups_in_one_call(spark):
    rows = spark.range(3000).select((F.col("id") % 500).alias("g"), (-F.col("id")).alias("at")).repartition(2)

    def change(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        g, at = table["g"].to_numpy(), table["at"].to_numpy()
        for a, b in zip(bounds[:-1], bounds[1:]):
            assert b - a == 6 and (g[a:b] == g[a]).all() and (np.diff(at[a:b]) > 0).all()
        return pa.table({"n": [len(bounds) - 1]})

    found = [r.n for r in map_groups(rows, ["g"], "at", T.StructType([T.StructField("n", T.LongType())]), change).collect()]
    assert sum(found) == 500 and len(found) <= 8


def peaks_of(samples):
    series = arrange(samples.select("norad", "epoch", "x"), ["norad"], "epoch").extend(k=position())
    return local_maxima(series, {"x": "is_peak"})


def test_tiles_of_suppression_share_calls(spark, samples, calls, tiny_blocks):
    out = suppress_near(peaks_of(samples).with_columns({"distance": F.lit(7).cast("bigint")}), [("is_peak", "x", "kept")], "distance")
    rows = out.long.collect()
    assert not [f for f in calls if f.__name__ != "run"]
    assert len(rows) == 40 * 30 and any(r.is_peak and not r.kept for r in rows)
    for norad in range(40):
        own = sorted((r for r in rows if r.norad == norad), key=lambda r: r.k)
        arrays = [np.array([float(r[c]) for r in own]) for c in ("k", "x", "is_peak", "distance")]
        assert [r.kept for r in own] == keep_distant(*arrays).tolist()


def test_blocks_of_prominence_share_calls(spark, samples, calls, tiny_blocks):
    with_prominence(peaks_of(samples), "x").long.count()
    assert len([f for f in calls if f.__name__ == "run"]) == 1  # that of the short series


def smoothed(rows, frac):
    series = arrange(rows, ["norad"], "t")
    return smooth(series, {"fit": ("x", frac)}, at="t")


def check_smoothed(rows, found, frac, series):
    for norad in series:
        own = sorted((r for r in rows if r[0] == norad), key=lambda r: r[1])
        t, x = (np.array([np.nan if r[c] is None else r[c] for r in own], float) for c in (1, 2))
        fit = np.array([np.nan if r.fit is None else r.fit for r in sorted((r for r in found if r.norad == norad), key=lambda r: r.t)])
        assert fit == pytest.approx(smooth_array(t, x, frac), rel=1e-6, abs=1e-6, nan_ok=True)


def test_tiles_of_smoothing_share_calls(spark, calls, tiny_blocks):
    rng = random.Random(8)
    rows = [(norad, rng.uniform(0, 900), None if rng.random() < 0.1 else rng.gauss(0, 3)) for norad in range(30) for _ in range(25)]
    found = smoothed(spark.createDataFrame(rows, "norad long, t double, x double"), 0.3).long.collect()
    assert len(calls) == 1  # that of the short series
    check_smoothed(rows, found, 0.3, range(30))


def test_rows_at_one_time_share_a_fit(spark, tiny_blocks):
    """No row is doubled by others at its time, also where a tile ends between them."""
    rng = random.Random(6)
    rows = [(norad, float(rng.randint(0, 40)), rng.gauss(0, 3)) for norad in range(12) for _ in range(60)]
    found = smoothed(spark.createDataFrame(rows, "norad long, t double, x double"), 0.3).long.collect()
    assert sorted((r.norad, r.t, r.x) for r in found) == sorted(rows)
    fits = {(r.norad, r.t): r.fit for r in found}
    assert None not in fits.values() and all(r.fit == fits[r.norad, r.t] for r in found)


@pytest.mark.parametrize("width,batch", [(300, "3"), (90, "50")])
def test_smoothing_over_many_tiles(spark, width, batch):
    """Neighbours over many tiles, some sums from moments; a tile meets more rows than a batch holds."""
    rng = np.random.default_rng(4)
    gaps = np.concatenate([rng.exponential(size=1500), [4e3], rng.exponential(size=900) * 50, [1e4], rng.exponential(size=400) * 0.1])
    t = np.cumsum(gaps)
    rows = [(1, float(a), float(b)) for a, b in zip(t, np.sin(t / 900) + 0.3 * rng.normal(size=len(t)))]
    rows += [(2, float(i), float(rng.normal())) for i in range(400)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("driftline.rowsPerBlock", str(width))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = smoothed(spark.createDataFrame(rows, "norad long, t double, x double").repartition(6), 0.25).long.collect()
    finally:
        spark.conf.unset("driftline.rowsPerBlock")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    check_smoothed(rows, found, 0.25, (1, 2))


def test_medians_of_runs(spark):
    rng = np.random.default_rng(9)
    make = [lambda n: rng.normal(size=n), lambda n: rng.integers(0, 3, n).astype(float), lambda n: np.where(rng.random(n) < 0.6, 0.0, rng.random(n)),
            lambda n: rng.exponential(size=n) * 10.0 ** rng.integers(-6, 6)]
    groups = {g: [np.sort(make[g % 4](int(rng.integers(0, 1 + 10 ** (1 + g % 4))))) for _ in range(1 + g % 7)] for g in range(28)} | {28: [np.zeros(0)]}
    runs = spark.createDataFrame([(g, x.tolist()) for g, xs in groups.items() for x in xs], "g long, v array<double>").repartition(5)
    found = {r.g: (r.n, r.median) for r in run_medians(runs, ["g"], "v").collect()}
    want = {g: np.concatenate(xs) for g, xs in groups.items() if sum(map(len, xs))}
    assert found.keys() == want.keys()
    for g, x in want.items():
        assert found[g] == (len(x), pytest.approx(float(np.median(x)), rel=1e-15))


def test_tiles_from_blocks_of_any_length(spark):
    blocks = spark.createDataFrame([("a", 1, 3, [0, 1, 2]), ("a", 2, 7, [*range(3, 10)]), ("a", 5, 1, [10]), ("b", 1, 2, [0, 1])],
                                   "key string, _block int, _len long, at array<long>")
    found = sorted((r.key, r._tile, r._i0, r["at"]) for r in tile(blocks, ["key"], ["at"], 4).collect())
    assert found == [("a", 0, 0, [0, 1, 2, 3]), ("a", 1, 4, [4, 5, 6, 7]), ("a", 2, 8, [8, 9, 10]), ("b", 0, 0, [0, 1])]
    assert ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_thresholds_write_the_rows_once(spark, samples, monkeypatch, tiny_blocks):
    """Medians, deviations and steps of all signals come from one sorting of the blocks."""
    written, real = [], robust.materialise
    monkeypatch.setattr(robust, "materialise", lambda df, name: written.append(df.columns) or real(df, name))
    series = with_steps(arrange(samples, ["norad"], "epoch")).with_columns(
        {"x": F.when(F.col("norad") % 5 > 0, F.col("x")).otherwise(F.when(F.col("k") < 4, F.col("x")).otherwise(F.lit(float("nan"))))})
    rows = robust.with_thresholds(series, {"x": "a_", "sma": "b_"}, 2.0, 3.0).long.collect()
    assert len([columns for columns in written if "epoch" in columns]) == 1
    assert len(rows) == 40 * 29
    for norad in range(40):
        own = sorted((r for r in rows if r.norad == norad), key=lambda r: r.k)
        k, dt = np.array([r.k for r in own]), np.array([r.dt_days for r in own])
        for signal, level in (("x", "a_threshold"), ("sma", "b_threshold")):
            want = robust.threshold_of(np.abs(np.array([r[signal] for r in own], float)), 2.0)
            assert [r[level] for r in own] == pytest.approx([want] * len(own), rel=1e-12)
        assert {r.distance for r in own} == {robust.distance_of(k, dt, 3.0)}


@pytest.fixture
def elements(spark, samples):
    wide = {"raan": 360, "arg_perigee": 360, "mean_anomaly": 360, "inclination": 60, "eccentricity": 0.1, "mean_motion": 0.01}
    return samples.where("norad < 6").select("norad", "epoch", "sma", *[(F.pmod(F.hash("sma", F.lit(c)), F.lit(997)) / 997 * top).alias(c) for c, top in wide.items()]).withColumn(
        "mean_motion", F.col("mean_motion") + 1)


def test_a_detector_of_long_series_shares_calls(spark, elements, calls, tiny_blocks):
    found = detect_keplerian(elements, frac=0.3, sigma=1.0, min_distance_days=2.0).collect()
    assert len(calls) == 1  # that of the short series
    assert len(found) == 6 * 29 and any(r.is_maneuver for r in found)


def test_signals_are_smoothed_side_by_side(spark, elements, calls, tiny_blocks, monkeypatch):
    written, real = [], lowess.write_tiles
    monkeypatch.setattr(lowess, "write_tiles", lambda tiles, name: written.append(name) or real(tiles, name))
    found = compare_methods(elements, 1.0, 2.0, keplerian_frac=0.3, j2_frac=0.2).collect()
    assert len(calls) == 1 and written.count("fits") == lowess.ROBUST_PASSES + 1
    spark.conf.set("driftline.rowsPerBlock", "1000")
    whole = {(r.norad, r.k): r for r in compare_methods(elements, 1.0, 2.0, keplerian_frac=0.3, j2_frac=0.2).collect()}
    assert len(found) == len(whole) == 6 * 29
    for r in found:
        same = whole[r.norad, r.k]
        assert (r.keplerian_maneuver, r.j2_maneuver) == (same.keplerian_maneuver, same.j2_maneuver)
        assert (r.keplerian_signal, r.j2_signal) == pytest.approx((same.keplerian_signal, same.j2_signal), rel=1e-6, abs=1e-9)
