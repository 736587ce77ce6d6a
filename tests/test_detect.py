import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import kalman, lowess, peaks
from driftline.operators.blocks import arrange, position
from driftline.operators.robust import robust_summary, with_thresholds
from driftline.operators.steps import keplerian_residual
from driftline.session import materialise
from driftline.plans.detect import (
    align_methods, compare_methods, detect_j2, detect_kalman, detect_keplerian, detection_counts, ordered_history)

COLUMNS = ("norad long, epoch timestamp_ntz, creation_date timestamp_ntz, raan double, arg_perigee double, "
           "mean_anomaly double, mean_motion double, inclination double, eccentricity double, sma double")


def orbit_rows(norad, n, jump_at=None, sma_jump=0.0, angle_jump=0.0, noise=0.0, seed=0):
    """A regular orbit of one revolution per day, with an optional manoeuvre."""
    rng = random.Random(seed)
    rows, anomaly, sma = [], 10.0, 42164.0
    start = dt.datetime(2026, 1, 1)
    for i in range(n):
        if i == jump_at:
            anomaly, sma = anomaly + angle_jump, sma + sma_jump
        epoch = start + dt.timedelta(hours=8 * i)
        mean = (anomaly + 360.0 * 8 * i / 24 + rng.uniform(-noise, noise)) % 360
        rows.append((norad, epoch, epoch, 40.0, 50.0, mean, 1.0, 0.0, 0.0, sma + rng.uniform(-noise, noise)))
    return rows


def test_sizes_of_series(spark):
    rows = [r for norad, n in ((1, 1), (2, 2), (3, 3), (4, 4)) for r in orbit_rows(norad, n, noise=1.0)]
    frame = spark.createDataFrame(rows, COLUMNS)
    got = {r.norad: r.n for r in compare_methods(frame).groupBy("norad").agg(F.count("*").alias("n")).collect()}
    assert got == {2: 1, 3: 2, 4: 3}
    few = detect_keplerian(frame, smoothed=False).where("norad < 4").collect()
    assert len(few) == 3 and all(r.threshold is None and r.is_maneuver is False for r in few)
    assert compare_methods(frame.where("false")).collect() == []


def test_detection_is_one_exchange_and_one_pass(spark):
    """Deduplication, pairing and everything in Python share the exchange by object."""
    frame = spark.createDataFrame(orbit_rows(1, 40, jump_at=20, angle_jump=5.0) + orbit_rows(2, 40), COLUMNS)
    for found in (compare_methods(frame, min_prominence=0.1), detect_keplerian(frame), detect_keplerian(frame, smoothed=False), detect_j2(frame)):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert len(re.findall(r"\bExchange ", final)) == 1 and len(re.findall("FlatMapGroupsInArrow|MapInArrow|ArrowEvalPython", final)) == 1


def test_short_series_are_not_written_beside_a_long_one(spark, monkeypatch):
    from driftline.operators import blocks, kalman, lowess, peaks, quantiles, robust

    written = []

    def spy(df, name):
        out = materialise(df, name)
        if "norad" in out.columns and "epoch" in out.columns:
            written.append((name, {r.norad for r in out.select("norad").distinct().collect()}))
        return out

    for module in (blocks, kalman, lowess, peaks, quantiles, robust):
        if hasattr(module, "materialise"):
            monkeypatch.setattr(module, "materialise", spy)
    frame = spark.createDataFrame([r for n, size in ((1, 9), (2, 60), (3, 9)) for r in orbit_rows(n, size, noise=1.0, seed=n)], COLUMNS)
    spark.conf.set("driftline.rowsPerBlock", "20")
    try:
        cut = compare_methods(frame, keplerian_frac=0.3, j2_frac=0.3, sigma=1.0, min_distance_days=1.0, min_prominence=0.0).collect()
    finally:
        spark.conf.unset("driftline.rowsPerBlock")
    assert written and all(norads <= {2} for _, norads in written)
    whole = compare_methods(frame, keplerian_frac=0.3, j2_frac=0.3, sigma=1.0, min_distance_days=1.0, min_prominence=0.0).collect()
    key = lambda r: (r.norad, r.k)
    for a, b in zip(sorted(cut, key=key), sorted(whole, key=key), strict=True):
        assert all(x == y or (isinstance(x, float) and abs(x - y) <= 1e-6 * max(1.0, abs(y))) for x, y in zip(a, b, strict=True))


def test_detectors_read_only_their_columns(spark, tmp_path):
    path = str(tmp_path / "h")
    spark.createDataFrame(orbit_rows(1, 5), COLUMNS).write.parquet(path)
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        detect_kalman(spark.read.parquet(path))._jdf.queryExecution(), "formatted")
    read = [line for line in plan.splitlines() if line.startswith("ReadSchema")][0]
    assert "sma" in read and "raan" not in read and "mean_motion" not in read


def test_regular_motion_has_no_residual(spark):
    frame = spark.createDataFrame(orbit_rows(1, 30), COLUMNS)
    out = keplerian_residual(ordered_history(frame)).rows
    assert out.agg(F.max(F.abs("keplerian_residual"))).head()[0] < 1e-9
    assert [r.k for r in out.orderBy("epoch").collect()] == list(range(29))


def test_every_method_finds_an_injected_jump(spark):
    rows = orbit_rows(1, 60, jump_at=30, sma_jump=20.0, angle_jump=5.0, noise=0.01)
    revised = [(*r[:2], r[2] - dt.timedelta(days=1), *r[3:9], 0.0) for r in rows]  # older, wrong publications
    frame = spark.createDataFrame(rows + revised, COLUMNS).repartition(4)
    kep = detect_keplerian(frame, smoothed=False)
    assert [r.k for r in kep.where("is_maneuver").collect()] == [29]
    assert 29 in [r.k for r in detect_j2(frame).where("is_maneuver").collect()]
    flagged = [r.k for r in detect_kalman(frame).where("is_maneuver").collect()]
    assert min(flagged) == 29
    counted = {r.method: r.n_maneuvers for r in detection_counts(
        kep.unionByName(detect_kalman(frame).drop("nis"))).collect()}
    assert counted == {"keplerian": 1, "kalman": len(flagged)}
    both = kep.select("norad", "epoch", "method", "is_maneuver").unionByName(
        detect_kalman(frame).select("norad", "epoch", "method", "is_maneuver"))
    aligned = align_methods(both, ["keplerian", "kalman"]).where("keplerian and kalman").collect()
    assert [r.epoch for r in aligned] == [rows[30][1]]


def test_constant_magnitude_falls_back_to_the_deviation(spark):
    values = [(1, i, 5.0) for i in range(20)] + [(1, 20, 9.0)] + [(2, i, 3.0) for i in range(4)] + [(3, 0, float("nan")), (3, 1, 1.0)]
    series = arrange(spark.createDataFrame(values, "norad long, at long, x double"), ["norad"], "at")
    rows = {r.norad: r for r in robust_summary(series, "x", 4.0).collect()}
    data = np.array([5.0] * 20 + [9.0])
    assert rows[1].mad == 0 and rows[1].threshold == pytest.approx(5.0 + 4.0 * data.std())
    assert rows[2].threshold == 3.0 and rows[3].threshold is None and rows[3].n == 1
    on_rows = with_thresholds(series, {"x": ""}, 4.0).rows.where("norad = 1").select("threshold").distinct().collect()
    assert on_rows[0][0] == pytest.approx(rows[1].threshold)


def naive_peaks(x):
    found, i = [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if j < len(x) - 1 and x[i - 1] < x[i] > x[j + 1]:
            found.append((i + j) // 2)
        i = j + 1
    return found


def naive_prominence(x, p):
    sides = []
    for step in (-1, 1):
        low, i = x[p], p
        while 0 <= i < len(x) and x[i] <= x[p]:
            low, i = min(low, x[i]), i + step
        sides.append(low)
    return x[p] - max(sides)


def test_peaks_against_plain_loops(spark):
    rng = random.Random(4)
    data = {n: [float(rng.randint(0, 4)) for _ in range(size)] for n, size in ((1, 200), (2, 1), (3, 2), (4, 57))}
    data[5], data[6] = [1.0, 1.0, 1.0], [0.0, 3.0, 3.0, 0.0, 2.0, 2.0]
    frame = spark.createDataFrame([(n, i, v) for n, vs in data.items() for i, v in enumerate(vs)], "norad long, at long, x double")
    series = arrange(frame.repartition(4), ["norad"], "at").extend(k=position())
    out = peaks.with_prominence(peaks.local_maxima(series, {"x": "p"}), "x").rows.where("p")
    got = {n: {} for n in data}
    for r in out.collect():
        got[r.norad][r.k] = r.prominence
    for n, x in data.items():
        assert sorted(got[n]) == naive_peaks(x)
        assert all(got[n][p] == naive_prominence(x, p) for p in got[n])


def test_suppression_keeps_the_highest():
    rng = np.random.default_rng(2)
    for gap in (1, 2, 5, 30):
        k = np.arange(300.0)
        h = rng.integers(0, 6, 300).astype(float)
        c = (rng.random(300) < .5).astype(float)
        kept = set()
        for i in sorted(np.flatnonzero(c), key=lambda i: (h[i], i), reverse=True):
            if all(abs(i - j) >= gap for j in kept):
                kept.add(i)
        assert set(np.flatnonzero(peaks.keep_distant(k, h, c, np.full(300, float(gap))))) == kept


def naive_lowess(t, y, frac):
    n = len(t)
    k = min(n, max(2, int(frac * n + 1e-10)))
    weight, fit = np.ones(n), np.empty(n)
    for turn in range(4):
        for i in range(n):
            near = sorted(range(n), key=lambda j: (abs(t[j] - t[i]), j))[:k]
            h = max(abs(t[j] - t[i]) for j in near)
            w = np.array([(1 - (abs(t[j] - t[i]) / h) ** 3) ** 3 * weight[j] for j in near])
            tt, yy = t[near] - t[i], y[near]
            if w.sum() <= 0:
                fit[i] = y[i]
                continue
            mt, my = (w * tt).sum() / w.sum(), (w * yy).sum() / w.sum()
            spread = (w * (tt - mt) ** 2).sum()
            fit[i] = my - (mt * (w * (tt - mt) * yy).sum() / spread if spread > 1e-12 * h * h else 0.0)
        s = np.median(np.abs(y - fit))
        weight = np.where(np.abs(y - fit) < 6 * s, (1 - np.minimum(np.abs(y - fit) / (6 * s), 1) ** 2) ** 2, 0.0) if s > 0 else np.ones(n)
    return fit


def test_lowess_against_a_plain_loop(monkeypatch):
    rng = np.random.default_rng(8)
    t = np.sort(rng.uniform(0, 30, 80))
    y = np.sin(t) + rng.normal(size=80) * .1
    y[[5, 40]] += 8.0
    for frac in (0.01, 0.1, 0.3, 1.0):
        assert np.allclose(lowess.smooth_array(t, y, frac), naive_lowess(t, y, frac), atol=1e-9)
    monkeypatch.setattr(lowess, "_CELLS", 100)  # several chunks
    assert np.allclose(lowess.smooth_array(t, y, 0.3), naive_lowess(t, y, 0.3), atol=1e-9)
    y[7] = np.nan
    out = lowess.smooth_array(t, y, 0.2)
    assert np.isnan(out[7]) and np.allclose(np.delete(out, 7), naive_lowess(np.delete(t, 7), np.delete(y, 7), 0.2), atol=1e-9)
    assert list(lowess.smooth_array(t[:1], y[:1], .5)) == [y[0]] and len(lowess.smooth_array(t[:0], y[:0], .5)) == 0


def test_kalman_steps_combine():
    rng = np.random.default_rng(6)
    dt_, z = rng.uniform(.1, 2, 400), np.cumsum(rng.normal(size=400)) + 42000
    for cut in (1, 7, 200, 399):
        steps = kalman.single_steps(dt_[:cut], z[:cut], .13, 1.0)
        mean, cover = kalman.apply_step(np.array([42000.0, 0.3]), np.diag([1000.0, 1000.0]), kalman.combine_all(steps))
        whole = kalman.run_filter(dt_, z, (42000.0, .3, 1000.0, 0.0, 1000.0), .13, 1.0)
        part = kalman.run_filter(dt_[cut:], z[cut:], (*mean, cover[0, 0], cover[0, 1], cover[1, 1]), .13, 1.0)
        for a, b in zip(whole, part, strict=True):
            assert np.allclose(a[cut:], b, rtol=1e-7, atol=1e-7)


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_results_do_not_depend_on_partitions(spark, partitions):
    rows = [r for n in range(1, 6) for r in orbit_rows(n, 40, jump_at=20, sma_jump=9.0, angle_jump=2.0, noise=.5, seed=n)]
    frame = spark.createDataFrame(rows, COLUMNS)
    run = lambda f: sorted(map(tuple, compare_methods(f, 2.0, 1.0, keplerian_frac=.2, j2_frac=.2).collect()))
    want = run(frame.coalesce(1))
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = run(frame.repartition(13))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == len(want) == 195
    for a, b in zip(want, got, strict=True):
        assert all(u == v or math.isclose(u, v, abs_tol=1e-9) for u, v in zip(a, b, strict=True))
