import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators.clipping import clip_series
from driftline.operators.cluster import cluster_mean, coverage_counts, interpolate, join_members
from driftline.plans.series import chart_series, cluster_series

START = dt.datetime(2026, 1, 1)


def dense_mean(data):
    """The member-by-grid definition."""
    grid = sorted({t for rows in data.values() for t, _ in rows})
    sums = {t: [] for t in grid}
    for rows in data.values():
        rows = sorted(rows)
        if len(rows) < 2:
            continue
        ts = np.array([t for t, _ in rows], dtype=float)
        ys = np.array([np.nan if y is None else y for _, y in rows])
        for t in grid:
            if ts[0] <= t <= ts[-1]:
                y = np.interp(t, ts, ys)
                if not np.isnan(y):
                    sums[t].append(y)
    return {t: (np.mean(v), len(v)) for t, v in sums.items() if v}


def frame_of(spark, data):
    rows = [(n, START + dt.timedelta(microseconds=t), y) for n, points in data.items() for t, y in points]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "norad long, epoch timestamp_ntz, value double").repartition(4)


def check(spark, data):
    got = {round((r.epoch - START) / dt.timedelta(microseconds=1)): (r["mean"], r.n_members)
           for r in cluster_mean(frame_of(spark, data), []).collect()}
    want = dense_mean(data)
    assert set(got) == set(want)
    for t, (mean, n) in want.items():
        assert got[t][1] == n and math.isclose(got[t][0], mean, rel_tol=1e-11, abs_tol=1e-11 * max(
            abs(y) for points in data.values() for _, y in points if y is not None)), t


def test_mean_with_holes_and_lonely_points(spark):
    rng = random.Random(3)
    day = 86_400_000_000
    data = {n: [(rng.randrange(90 * day), rng.uniform(-5, 5) if rng.random() > .2 else None) for _ in range(size)]
            for n, size in ((1, 40), (2, 25), (3, 1), (4, 2), (5, 12))}
    data[6] = [(200 * day, 1.0), (201 * day, None), (202 * day, 3.0)]  # a span of its own
    check(spark, data)


def test_steep_lines_leave_nothing_behind(spark):
    day = 86_400_000_000
    data = {1: [(0, 1.0), (1, 42000.0), (2, -42000.0), (3, 1.0), (900 * day, 2.0)],
            2: [(5, 1e-3), (100 * day, 2e-3), (900 * day, 1e-3)]}
    check(spark, data)


def test_zero_values(spark):
    check(spark, {1: [(0, 0.0), (10, 0.0)], 2: [(5, 0.0), (20, 0.0)]})


def test_repeated_members_count_once(spark):
    frame = frame_of(spark, {1: [(0, 1.0), (10, 3.0)], 2: [(0, 5.0), (10, 7.0)]})
    members = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 2)], "cluster string, norad long")
    got = {(r.cluster, r.epoch.microsecond): r["mean"] for r in cluster_mean(join_members(frame, members), ["cluster"]).collect()}
    assert got == {("a", 0): 3.0, ("a", 10): 5.0, ("b", 0): 5.0, ("b", 10): 7.0}


def test_coverage(spark):
    frame = frame_of(spark, {1: [(0, 1.0), (10, None)], 2: [(5, 1.0), (20, 1.0)], 3: [(7, 1.0)]})
    got = {
        r.epoch.microsecond: r.n_covering for r in coverage_counts(frame.withColumn("g", F.lit(1)), ["g"]).collect()}
    assert got == {0: 1, 5: 2, 7: 2, 10: 2, 20: 1}


def test_interpolation(spark):
    frame = frame_of(spark, {1: [(0, 1.0), (10, 3.0), (20, None), (30, 5.0)], 2: [(5, 9.0)]})
    targets = frame_of(spark, {1: [(t, 0.0) for t in (-5, 0, 5, 10, 15, 20, 30, 35)], 2: [(5, 0.0)]}).drop("value")
    got = {(r.norad, round((r.epoch - START) / dt.timedelta(microseconds=1))): r.value for r in interpolate(frame, targets, ["norad"]).collect()}
    assert got == {(1, -5): None, (1, 0): 1.0, (1, 5): 2.0, (1, 10): 3.0, (1, 15): None, (1, 20): None, (1, 30): 5.0,
                   (1, 35): None, (2, 5): None}


@pytest.mark.parametrize("pooled", [False, True])
def test_clipping(spark, pooled):
    rng = np.random.default_rng(1)
    rows = [(n, i, p, float(v)) for n in (1, 2) for p in ("bstar", "raan", "inclination")
            for i, v in enumerate(rng.normal(size=300) * (10 if n == 1 else 1))] + [(1, 999, "bstar", float("nan")), (3, 0, "bstar", None)]
    frame = spark.createDataFrame(rows, "norad long, epoch long, param string, value double")
    got = {(r.norad, r.epoch, r.param): r.value for r in clip_series(frame, pooled, {"inclination": (-.5, .5)}).collect()}
    assert len(got) == len(rows) and got[(1, 999, "bstar")] is None and got[(3, 0, "bstar")] is None
    for n, i, p, v in rows[:-2]:
        pool = [x for m, _, q, x in rows[:-2] if q == "bstar" and (pooled or m == n)]
        lo, hi = {"inclination": (-.5, .5), "raan": (-1e9, 1e9), "bstar": tuple(np.percentile(pool, [1, 99]))}[p]
        assert math.isclose(got[(n, i, p)], min(max(v, lo), hi), abs_tol=1e-12)


def test_chart_plans(spark):
    rows = [(n, START + dt.timedelta(days=i), START + dt.timedelta(days=100 + r), float(n * i), .1 * r, 1e-5 * i)
            for n in (1, 2, 3) for i in range(10) for r in (0, 1)]
    history = spark.createDataFrame(rows, "norad long, epoch timestamp_ntz, creation_date timestamp_ntz, sma double, eccentricity double, bstar double")
    out = chart_series(history, ["sma", "eccentricity"], [1, 3], START + dt.timedelta(days=2), None, pooled=True)
    assert out.count() == 2 * 2 * 8 and {r.label for r in out.select("label").distinct().collect()} == {"Demi-grand axe [km]", "Excentricité [-]"}
    assert out.where("param = 'eccentricity' and value <> 0.1").count() == 0
    members = spark.createDataFrame([("c", 1), ("c", 2)], "cluster string, norad long")
    mean = cluster_series(history, members, ["sma", "bstar"]).where("param = 'sma'").orderBy("epoch").collect()
    assert [r["mean"] for r in mean] == pytest.approx([1.5 * i for i in range(10)]) and mean[0].n_members == 2


def test_small_clusters_come_together_once(spark):
    """All steps of the mean share one exchange of the rows, and a line is made once."""
    rows = spark.createDataFrame(
        [(c, n, dt.datetime(2026, 1, 1) + dt.timedelta(hours=7 * i + n), float(n + i * i % 5)) for c in (None, 1, 2) for n in (1, 2, 3) for i in range(6)],
        "cluster long, norad long, epoch timestamp_ntz, value double")
    out = cluster_mean(rows, ["cluster"])
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("hashpartitioning(") == 1
    assert plan.count("as decimal(30,22)) AS _b") == 1 and plan.count(" / cast((_after") == 1
    found = {(r.cluster, r.epoch): (r.mean, r.n_members) for r in out.collect()}
    spark.conf.set("driftline.rowsPerBlock", "10")  # clusters of 18 rows are long, their members of 6 are not
    try:
        cut = {(r.cluster, r.epoch): (r.mean, r.n_members) for r in cluster_mean(rows, ["cluster"]).collect()}
    finally:
        spark.conf.unset("driftline.rowsPerBlock")
    assert found.keys() == cut.keys() and len(found) > 30
    for key, (mean, n) in found.items():
        assert cut[key] == (pytest.approx(mean, rel=1e-12), n)
