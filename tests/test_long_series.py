"""Operators give the same results whether or not series are cut into blocks."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import kalman
from driftline.operators.blocks import arrange, position
from driftline.operators.catalog import chunked, first_n_per_rule
from driftline.operators.cluster import cluster_mean, coverage_counts, interpolate
from driftline.operators.history import grouped_pages
from driftline.operators.lowess import smooth
from driftline.operators.peaks import local_maxima, suppress_near, with_prominence
from driftline.operators.robust import robust_summary, with_thresholds
from driftline.operators.steps import both_residuals, with_steps
from driftline.plans.detect import compare_methods, detect_keplerian, ordered_history

WHOLE, CUT = 100_000, 9


@pytest.fixture(scope="module")
def elements(spark):
    rng = random.Random(11)
    rows = []
    for norad, n in ((1, 70), (2, 8), (3, 1), (4, 2), (5, 3), (6, 25)):
        at = dt.datetime(2026, 1, 1)
        for _ in range(n):
            at += dt.timedelta(hours=rng.uniform(2, 30))
            rows.append((norad, at, rng.uniform(0, 360), rng.uniform(0, 360), rng.uniform(0, 360),
                         1 + rng.uniform(0, .01), rng.uniform(0, 60), rng.uniform(0, .1), 42000 + rng.gauss(0, 3),
                         None if rng.random() < .1 else float(rng.randint(0, 9))))
    rng.shuffle(rows)
    frame = spark.createDataFrame(
        rows, "norad long, epoch timestamp_ntz, raan double, arg_perigee double, mean_anomaly double, mean_motion double, "
        "inclination double, eccentricity double, sma double, x double").repartition(5)
    frame.cache()
    return frame


def both(spark, run):
    """The result with one block per series and with many."""
    found = []
    for rows in (WHOLE, CUT):
        spark.conf.set("driftline.rowsPerBlock", str(rows))
        try:
            frame = run()
            columns = sorted(frame.columns)
            found.append(sorted((tuple(r) for r in frame.select(columns).collect()), key=repr))
        finally:
            spark.conf.unset("driftline.rowsPerBlock")
    return found


def close(a, b, tolerance=1e-9):
    assert len(a) == len(b) and len(a) > 0
    key = lambda row: repr([v for v in row if not isinstance(v, float)])
    for left, right in zip(sorted(a, key=key), sorted(b, key=key), strict=True):
        for u, v in zip(left, right, strict=True):
            if isinstance(u, float) and isinstance(v, float):
                assert math.isclose(u, v, rel_tol=tolerance, abs_tol=tolerance), (left, right)
            else:
                assert u == v, (left, right)


def test_steps_and_residuals(spark, elements):
    close(*both(spark, lambda: both_residuals(ordered_history(elements)).drop("before").result()))


def test_threshold_and_distance(spark, elements):
    def run():
        s = with_steps(ordered_history(elements))
        return with_thresholds(s, {"sma": "a_", "mean_motion": "b_"}, 1.0, 3.0).drop("before").result()
    close(*both(spark, run))


def test_summary(spark, elements):
    close(*both(spark, lambda: robust_summary(peaky(elements), "x", 2.0)))


def test_kalman(spark, elements):
    close(*both(spark, lambda: kalman.detect_kalman(ordered_history(elements)).result()), 1e-7)


def test_lowess(spark, elements):
    def run():
        s = with_steps(arrange(elements.select("norad", "epoch", "x", "sma"), ["norad"], "epoch"))
        return smooth(s.drop("before"), {"a": ("x", .3), "b": ("sma", .05)}).result()
    close(*both(spark, run))


def peaky(elements):
    return arrange(elements.select("norad", "epoch", "x"), ["norad"], "epoch").extend(k=position())


def test_maxima_suppression_prominence(spark, elements):
    def run():
        s = local_maxima(peaky(elements), {"x": "is_peak"}).with_columns({"gap": F.lit(4).cast("bigint")})
        return with_prominence(suppress_near(s, [("is_peak", "x", "kept")], "gap"), "x").result()
    close(*both(spark, run))


def test_suppression_of_a_long_rising_chain(spark):
    frame = spark.range(60).select(F.lit(1).alias("norad"), F.col("id").alias("epoch"), F.col("id").alias("k"),
                                   F.col("id").cast("double").alias("x"), F.lit(True).alias("peak"),
                                   F.lit(3).cast("bigint").alias("gap"))
    plain, cut = both(spark, lambda: suppress_near(
        arrange(frame, ["norad"], "epoch"), [("peak", "x", "kept")], "gap").rows.where("kept").select("k"))
    assert plain == cut == sorted([(k,) for k in range(59, -1, -3)], key=repr)


def test_cluster(spark, elements):
    series = elements.select("norad", "epoch", F.col("x").alias("value"), (F.col("norad") % 2).alias("c"))
    close(*both(spark, lambda: cluster_mean(series, ["c"])))
    close(*both(spark, lambda: cluster_mean(series, [])))
    close(*both(spark, lambda: coverage_counts(series, ["c"])))
    close(*both(spark, lambda: interpolate(
        series, series.select((F.col("norad") % 6 + 1).alias("norad"), "epoch"), ["norad"])))


def test_pages_batches_and_rule_limits(spark, elements):
    close(*both(spark, lambda: grouped_pages(elements, ["sma"], 6)))
    ids = spark.range(100).select((F.col("id") * 3).alias("norad_cat_id"))
    close(*both(spark, lambda: chunked(ids, 7)))
    matches = spark.range(3000).select(F.lit("ALL_ALL").alias("rule"), F.col("id").alias("norad_cat_id"))
    spark.conf.set("driftline.rowsPerBlock", "400")
    try:
        assert first_n_per_rule(matches, 1500).agg(F.max("norad_cat_id"), F.count("*")).head()[:] == (1499, 1500)
    finally:
        spark.conf.unset("driftline.rowsPerBlock")


def test_detectors(spark, elements):
    close(*both(spark, lambda: compare_methods(elements, 1.0, 2.0, keplerian_frac=.3, j2_frac=.3)), 1e-7)
    close(*both(spark, lambda: detect_keplerian(elements, smoothed=False, sigma=0.5, min_distance_days=2.0, min_prominence=20.0)))
