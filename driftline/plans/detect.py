"""Manoeuvre detection for all objects in one job."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.values import finite_or_null
from driftline.operators import kalman
from driftline.operators.blocks import BLOCK, Ordered, arrange
from driftline.operators.history import latest_revision, newest_in_order
from driftline.operators.lowess import smooth, smooth_maker
from driftline.operators.peaks import keep_distant, local_maxima, maxima, prominences, suppress_near, with_prominence
from driftline.operators.per_series import Maker, add_columns
from driftline.operators.robust import distance_of, threshold_of, with_thresholds
from driftline.operators.steps import both_residuals, j2_residual, keplerian_residual

KEPLERIAN_FRAC = 0.008
J2_FRAC = 0.005
_LONGITUDE = ["raan", "arg_perigee", "mean_anomaly", "mean_motion"]
_ORBIT = [*_LONGITUDE, "inclination", "eccentricity"]
_ELEMENTS = [*_ORBIT, "sma"]


def ordered_history(
    history: DataFrame | Ordered, columns: list[str] | None = None, entity: str = "norad",
    time: str = "epoch", revised: bool = True,
) -> Ordered:
    """Only the columns a detector reads, newest revisions, in time order per object.

    Series are measured on the table itself, before revisions are dropped, which reads two
    columns and saves a second run of the deduplication. Older revisions of a short series are dropped in the order that all later
    steps use, which needs no exchange of its own; those of a long one are dropped before the rows travel.
    ``revised`` False promises that epochs do not repeat. A row without an epoch has no place in the order and takes no part.
    """
    if isinstance(history, Ordered):
        return history
    read = ["creation_date", "rev_at_epoch", *(columns or _ELEMENTS)]
    history = history.where(F.col(time).isNotNull())
    held = history.select(entity, time, *[c for c in read if c in history.columns])
    series = arrange(held, [entity], time, measure=history.select(entity, time))
    if not revised:
        return series.drop("creation_date", "rev_at_epoch")
    ties = [c for c in held.columns if c not in (entity, time, "creation_date")]
    newest = series.map(lambda rows: newest_in_order(rows, entity, time, ties=ties), lambda rows: latest_revision(rows, entity, time, ties=ties))
    return newest.drop("creation_date", "rev_at_epoch")


def peak_maker(signal: str, flag: str, sigma: float, min_distance_days: float | None, min_prominence: float | None) -> Maker:
    """``<flag>_threshold`` and ``flag`` of one whole series: what ``find_peaks`` finds, in one call."""
    def make(k, dt, values):
        magnitude = np.abs(values)
        magnitude[~np.isfinite(magnitude)] = np.nan
        height = np.where(np.isnan(magnitude), 0.0, magnitude)
        level = threshold_of(magnitude, sigma)
        found = maxima(height) & (magnitude >= level)
        if min_distance_days is not None:
            found = keep_distant(k, magnitude, found, np.full(len(k), distance_of(k, dt, min_distance_days)))
        if min_prominence is not None and found.any():
            found &= prominences(height) >= min_prominence
        return np.full(len(k), level), found

    return Maker(("k", "dt_days", signal), {f"{flag}_threshold": "double", flag: "boolean"}, make)


def find_peaks(
    series: Ordered, signals: dict[str, str], sigma: float = 4.0,
    min_distance_days: float | None = 7.0, min_prominence: float | None = None,
) -> Ordered:
    """Flag the peaks of the absolute signals: signal column to flag column.

    Adds ``<flag>_threshold``. ``min_distance_days`` None leaves all peaks standing, and
    ``min_prominence``, if given, is asked of those that remain.
    """
    prefixes = {signal: f"{flag}_" for signal, flag in signals.items()}
    flags = list(signals.values())
    # Maxima first: their windows order the rows, which then serve the medians as they are.
    out = series.with_columns({
        f"_abs_{flag}": F.abs(finite_or_null(F.col(signal))) for signal, flag in signals.items()})
    out = local_maxima(out, {f"_abs_{flag}": f"{flag}_peak" for flag in flags})
    out = with_thresholds(out.drop(*[f"_abs_{f}" for f in flags]), prefixes, sigma, min_distance_days)
    out = out.with_columns({f"{f}_peak": F.coalesce(
        F.col(f"{f}_peak") & (F.col(f"{f}_magnitude") >= F.col(f"{f}_threshold")), F.lit(False))
        for f in flags})
    if min_distance_days is None:
        out = out.with_columns({f: F.col(f"{f}_peak") for f in flags})
    else:
        out = suppress_near(out, [(f"{f}_peak", f"{f}_magnitude", f) for f in flags], "distance")
    if min_prominence is not None:
        for flag in flags:
            out = with_prominence(out, f"{flag}_magnitude", "_prominence")
            enough = F.col("_prominence") >= F.lit(float(min_prominence))
            out = out.with_columns({flag: F.col(flag) & enough}).drop("_prominence")
    return out.drop("distance", *[f"{f}_{c}" for f in flags for c in ("magnitude", "peak")])


@dataclass(frozen=True)
class Method:
    """A residual, the column of its signal, the share that smooths it (None: not at all), and the column of its flag."""

    residual: str
    signal: str
    frac: float | None
    flag: str


def _detected(
    paired: Ordered, methods: list[Method], sigma: float, min_distance_days: float | None,
    min_prominence: float | None, kalman_filter: tuple[float, float, float] | None = None,
) -> Ordered:
    """The signals and flags of all methods and, if wanted, the Kalman filter of ``sma``.

    A short series takes one call: its smoothing, thresholds, maxima, suppression and filter are one pass through Arrow, on the
    exchange that paired its rows. Long series go block by block and step by step.
    """
    values = [*[m.residual for m in methods], *(["sma"] if kalman_filter else [])]
    if kalman_filter:
        paired = paired.with_columns({"_z_before": F.col("before.sma")})
        values.append("_z_before")
    paired = paired.map(lambda rows: rows.select(*paired.keys, paired.order, BLOCK, "k", "dt_days", "elapsed_days", *values))
    smoothed = {m.signal: (m.residual, m.frac) for m in methods if m.frac is not None}
    plain = {m.signal: F.col(m.residual) for m in methods if m.frac is None}

    def short(rows: DataFrame) -> DataFrame:
        makers = [smooth_maker(out, value, "elapsed_days", frac) for out, (value, frac) in smoothed.items()]
        makers += [peak_maker(m.signal, m.flag, sigma, min_distance_days, min_prominence) for m in methods]
        if kalman_filter:
            makers.append(kalman.filter_maker(*kalman_filter, "sma"))
        return add_columns(rows.withColumns(plain), list(paired.keys), paired.order, makers)

    def long(rows: DataFrame) -> DataFrame:
        series = replace(paired, short=None, long=rows)
        if kalman_filter:
            series = kalman.kalman_filter(series.with_columns({"before": F.struct(F.col("_z_before").alias("sma"))}), "sma", *kalman_filter)
        series = smooth(series.with_columns(plain), smoothed) if smoothed else series.with_columns(plain)
        return find_peaks(series, {m.signal: m.flag for m in methods}, sigma, min_distance_days, min_prominence).long

    outputs = [c for m in methods for c in (m.signal, f"{m.flag}_threshold", m.flag)] + (["innovation", "nis", "rate"] if kalman_filter else [])
    return paired.map(short, long).map(lambda rows: rows.select(*paired.keys, paired.order, BLOCK, "k", *outputs))


def detect_keplerian(
    history: DataFrame | Ordered, smoothed: bool = True, frac: float = KEPLERIAN_FRAC,
    sigma: float = 4.0, min_distance_days: float | None = 7.0, min_prominence: float | None = None,
) -> DataFrame:
    """``norad, epoch, k, method, signal, threshold, is_maneuver`` from mean-longitude residuals."""
    paired = keplerian_residual(ordered_history(history, _LONGITUDE))
    method = Method("keplerian_residual", "signal", frac if smoothed else None, "is_maneuver")
    return _detections(_detected(paired, [method], sigma, min_distance_days, min_prominence), "keplerian")


def detect_j2(
    history: DataFrame | Ordered, frac: float = J2_FRAC, sigma: float = 4.0,
    min_distance_days: float | None = 7.0, min_prominence: float | None = None,
) -> DataFrame:
    """The same from the residual of the J2 propagation, always smoothed."""
    paired = j2_residual(ordered_history(history, _ORBIT))
    method = Method("j2_residual", "signal", frac, "is_maneuver")
    return _detections(_detected(paired, [method], sigma, min_distance_days, min_prominence), "j2")


def detect_kalman(
    history: DataFrame | Ordered, noise: float = 0.13, r: float = 1.0, p0: float = 1000.0,
    alpha: float = 0.997,
) -> DataFrame:
    """``norad, epoch, k, method, signal`` (rate of the semi-major axis), ``nis, threshold, is_maneuver``."""
    out = kalman.detect_kalman(ordered_history(history, ["sma"]), "sma", noise, r, p0, alpha)
    keys = [*out.keys, out.order]
    return out.rows.select(
        *keys, "k", F.lit("kalman").alias("method"), F.col("rate").alias("signal"), "nis",
        F.col("nis_threshold").alias("threshold"), F.col("kalman_maneuver").alias("is_maneuver"))


def _detections(series: Ordered, method: str) -> DataFrame:
    return series.rows.select(
        *series.keys, series.order, "k", F.lit(method).alias("method"), "signal",
        F.col("is_maneuver_threshold").alias("threshold"), "is_maneuver")


def compare_methods(
    history: DataFrame | Ordered, sigma: float = 4.0, min_distance_days: float | None = 7.0,
    noise: float = 0.13, r: float = 1.0, p0: float = 1000.0, alpha: float = 0.997,
    keplerian_frac: float = KEPLERIAN_FRAC, j2_frac: float = J2_FRAC, min_prominence: float | None = None,
) -> DataFrame:
    """All three methods side by side, one row per object and epoch.

    The methods share their rows, so they are columns of one pass: neither a join nor a pivot
    is needed to align them.
    """
    paired = both_residuals(ordered_history(history), ["sma"])
    methods = [Method("keplerian_residual", "keplerian_signal", keplerian_frac, "keplerian_maneuver"),
               Method("j2_residual", "j2_signal", j2_frac, "j2_maneuver")]
    found = _detected(paired, methods, sigma, min_distance_days, min_prominence, (noise, r, p0))
    out = kalman.flag_innovations(found, alpha)
    return out.rows.select(
        *out.keys, out.order, "k",
        "keplerian_signal", F.col("keplerian_maneuver_threshold").alias("keplerian_threshold"),
        "keplerian_maneuver", "j2_signal", F.col("j2_maneuver_threshold").alias("j2_threshold"),
        "j2_maneuver", F.col("rate").alias("kalman_rate"), F.col("nis").alias("kalman_nis"),
        F.col("nis_threshold").alias("kalman_threshold"), "kalman_maneuver")


def align_methods(detections: DataFrame, methods: list[str], entity: str = "norad",
                  time: str = "epoch") -> DataFrame:
    """Separate detection tables, stacked with column ``method``, aligned on object and epoch."""
    return detections.groupBy(entity, time).pivot("method", methods).agg(
        F.max("is_maneuver"))


def detection_counts(detections: DataFrame, entity: str = "norad") -> DataFrame:
    flag: Column = F.col("is_maneuver")
    return detections.groupBy(entity, "method").agg(F.count_if(flag).alias("n_maneuvers"))
