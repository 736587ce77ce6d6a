"""Rows paired with their predecessor, and the longitude residuals built on the pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions import orbit
from driftline.functions.timing import days, micros
from driftline.operators.blocks import Ordered, position, previous, series_start

_NEWTON_STEPS = 10


def with_steps(series: Ordered, carry: list[str] = ()) -> Ordered:
    """All rows but each series' first, paired with the row before.

    Adds ``k`` (0 for the second row), ``dt_days``, ``elapsed_days`` since the first row, and
    struct ``before`` with the previous row's ``carry`` columns.
    """
    placed = series.with_columns({"_us": micros(series.rows, series.order)}).extend(
        before=previous("_us", *carry), k=position(-1), _t0=series_start(F.col("_us")))
    paired = placed.where(F.col("k") >= 0).with_columns({
        "dt_days": days(F.col("_us") - F.col("before._us")),
        "elapsed_days": days(F.col("_us") - F.col("_t0"))})
    return paired.drop("_us", "_t0")


def keplerian_residual(series: Ordered) -> Ordered:
    """``keplerian_residual``: observed minus predicted mean longitude, degrees in [-180, 180)."""
    longitude = orbit.mean_longitude(F.col("raan"), F.col("arg_perigee"), F.col("mean_anomaly"))
    paired = with_steps(series.with_columns({"_longitude": longitude}), ["_longitude", "mean_motion"])
    return paired.with_columns({"keplerian_residual": _keplerian()}).drop("before", "_longitude")


def _keplerian() -> Column:
    predicted = orbit.mod360(
        F.col("before._longitude") + F.col("before.mean_motion") * F.lit(360.0) * F.col("dt_days"))
    return orbit.wrap_degrees(F.col("_longitude") - predicted)


_ELEMENTS = ["eccentricity", "inclination", "raan", "arg_perigee", "mean_anomaly", "mean_motion"]


def j2_residual(series: Ordered) -> Ordered:
    """``j2_residual``: right ascension minus that of the previous element set propagated here.

    Radians in [-pi, pi). The propagator is two-body motion with secular J2 drift of node and
    perigee, which is an analytic stand-in for a full perturbation model.
    """
    return _add_j2(with_steps(series, _ELEMENTS)).drop("before")


def both_residuals(series: Ordered, carry: list[str] = ()) -> Ordered:
    """The two residuals from one pairing."""
    longitude = orbit.mean_longitude(F.col("raan"), F.col("arg_perigee"), F.col("mean_anomaly"))
    paired = with_steps(series.with_columns({"_longitude": longitude}),
                        ["_longitude", *_ELEMENTS, *carry])
    return _add_j2(paired.with_columns({"keplerian_residual": _keplerian()})).drop("_longitude")


def _add_j2(paired: Ordered) -> Ordered:
    now = {c: F.col(c) for c in _ELEMENTS}
    then = {c: F.col(f"before.{c}") for c in _ELEMENTS}
    out = _right_ascension(paired, "_ra_now", now, F.lit(0.0))
    out = _right_ascension(out, "_ra_then", then, F.col("dt_days"))
    return out.with_columns(
        {"j2_residual": orbit.wrap_radians(F.col("_ra_now") - F.col("_ra_then"))}
    ).drop("_ra_now", "_ra_then")


def _right_ascension(series: Ordered, name: str, el: dict[str, Column], dt: Column) -> Ordered:
    """Inertial right ascension after ``dt`` days; NULL for an impossible orbit.

    Kepler's equation takes a fixed number of Newton steps. They fold inside one expression:
    unrolled, the generated method outgrows what the JVM compiles.
    """
    possible = (el["eccentricity"] >= 0) & (el["eccentricity"] < 1) & (el["mean_motion"] > 0)
    rate = F.when(possible, el["mean_motion"]) * F.lit(2.0 * math.pi)  # rad/day
    axis = orbit.semi_major_axis(F.when(possible, el["mean_motion"]))
    out = series.with_columns({
        "_e": F.when(possible, el["eccentricity"]),
        "_i": F.radians(el["inclination"]),
        "_n": rate,
        "_p": axis * (F.lit(1.0) - el["eccentricity"] * el["eccentricity"])})
    ratio = F.lit(orbit.J2_RADIUS_KM) / F.col("_p")
    out = out.with_columns({"_drift": F.col("_n") * F.lit(orbit.J2) * ratio * ratio,
                            "_cos_i": F.cos("_i")})
    out = out.with_columns({
        "_node": F.radians(el["raan"]) - F.lit(1.5) * F.col("_drift") * F.col("_cos_i") * dt,
        "_peri": F.radians(el["arg_perigee"])
        + F.lit(0.75) * F.col("_drift") * (F.lit(5.0) * F.col("_cos_i") * F.col("_cos_i") - F.lit(1.0)) * dt,
        "_m": F.radians(el["mean_anomaly"]) + F.col("_n") * dt})
    newton = F.aggregate(
        F.lit(list(range(_NEWTON_STEPS))), F.col("_m"),
        lambda near_, turn_: near_ - (near_ - F.col("_e") * F.sin(near_) - F.col("_m"))
        / (F.lit(1.0) - F.col("_e") * F.cos(near_)))
    out = out.with_columns({"_x": newton})
    true_anomaly = F.lit(2.0) * F.atan2(
        F.sqrt(F.lit(1.0) + F.col("_e")) * F.sin(F.col("_x") / F.lit(2.0)),
        F.sqrt(F.lit(1.0) - F.col("_e")) * F.cos(F.col("_x") / F.lit(2.0)))
    out = out.with_columns({"_u": F.col("_peri") + true_anomaly})
    ra = F.atan2(
        F.sin("_node") * F.cos("_u") + F.cos("_node") * F.sin("_u") * F.col("_cos_i"),
        F.cos("_node") * F.cos("_u") - F.sin("_node") * F.sin("_u") * F.col("_cos_i"))
    return out.with_columns({name: ra}).drop(
        "_e", "_i", "_n", "_p", "_drift", "_cos_i", "_node", "_peri", "_m", "_x", "_u")
