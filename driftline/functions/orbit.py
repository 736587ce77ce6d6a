"""Orbit quantities and angle conversions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gravitational parameter (m^3/s^2), equatorial radius (km), pi to 15 digits.
GM = 398600441800000.0
EARTH_RADIUS_KM = 6378.137
PI = 3.14159265358979
# Second zonal harmonic and radius of the WGS-72 gravity model, for the secular drift.
J2 = 0.001082616
J2_RADIUS_KM = 6378.135


def semi_major_axis(mean_motion: Column) -> Column:
    """km, from revolutions per day."""
    rate = F.lit(2.0 * PI / 86400.0) * mean_motion
    return F.try_divide(F.lit(GM ** (1.0 / 3.0)), F.pow(rate, F.lit(2.0 / 3.0))) / F.lit(1000.0)


def apogee(sma: Column, eccentricity: Column) -> Column:
    """km above the equatorial radius."""
    return sma * (F.lit(1.0) + eccentricity) - F.lit(EARTH_RADIUS_KM)


def period(sma: Column) -> Column:
    """Seconds."""
    metres = sma * F.lit(1000.0)
    return F.lit(2.0 * PI) * F.sqrt(metres * metres * metres / F.lit(GM))


def velocity(sma: Column) -> Column:
    """Circular speed, m/s."""
    return F.sqrt(F.try_divide(F.lit(GM), sma * F.lit(1000.0)))


def wrap_degrees(x: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(x + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def wrap_radians(x: Column) -> Column:
    """To [-pi, pi)."""
    return F.pmod(x + F.lit(math.pi), F.lit(2.0 * math.pi)) - F.lit(math.pi)


def mod360(x: Column) -> Column:
    """Floored, so never negative."""
    return F.pmod(x, F.lit(360.0))


def rev_day_to_rad_min(mean_motion: Column) -> Column:
    return mean_motion * F.lit(2.0 * math.pi / 1440.0)


def mean_longitude(raan: Column, arg_perigee: Column, mean_anomaly: Column) -> Column:
    return mod360(raan + arg_perigee + mean_anomaly)


def to_equinoctial(
    eccentricity: Column, inclination: Column, raan: Column, arg_perigee: Column,
    mean_anomaly: Column, lamda_is_mean_anomaly: bool = False,
) -> dict[str, Column]:
    """Keplerian angles in degrees to continuous elements.

    By default the longitude is the mean longitude, which ``from_equinoctial`` inverts.
    ``lamda_is_mean_anomaly`` takes the mean anomaly alone, which it does not.
    """
    node = F.radians(raan)
    pericentre = node + F.radians(arg_perigee)
    half_tan = F.tan(F.radians(inclination) / F.lit(2.0))
    lamda = F.radians(mean_anomaly)
    if not lamda_is_mean_anomaly:
        lamda = lamda + pericentre
    return {
        "k": eccentricity * F.cos(pericentre),
        "h": eccentricity * F.sin(pericentre),
        "q": half_tan * F.cos(node),
        "p": half_tan * F.sin(node),
        "cos_lamda": F.cos(lamda),
        "sin_lamda": F.sin(lamda),
    }


def from_equinoctial(
    k: Column, h: Column, q: Column, p: Column, cos_lamda: Column, sin_lamda: Column,
) -> dict[str, Column]:
    pericentre = F.atan2(h, k)
    node = F.atan2(p, q)
    return {
        "eccentricity": F.hypot(h, k),
        "inclination": F.degrees(F.lit(2.0) * F.atan(F.hypot(q, p))),
        "raan": mod360(F.degrees(node)),
        "arg_perigee": mod360(F.degrees(pericentre - node)),
        "mean_anomaly": mod360(F.degrees(F.atan2(sin_lamda, cos_lamda) - pericentre)),
    }
