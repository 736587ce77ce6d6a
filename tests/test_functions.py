import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from driftline.functions import orbit, timing, values
from driftline.operators.kalman import chi_square_threshold


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).head()


def test_orbit_quantities(spark):
    n = F.lit(1.0)
    r = one(spark, sma=orbit.semi_major_axis(n), period=orbit.period(orbit.semi_major_axis(n)),
            speed=orbit.velocity(orbit.semi_major_axis(n)), apogee=orbit.apogee(F.lit(7000.0), F.lit(0.1)),
            none=orbit.semi_major_axis(F.lit(0.0)))
    assert abs(r.period - 86400.0) < 1e-6 and abs(r.sma - 42241.1) < 0.1 and r.none is None
    assert abs(r.apogee - (7700 - 6378.137)) < 1e-9
    assert abs(r.speed * r.speed * r.sma * 1000 / orbit.GM - 1) < 1e-12


def test_equinoctial_round_trip(spark):
    frame = spark.createDataFrame(
        [(0.01, 20.0, 350.0, 200.0, 359.0), (0.7, 98.0, 1.0, 2.0, 3.0), (0.2, 0.5, 180.0, 181.0, 182.0)],
        "e double, i double, raan double, argp double, m double")
    names = ["e", "i", "raan", "argp", "m"]
    parts = orbit.from_equinoctial(*orbit.to_equinoctial(*[F.col(c) for c in names]).values())
    for row in frame.select(*names, *[c.alias(f"back_{n}") for n, c in parts.items()]).collect():
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(row[:5], row[5:], strict=True))
    plain = orbit.to_equinoctial(*[F.col(c) for c in names], lamda_is_mean_anomaly=True)
    assert abs(frame.select(plain["cos_lamda"]).head()[0] - math.cos(math.radians(359.0))) < 1e-12


@pytest.mark.parametrize("x,wrapped,mod", [(180.0, -180.0, 180.0), (-180.0, -180.0, 180.0), (-10.0, -10.0, 350.0),
                                           (725.0, 5.0, 5.0), (-350.0, 10.0, 10.0)])
def test_wraps(spark, x, wrapped, mod):
    r = one(spark, w=orbit.wrap_degrees(F.lit(x)), m=orbit.mod360(F.lit(x)))
    assert (r.w, r.m) == (wrapped, mod)


@pytest.mark.parametrize("zone", ["UTC", "Europe/Paris", "America/New_York"])
def test_micros_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 02:30 does not exist in Paris on that day.
        frame = spark.sql("select timestamp_ntz'2024-03-31 02:30:00.000001' as t")
        got = frame.select(timing.micros(frame, "t")).head()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == int((dt.datetime(2024, 3, 31, 2, 30) - dt.datetime(1970, 1, 1)).total_seconds()) * 10 ** 6 + 1


def test_julian_date(spark):
    r = one(spark, a=timing.julian_date(F.lit(0)), b=timing.days_since_1949(F.lit(0)))
    assert (r.a, r.b) == (2440587.5, 7306.0)


def test_values(spark):
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    r = one(spark, a=values.finite_or_null(nan), b=values.finite_or_null(-inf), c=values.finite_or_null(F.lit(2.0)),
            d=values.clip(F.lit(5.0), F.lit(0.0), F.lit(1.0)), e=values.clip(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0)),
            f=values.clip(F.lit(5.0), F.lit(None).cast("double"), F.lit(None).cast("double")),
            g=values.axis_label(F.lit("bstar")), h=values.axis_label(F.lit("apogee")), i=values.axis_label(F.lit("rev_at_epoch")),
            j=values.output_tag(F.lit(""), F.lit("US")), k=values.output_tag(F.lit("GSAT"), F.lit("")))
    assert tuple(r) == (None, None, 2.0, 1.0, None, 5.0, "B* [1/m]", "apogee", "Révolution à l'epoch", "ALL_US", "GSAT_ALL")


def test_chi_square_threshold():
    assert chi_square_threshold(0.997) == pytest.approx(8.807468393511876, abs=1e-12)
