"""Column functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from checks.adapters import H, floor_mod, history, rad, table, wrap_sql
from checks.registry import query, rounded, rsql
from driftline.functions import orbit, timing, values
from driftline.operators.history import unpivot, with_labels

_GM, _PI = "398600441800000e0", "3.14159265358979e0"


@query("s1_s4_orbit_quantities", f"""with {H} select norad, epoch, {rsql('sma')} as sma,
{rsql('sma * (1e0 + eccentricity) - 6378.137e0')} as apogee, {rsql(f'2e0 * {_PI} * sqrt(pow(sma * 1e3, 3) / {_GM})')} as period,
{rsql(f'sqrt({_GM} / (sma * 1e3))')} as velocity from h""")
def s1(spark, sf):
    h = history(spark, sf)
    return h.select("norad", "epoch", *[rounded(c).alias(c) for c in ("sma", "apogee", "period", "velocity")])


_PERI = rad("raan + arg_perigee")
_LAMDA = f"({rad('mean_anomaly')} + {_PERI})"
_EQUINOCTIAL = {
    "k": f"eccentricity * cos({_PERI})", "h": f"eccentricity * sin({_PERI})",
    "q": f"tan({rad('inclination')} / 2) * cos({rad('raan')})", "p": f"tan({rad('inclination')} / 2) * sin({rad('raan')})"}


def _elements():
    return [F.col(c) for c in ("eccentricity", "inclination", "raan", "arg_perigee", "mean_anomaly")]


@query("s5_to_equinoctial", f"""with {H} select norad, epoch, {', '.join(f'{rsql(e)} as {n}' for n, e in _EQUINOCTIAL.items())},
{rsql(f'cos({_LAMDA})')} as cos_lamda, {rsql(f'sin({_LAMDA})')} as sin_lamda from h""")
def s5(spark, sf):
    parts = orbit.to_equinoctial(*_elements())
    return history(spark, sf).select("norad", "epoch", *[rounded(e).alias(n) for n, e in parts.items()])


@query("s5_to_equinoctial_mean_anomaly", f"""with {H} select norad, epoch, {', '.join(f'{rsql(e)} as {n}' for n, e in _EQUINOCTIAL.items())},
{rsql(f"cos({rad('mean_anomaly')})")} as cos_lamda, {rsql(f"sin({rad('mean_anomaly')})")} as sin_lamda from h""")
def s5_plain(spark, sf):
    parts = orbit.to_equinoctial(*_elements(), lamda_is_mean_anomaly=True)
    return history(spark, sf).select("norad", "epoch", *[rounded(e).alias(n) for n, e in parts.items()])


def _turn(x: str) -> str:
    return floor_mod(f"degrees({x})")


@query("s6_from_equinoctial", f"""with {H}, e as (select norad, epoch, {', '.join(f'{e} as {n}' for n, e in _EQUINOCTIAL.items())},
cos({_LAMDA}) as c, sin({_LAMDA}) as s from h), o as (select norad, epoch, sqrt(h * h + k * k) as eccentricity,
degrees(2 * atan(sqrt(q * q + p * p))) as inclination, {_turn('atan2(p, q)')} as raan, {_turn('atan2(h, k) - atan2(p, q)')} as arg_perigee,
{_turn('atan2(s, c) - atan2(h, k)')} as mean_anomaly from (select norad, epoch, c, s, k + 0e0 as k, h + 0e0 as h, p + 0e0 as p, q + 0e0 as q from e))
select norad, epoch, {rsql('eccentricity')} as eccentricity, {rsql('inclination')} as inclination,
{', '.join(f"{floor_mod(rsql(c))} as {c}" for c in ('raan', 'arg_perigee', 'mean_anomaly'))} from o""")
def s6(spark, sf):
    parts = orbit.from_equinoctial(*orbit.to_equinoctial(*_elements()).values())
    out = history(spark, sf).select("norad", "epoch", *[rounded(e).alias(n) for n, e in parts.items()])
    # An angle just below 360 may round to 360, which is 0.
    return out.withColumns({c: orbit.mod360(F.col(c)) for c in ("raan", "arg_perigee", "mean_anomaly")})


_WIDE = "(event_id % 1441) - 720e0"


@query("s7_s8_wrap_and_mod", f"""select event_id, {rsql(wrap_sql(_WIDE))} as wrapped,
{rsql(f"case when w >= {math.pi - 1e-9!r}e0 then -{math.pi!r}e0 else w end", 9)} as wrapped_rad, {rsql(floor_mod(_WIDE))} as modulo
from (select event_id, {wrap_sql(rad(_WIDE), repr(math.pi) + 'e0')} as w from events)""")
def s7(spark, sf):
    # An odd half turn in radians may round to either end of the range: within 1e-9 of pi it is -pi on both sides.
    x = F.expr(_WIDE)
    rows = table(spark, sf, "events")
    radians = orbit.wrap_radians(F.radians(x))
    radians = F.when(radians >= math.pi - 1e-9, -math.pi).otherwise(radians)
    return rows.select("event_id", rounded(orbit.wrap_degrees(x)).alias("wrapped"),
                       rounded(radians, 9).alias("wrapped_rad"),
                       rounded(orbit.mod360(x)).alias("modulo"))


@query("s7_half_turns", f"select event_id, {rsql(wrap_sql('180e0 + 360e0 * (event_id % 5 - 2)'))} as wrapped from events")
def s7_half(spark, sf):
    x = F.expr("180e0 + 360e0 * (event_id % 5 - 2)")
    return table(spark, sf, "events").select("event_id", rounded(orbit.wrap_degrees(x)).alias("wrapped"))


@query("s10_labels", f"""with {H}, s as (select norad, epoch, unnest(['sma', 'bstar', 'rev_at_epoch', 'apogee']) as param from h)
select norad, epoch, param, case param when 'sma' then 'Demi-grand axe [km]' when 'bstar' then 'B* [1/m]'
when 'rev_at_epoch' then 'Révolution à l''epoch' else param end as label from s""")
def s10(spark, sf):
    long = unpivot(history(spark, sf), ["sma", "bstar", "rev_at_epoch", "apogee"])
    return with_labels(long).select("norad", "epoch", "param", "label")


@query("s12_missing_values", """select user_id, count(*) as n, count(*) filter (event_id % 3 <> 0 and event_id % 5 <> 0) as n_known
from events group by user_id""")
def s12(spark, sf):
    odd = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(
        F.col("event_id") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    rows = values.clean_doubles(table(spark, sf, "events").withColumn("value", odd))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_known"))


@query("s13_julian_date", f"""select event_id, {rsql('epoch_us(ts) / 86400e6 + 2440587.5e0', 4)} as julian,
{rsql('epoch_us(ts) / 86400e6 + 2440587.5e0 - 2433281.5e0')} as days_since_1949 from events""")
def s13(spark, sf):
    rows = table(spark, sf, "events")
    us = timing.micros(rows, "ts")
    return rows.select("event_id", rounded(timing.julian_date(us), 4).alias("julian"),
                       rounded(timing.days_since_1949(us)).alias("days_since_1949"))


@query("s14_units", f"""with {H} select norad, epoch, {rsql(rad('inclination'), 9)} as inclination_rad,
{rsql('mean_motion * 2 * pi() / 1440', 9)} as rad_per_min from h""")
def s14(spark, sf):
    return history(spark, sf).select(
        "norad", "epoch", rounded(F.radians("inclination"), 9).alias("inclination_rad"),
        rounded(orbit.rev_day_to_rad_min(F.col("mean_motion")), 9).alias("rad_per_min"))


@query("s16_text_building", f"""with {H} select object_name, concat(object_name, '%') as prefix_pattern, count(*) as n from h group by object_name""")
def s16(spark, sf):
    return history(spark, sf).groupBy("object_name").agg(F.count(F.lit(1)).alias("n")).select(
        "object_name", F.concat("object_name", F.lit("%")).alias("prefix_pattern"), "n")
