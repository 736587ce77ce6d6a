"""Operators along each series in time order, and the detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapters import P, REVISED_SQL, history, revised, table
from checks.registry import query, rounded, rsql
from checks.sqlparts import (
    distance_cte, j2_cte, kalman_ctes, lowess_ctes, maxima_ctes, residual_cte, suppressed_ctes, threshold_ctes)
from driftline.operators import kalman
from driftline.operators.blocks import arrange, position
from driftline.operators.lowess import smooth
from driftline.operators.peaks import local_maxima, suppress_near, with_prominence
from driftline.operators.robust import with_thresholds
from driftline.operators.steps import j2_residual, keplerian_residual, with_steps
from driftline.plans import detect

# Test settings: the default share and threshold find nothing in the given tables.
FRAC, SIGMA, DAYS = 0.2, 1.0, 2.0


def _ordered(spark, sf):
    return detect.ordered_history(history(spark, sf), revised=False)


def _events(spark, sf):
    """Event values as a signal along each user, with ``k`` from 0."""
    rows = table(spark, sf, "events").selectExpr("user_id as norad", "ts as epoch", "cast(floor(value / 8) as double) as x")
    return arrange(rows, ["norad"], "epoch").extend(k=position())


_SIGNAL = """s as (select user_id as norad, ts as epoch, row_number() over (partition by user_id order by ts) - 1 as k,
  cast(floor(value / 8) as double) as x from events)"""


@query("j4_previous_row", f"with {P} select norad, epoch, {rsql('lon0')} as previous_longitude, {rsql('n0')} as previous_motion from p")
def j4(spark, sf):
    series = _ordered(spark, sf)
    series = series.with_columns({"lon": F.pmod(F.col("raan") + F.col("arg_perigee") + F.col("mean_anomaly"), F.lit(360.0))})
    return with_steps(series, ["lon", "mean_motion"]).rows.select(
        "norad", "epoch", rounded("before.lon").alias("previous_longitude"),
        rounded("before.mean_motion").alias("previous_motion"))


@query("w2_w3_steps", f"""with {P} select norad, epoch, {rsql('dt_days')} as dt_days, {rsql('elapsed_days')} as elapsed_days from p""")
def w2(spark, sf):
    return with_steps(_ordered(spark, sf)).rows.select(
        "norad", "epoch", rounded("dt_days").alias("dt_days"), rounded("elapsed_days").alias("elapsed_days"))


@query("w4_keplerian_residual", f"with {P}, {residual_cte()} select norad, epoch, {rsql('keplerian_residual')} as residual from kr")
def w4(spark, sf):
    return keplerian_residual(_ordered(spark, sf)).rows.select(
        "norad", "epoch", rounded("keplerian_residual").alias("residual"))


@query("w5_j2_residual", f"with {P}, {j2_cte()} select norad, epoch, {rsql('j2_residual')} as j2_residual from jr")
def w5(spark, sf):
    return j2_residual(_ordered(spark, sf)).rows.select("norad", "epoch", rounded("j2_residual").alias("j2_residual"))


_LOWESS = lowess_ctes("kr", "keplerian_residual", FRAC, "lw")


@query("w6_lowess", f"with {P}, {residual_cte()}, {_LOWESS} select norad, k, {rsql('fit')} as smoothed from lw")
def w6(spark, sf):
    out = smooth(keplerian_residual(_ordered(spark, sf)), {"smoothed": ("keplerian_residual", FRAC)})
    return out.rows.select("norad", "k", rounded("smoothed").alias("smoothed"))


@query("w6_lowess_default_share", f"""with {P}, {residual_cte()}, {lowess_ctes('kr', 'keplerian_residual', 0.008, 'lw')}
select norad, k, {rsql('fit')} as smoothed from lw""")
def w6_default(spark, sf):
    out = smooth(keplerian_residual(_ordered(spark, sf)), {"smoothed": ("keplerian_residual", 0.008)})
    return out.rows.select("norad", "k", rounded("smoothed").alias("smoothed"))


@query("w7_flagged_residual", f"""with {P}, {residual_cte()}, {threshold_ctes('kr', 'keplerian_residual', SIGMA)}
select norad, epoch, k, {rsql('keplerian_residual')} as signal, {rsql('threshold')} as threshold,
abs(keplerian_residual) >= threshold as is_maneuver from kr join th using (norad)""")
def w7(spark, sf):
    out = with_thresholds(keplerian_residual(_ordered(spark, sf)), {"keplerian_residual": ""}, SIGMA)
    return out.rows.select("norad", "epoch", "k", rounded("keplerian_residual").alias("signal"),
                           rounded("threshold").alias("threshold"),
                           (F.col("magnitude") >= F.col("threshold")).alias("is_maneuver"))


@query("w8_local_maxima", f"with {_SIGNAL}, {maxima_ctes('s', 'x')} select norad, k, x as height from pk")
def w8(spark, sf):
    out = local_maxima(_events(spark, sf), {"x": "is_peak"}).where(F.col("is_peak"))
    return out.rows.select("norad", "k", F.col("x").alias("height"))


@query("w9_distance_suppression", f"""with recursive {_SIGNAL}, {maxima_ctes('s', 'x')},
d as (select norad, k, x, 5 as distance from pk), {suppressed_ctes('d')} select norad, k from kp""")
def w9(spark, sf):
    out = local_maxima(_events(spark, sf), {"x": "is_peak"}).with_columns({"distance": F.lit(5).cast("bigint")})
    out = suppress_near(out, [("is_peak", "x", "kept")], "distance")
    return out.rows.where(F.col("kept")).select("norad", "k")


@query("w10_prominence", f"""with {_SIGNAL}, {maxima_ctes('s', 'x')},
e as (select pk.norad, pk.k, pk.x, (select max(k) from s where s.norad = pk.norad and s.k < pk.k and s.x > pk.x) as kl,
  (select min(k) from s where s.norad = pk.norad and s.k > pk.k and s.x > pk.x) as kr from pk)
select e.norad, e.k, e.x - greatest(min(s.x) filter (s.k <= e.k), min(s.x) filter (s.k >= e.k)) as prominence
from e join s on s.norad = e.norad and s.k > coalesce(kl, -1) and (kr is null or s.k < kr) group by e.norad, e.k, e.x""")
def w10(spark, sf):
    out = with_prominence(local_maxima(_events(spark, sf), {"x": "is_peak"}), "x")
    return out.rows.where(F.col("is_peak")).select("norad", "k", "prominence")


@query("w11_kalman_filter", f"""with recursive {P}, {kalman_ctes('sma', 'sma0')}
select norad, k, {rsql('y', 4)} as innovation, {rsql('nis', 2)} as nis, {rsql('rate', 4)} as rate from kf""")
def w11(spark, sf):
    out = kalman.detect_kalman(_ordered(spark, sf))
    return out.rows.select("norad", "k", rounded("innovation", 4).alias("innovation"),
                           rounded("nis", 2).alias("nis"), rounded("rate", 4).alias("rate"))


@query("w12_chi_square", f"""with recursive {P}, {kalman_ctes('sma', 'sma0')}
select norad, epoch, k, nis > 8.807468393511876 as is_maneuver from kf join p using (norad, k)""")
def w12(spark, sf):
    return detect.detect_kalman(_ordered(spark, sf)).select("norad", "epoch", "k", "is_maneuver")


_REVISED_KALMAN = f"""n as (select norad, epoch, sma, epoch_us(epoch) as us from (select *, row_number() over (partition by norad, epoch
  order by creation_seq desc, tiebreak desc, sma desc, eccentricity desc) as rk from {REVISED_SQL}) where rk = 1),
p as (select * from (select norad, epoch, sma, row_number() over w - 2 as k, (us - lag(us) over w) / 86400e6 as dt_days,
  lag(sma) over w as sma0 from n window w as (partition by norad order by epoch)) where k >= 0)"""


@query("detect_kalman_revised_history", f"""with recursive {_REVISED_KALMAN}, {kalman_ctes('sma', 'sma0')}
select norad, epoch, k, {rsql('log10(nis + 1)', 4)} as nis_log, nis > 8.807468393511876 as is_maneuver from kf join p using (norad, k)""")
def detect_kalman_revised(spark, sf):
    rows = revised(spark, sf).withColumnsRenamed({"creation_seq": "creation_date", "tiebreak": "rev_at_epoch"})
    out = detect.detect_kalman(rows)
    # A first difference of prices over whole days lies on rounding edges; the score does not.
    return out.select("norad", "epoch", "k", rounded(F.log10(F.col("nis") + 1), 4).alias("nis_log"), "is_maneuver")


@query("w14_sample_index", f"with {P} select norad, epoch, k from p")
def w14(spark, sf):
    return with_steps(_ordered(spark, sf)).rows.select("norad", "epoch", "k")


@query("s15_magnitude", f"with {P}, {residual_cte()} select norad, epoch, {rsql('abs(keplerian_residual)')} as magnitude from kr")
def s15(spark, sf):
    return keplerian_residual(_ordered(spark, sf)).rows.select(
        "norad", "epoch", rounded(F.abs("keplerian_residual")).alias("magnitude"))


def _detected(signal_ctes: str, source: str, signal: str, sigma: float, days: float | None, tag: str) -> str:
    """CTEs ending in {tag}_kept(norad, k), and {tag}_th with the thresholds."""
    peaks = f"""{tag}_x as (select norad, k, abs({signal}) as x from {source}), {maxima_ctes(f'{tag}_x', 'x', f'{tag}_pk')},
{tag}_hi as (select pk.norad, pk.k, pk.x, distance from {tag}_pk pk join {tag}_th th using (norad) left join ds using (norad)
  where x >= threshold)"""
    kept = f"{tag}_kept as (select norad, k from {tag}_hi)" if days is None else suppressed_ctes(f"{tag}_hi", f"{tag}_kept")
    return f"{signal_ctes} {threshold_ctes(source, signal, sigma, f'{tag}_th')}, {peaks}, {kept}"


_KEPLER_RAW = _detected(f"{residual_cte()}, {distance_cte(DAYS)},", "kr", "keplerian_residual", SIGMA, DAYS, "a")


@query("detect_keplerian_unsmoothed", f"""with recursive {P}, {_KEPLER_RAW}
select kr.norad, kr.epoch, kr.k, 'keplerian' as method, {rsql('keplerian_residual')} as signal, {rsql('threshold')} as threshold,
a_kept.k is not null as is_maneuver from kr left join a_th using (norad) left join a_kept on a_kept.norad = kr.norad and a_kept.k = kr.k""")
def detect_raw(spark, sf):
    out = detect.detect_keplerian(history(spark, sf), smoothed=False, sigma=SIGMA, min_distance_days=DAYS)
    return out.withColumns({"signal": rounded("signal"), "threshold": rounded("threshold")})


_KEPLER = _detected(f"{residual_cte()}, {_LOWESS}, {distance_cte(DAYS)},", "lw", "fit", SIGMA, DAYS, "a")
_J2 = _detected(f"{j2_cte()}, {lowess_ctes('jr', 'j2_residual', FRAC, 'lj')},", "lj", "fit", SIGMA, DAYS, "b")


@query("detect_keplerian", f"""with recursive {P}, {_KEPLER}
select p.norad, p.epoch, p.k, 'keplerian' as method, {rsql('fit')} as signal, {rsql('threshold')} as threshold,
a_kept.k is not null as is_maneuver from p join lw on lw.norad = p.norad and lw.k = p.k left join a_th on a_th.norad = p.norad
left join a_kept on a_kept.norad = p.norad and a_kept.k = p.k""")
def detect_smoothed(spark, sf):
    out = detect.detect_keplerian(history(spark, sf), frac=FRAC, sigma=SIGMA, min_distance_days=DAYS)
    return out.withColumns({"signal": rounded("signal"), "threshold": rounded("threshold")})


@query("detect_keplerian_every_peak", f"""with recursive {P},
{_detected(f"{residual_cte()}, {distance_cte(DAYS)},", "kr", "keplerian_residual", SIGMA, None, "a")}
select norad, k from a_kept""")
def detect_every(spark, sf):
    out = detect.detect_keplerian(history(spark, sf), smoothed=False, sigma=SIGMA, min_distance_days=None)
    return out.where(F.col("is_maneuver")).select("norad", "k")


@query("detect_j2", f"""with recursive {P}, {distance_cte(DAYS)}, {_J2}
select p.norad, p.epoch, p.k, 'j2' as method, {rsql('fit')} as signal, {rsql('threshold')} as threshold,
b_kept.k is not null as is_maneuver from p join lj on lj.norad = p.norad and lj.k = p.k left join b_th on b_th.norad = p.norad
left join b_kept on b_kept.norad = p.norad and b_kept.k = p.k""")
def detect_j2(spark, sf):
    out = detect.detect_j2(history(spark, sf), frac=FRAC, sigma=SIGMA, min_distance_days=DAYS)
    return out.withColumns({"signal": rounded("signal"), "threshold": rounded("threshold")})


@query("j3_compare_methods", f"""with recursive {P}, {_KEPLER}, {_J2}, {kalman_ctes('sma', 'sma0')}
select p.norad, p.epoch, p.k, {rsql('lw.fit')} as keplerian_signal, {rsql('a_th.threshold')} as keplerian_threshold,
a_kept.k is not null as keplerian_maneuver, {rsql('lj.fit')} as j2_signal, {rsql('b_th.threshold')} as j2_threshold, b_kept.k is not null as j2_maneuver,
{rsql('kf.rate', 4)} as kalman_rate, {rsql('nis', 2)} as kalman_nis, {rsql('8.807468393511876')} as kalman_threshold, nis > 8.807468393511876 as kalman_maneuver
from p left join a_th on a_th.norad = p.norad left join b_th on b_th.norad = p.norad join lw on lw.norad = p.norad and lw.k = p.k join lj on lj.norad = p.norad and lj.k = p.k
join kf on kf.norad = p.norad and kf.k = p.k left join a_kept on a_kept.norad = p.norad and a_kept.k = p.k
left join b_kept on b_kept.norad = p.norad and b_kept.k = p.k""")
def compare(spark, sf):
    out = detect.compare_methods(history(spark, sf), SIGMA, DAYS, keplerian_frac=FRAC, j2_frac=FRAC)
    digits = {"keplerian_signal": 6, "keplerian_threshold": 6, "j2_signal": 6, "j2_threshold": 6, "kalman_rate": 4, "kalman_nis": 2, "kalman_threshold": 6}
    return out.withColumns({c: rounded(c, n) for c, n in digits.items()})


@query("j3_aligned_methods", f"""with recursive {P}, {_KEPLER_RAW}, {kalman_ctes('sma', 'sma0')}
select p.norad, p.epoch, a_kept.k is not null as keplerian, nis > 8.807468393511876 as kalman
from p join kf on kf.norad = p.norad and kf.k = p.k left join a_kept on a_kept.norad = p.norad and a_kept.k = p.k""")
def aligned(spark, sf):
    series = _ordered(spark, sf)
    kep = detect.detect_keplerian(series, smoothed=False, sigma=SIGMA, min_distance_days=DAYS)
    both = kep.select("norad", "epoch", "method", "is_maneuver").unionByName(
        detect.detect_kalman(series).select("norad", "epoch", "method", "is_maneuver"))
    return detect.align_methods(both, ["keplerian", "kalman"])
