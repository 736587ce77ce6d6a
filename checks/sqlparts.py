"""Longer SQL statements of the operators' definitions."""

from __future__ import annotations

import math

from checks.adapters import H, KEPLERIAN, P, rad, wrap_sql


def threshold_ctes(source: str, signal: str, sigma: float, out: str = "th") -> str:
    """Per norad: n, median, mad, scale, threshold of abs(signal)."""
    return f"""{out}_x as (select norad, abs({signal}) as x from {source} where {signal} is not null),
{out}_m as (select norad, count(*) as n, median(x) as med, stddev_pop(x) as sd from {out}_x group by norad),
{out}_d as (select norad, median(abs(x - med)) as mad from {out}_x join {out}_m using (norad) group by norad),
{out} as (select norad, n, med, mad, case when mad > 0 then 1.4826 * mad else sd end as scale,
  case when n >= 3 then med + {sigma} * (case when mad > 0 then 1.4826 * mad else sd end) end as threshold
  from {out}_m join {out}_d using (norad))"""


def distance_cte(days: float, out: str = "ds") -> str:
    return f"""{out} as (select norad, case when median(dt_days) > 0 then greatest(1, cast(round_even({days}e0 / median(dt_days), 0) as bigint)) end as distance
  from p where k >= 1 group by norad)"""


def maxima_ctes(source: str, height: str, out: str = "pk") -> str:
    """Strict local maxima with flat tops, as rows (norad, k, x)."""
    return f"""{out}_s as (select norad, k, coalesce({height}, 0e0) as x,
  case when lag(coalesce({height}, 0e0)) over w = coalesce({height}, 0e0) then 0 else 1 end as fresh
  from {source} window w as (partition by norad order by k)),
{out}_g as (select *, sum(fresh) over (partition by norad order by k) as run from {out}_s),
{out}_r as (select norad, run, min(k) as k0, max(k) as k1, max(x) as x from {out}_g group by norad, run),
{out} as (select norad, (k0 + k1) // 2 as k, x from (select *, lag(x) over w as xl, lead(x) over w as xr
  from {out}_r window w as (partition by norad order by run)) where x > xl and x > xr)"""


def suppressed_ctes(peaks: str, out: str = "kp") -> str:
    """Greedy distance suppression over ``peaks`` (norad, k, x, distance); use WITH RECURSIVE."""
    return f"""{out}_o as (select norad, k, coalesce(distance, 1) as distance,
  row_number() over (partition by norad order by x desc, k desc) as r from {peaks}),
{out}_w(norad, r, kept) as (select norad, cast(0 as bigint), cast([] as bigint[]) from (select distinct norad from {out}_o)
  union all select w.norad, o.r, case when len(list_filter(w.kept, lambda z: abs(z - o.k) < o.distance)) = 0
    then list_append(w.kept, o.k) else w.kept end
  from {out}_w w join {out}_o o on o.norad = w.norad and o.r = w.r + 1),
{out} as (select norad, unnest(kept) as k from (select norad, arg_max(kept, r) as kept from {out}_w group by norad))"""


def lowess_ctes(source: str, value: str, frac: float, out: str, passes: int = 3) -> str:
    """Smoothed ``value`` of ``source`` (norad, k, elapsed_days) as rows (norad, k, fit)."""
    parts = [f"""{out}_b as materialized (select norad, k, elapsed_days as t, {value} as y,
  least(count(*) over (partition by norad), greatest(2, cast(floor({frac} * count(*) over (partition by norad) + 1e-10) as bigint))) as kk
  from {source} where {value} is not null)""",
             f"""{out}_n as materialized (select norad, k, j, y, case when h > 0 then d / h else 0e0 end as u from (
  select *, max(abs(d)) over (partition by norad, k) as h from (
    select a.norad, a.k, b.k as j, b.t - a.t as d, b.y, a.kk,
      row_number() over (partition by a.norad, a.k order by abs(b.t - a.t), b.k) as rk
    from {out}_b a join {out}_b b on a.norad = b.norad) where rk <= kk))"""]
    for i in range(passes + 1):
        weight = "pow(1 - pow(least(abs(u), 1), 3), 3)"
        source_i = f"{out}_n"
        if i:
            weight += " * rw"
            source_i = f"{out}_n join (select norad, k as j, rw from {out}_w{i}) using (norad, j)"
        parts.append(f"""{out}_s{i} as materialized (select norad, k, sum(w) as sw, sum(w * u) as su, sum(w * u * u) as suu,
  sum(w * y) as sy, sum(w * u * y) as suy from (select norad, k, u, y, {weight} as w from {source_i}) group by norad, k)""")
        parts.append(f"""{out}_f{i} as materialized (select b.norad, b.k, b.y, case when not sw > 0 then b.y
  when suu / sw - (su / sw) * (su / sw) > 1e-12 then sy / sw - (suy / sw - (su / sw) * (sy / sw))
    / (suu / sw - (su / sw) * (su / sw)) * (su / sw) else sy / sw end as fit
  from {out}_b b join {out}_s{i} s on b.norad = s.norad and b.k = s.k)""")
        if i < passes:
            parts.append(f"""{out}_w{i + 1} as materialized (select norad, k, case when not s > 0 then 1e0
  when r < 6 * s then pow(1 - pow(r / (6 * s), 2), 2) else 0e0 end as rw
  from (select norad, k, abs(y - fit) as r, median(abs(y - fit)) over (partition by norad) as s from {out}_f{i}))""")
    parts.append(f"{out} as (select norad, k, fit from {out}_f{passes})")
    return ",\n".join(parts)


def kalman_ctes(value: str, before: str, out: str = "kf", q: float = 0.13, r: float = 1.0, p0: float = 1000.0) -> str:
    """Filter over p (norad, k, dt_days); use WITH RECURSIVE."""
    step = f"""select norad, k, z, x0 + dt * x1 as m0, x1 as m1,
    p00 + 2 * dt * p01 + dt * dt * p11 + {q} * dt * dt * dt * dt / 4 as m00,
    p01 + dt * p11 + {q} * dt * dt * dt / 2 as m01, p11 + {q} * dt * dt as m11"""
    gain = f"""select norad, k, m0 + m00 / (m00 + {r}) * (z - m0) as x0, m1 + m01 / (m00 + {r}) * (z - m0) as x1,
    m00 - m00 * m00 / (m00 + {r}) as p00, m01 - m00 * m01 / (m00 + {r}) as p01, m11 - m01 * m01 / (m00 + {r}) as p11,
    z - m0 as y, (z - m0) * (z - m0) / (m00 + {r}) as nis"""
    return f"""{out}_z as (select norad, k, {value} as z, {before} as zb, dt_days as dt from p),
{out}_w(norad, k, x0, x1, p00, p01, p11, y, nis) as (
  select norad, cast(-1 as bigint), zb, (z - zb) / nullif(dt, 0), {p0}e0, 0e0, {p0}e0, 0e0, 0e0 from {out}_z where k = 0
  union all {gain} from ({step} from (select w.norad, a.k, w.x0, w.x1, w.p00, w.p01, w.p11, a.z, a.dt
    from {out}_w w join {out}_z a on a.norad = w.norad and a.k = w.k + 1))),
{out} as (select norad, k, y, nis, x1 as rate from {out}_w where k >= 0)"""


def j2_cte(out: str = "jr") -> str:
    """p with column j2_residual."""
    def position(e, i, raan, argp, m, n, dt, tag):
        axis = f"pow(398600441800000e0, 1e0 / 3) / pow(2e0 * 3.14159265358979 / 86400 * {n}, 2e0 / 3) / 1e3"
        sql = f"""select *, {rad(i)} as i_, {n} * 2 * pi() as n_, {axis} * (1 - {e} * {e}) as p_, {e} as e_,
          {raan} as raan_, {argp} as argp_, {m} as m_, {dt} as t_ from {{0}}"""
        drift = "n_ * 0.001082616 * (6378.135 / p_) * (6378.135 / p_)"
        return [sql, f"""select *, {rad('raan_')} - 1.5 * {drift} * cos(i_) * t_ as node_,
          {rad('argp_')} + 0.75 * {drift} * (5 * cos(i_) * cos(i_) - 1) * t_ as peri_, {rad('m_')} + n_ * t_ as ma_ from {{0}}""",
                "select *, ma_ as x0_ from {0}",
                *[f"select *, x{s}_ - (x{s}_ - e_ * sin(x{s}_) - ma_) / (1 - e_ * cos(x{s}_)) as x{s + 1}_ from {{0}}" for s in range(10)],
                "select *, peri_ + 2 * atan2(sqrt(1 + e_) * sin(x10_ / 2), sqrt(1 - e_) * cos(x10_ / 2)) as u_ from {0}",
                f"""select norad, k, atan2(sin(node_) * cos(u_) + cos(node_) * sin(u_) * cos(i_),
          cos(node_) * cos(u_) - sin(node_) * sin(u_) * cos(i_)) as {tag} from {{0}}"""]

    def chain(levels):
        inner = "p"
        for level in levels:
            inner = f"({level.format(inner)})"
        return inner

    now = chain(position("eccentricity", "inclination", "raan", "arg_perigee", "mean_anomaly", "mean_motion", "0e0", "ra1"))
    then = chain(position("ecc0", "inc0", "raan0", "argp0", "m0", "n0", "dt_days", "ra0"))
    return f"""{out} as (select p.*, {wrap_sql('ra1 - ra0', repr(math.pi) + 'e0')} as j2_residual
  from p join {now} a using (norad, k) join {then} b using (norad, k))"""


def residual_cte(out: str = "kr") -> str:
    return f"{out} as (select *, {KEPLERIAN} as keplerian_residual from p)"


__all__ = ["H", "P", "distance_cte", "j2_cte", "kalman_ctes", "lowess_ctes", "maxima_ctes", "residual_cte",
           "suppressed_ctes", "threshold_ctes"]
