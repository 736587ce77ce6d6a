"""Aggregates, robust statistics, clipping and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapters import H, P, history, table
from checks.registry import query, rounded, rsql
from checks.sqlparts import distance_cte, residual_cte, threshold_ctes
from driftline.operators import cluster as CL
from driftline.operators.blocks import arrange
from driftline.operators.clipping import clip_series, percentile_bounds
from driftline.operators.history import counts, grouped_pages, unpivot
from driftline.operators.robust import robust_summary, with_thresholds
from driftline.operators.steps import keplerian_residual, with_steps
from driftline.plans.detect import ordered_history


@query("a1_grouped_history", f"""with {H}, n as (select *, (row_number() over (partition by norad order by epoch) - 1) // 20 as page from h)
select norad, page, count(*) as n, string_agg(cast(rev_at_epoch as varchar), ',' order by epoch) as revs from n group by norad, page""")
def a1(spark, sf):
    pages = grouped_pages(history(spark, sf), ["rev_at_epoch"], page_rows=20)
    return pages.select("norad", "page", F.size("records").cast("bigint").alias("n"),
                        F.array_join(F.transform("records", lambda r_: r_["rev_at_epoch"].cast("string")), ",").alias("revs"))


@query("a2_counts", f"with {H} select count(*) as n_rows, count(distinct norad) as n_objects from h")
def a2(spark, sf):
    return counts(history(spark, sf))


_SUMMARY = f"with {P}, {residual_cte()}, {threshold_ctes('kr', 'keplerian_residual', 4)} select norad, "


def _residuals(spark, sf):
    return keplerian_residual(ordered_history(history(spark, sf), revised=False))


def _summary(spark, sf, sigma=4.0):
    return robust_summary(_residuals(spark, sf), "keplerian_residual", sigma)


@query("a3_median", _SUMMARY + f"{rsql('med')} as median from th")
def a3(spark, sf):
    return _summary(spark, sf).select("norad", rounded("median").alias("median"))


@query("a4_mad", _SUMMARY + f"{rsql('mad')} as mad from th")
def a4(spark, sf):
    return _summary(spark, sf).select("norad", rounded("mad").alias("mad"))


_FLAT = "case when user_id % 4 = 0 then 5e0 when user_id % 4 = 1 and event_id % 3 = 0 then 9e0 when user_id % 4 = 1 then 5e0 else value end"


@query("a5_robust_scale", f"""with s as (select user_id as norad, {_FLAT} as v from events), {threshold_ctes('s', 'v', 4)}
select norad, {rsql('scale')} as scale from th""")
def a5(spark, sf):
    rows = table(spark, sf, "events").selectExpr("user_id as norad", "ts as epoch", f"{_FLAT} as v")
    return robust_summary(arrange(rows, ["norad"], "epoch"), "v", 4.0).select("norad", rounded("scale").alias("scale"))


@query("a6_threshold", _SUMMARY + f"n, {rsql('threshold')} as threshold from th")
def a6(spark, sf):
    return _summary(spark, sf).select("norad", "n", rounded("threshold").alias("threshold"))


@query("a7_sample_distance", f"with {P}, {distance_cte(7)} select norad, distance from ds")
def a7(spark, sf):
    steps = with_thresholds(with_steps(ordered_history(history(spark, sf), revised=False)), {"dt_days": ""}, 4.0, 7.0)
    return steps.rows.groupBy("norad").agg(F.max("distance").alias("distance"))


_PARAMS = ["eccentricity", "inclination", "bstar", "raan"]
_LONG = " union all ".join(f"select norad, epoch, '{p}' as param, {p} as value from h" for p in _PARAMS)


def _series(spark, sf):
    return unpivot(history(spark, sf), _PARAMS)


@query("a8_percentile_bounds", f"""with {H}, s as ({_LONG}) select norad, param, {rsql('quantile_cont(value, 0.01)', 12)} as lo,
{rsql('quantile_cont(value, 0.99)', 12)} as hi from s group by norad, param""")
def a8(spark, sf):
    return percentile_bounds(_series(spark, sf), ["norad", "param"]).select(
        "norad", "param", rounded("lo", 12).alias("lo"), rounded("hi", 12).alias("hi"))


@query("a9_pooled_bounds", f"""with {H}, s as ({_LONG}) select param, {rsql('quantile_cont(value, 0.01)', 12)} as lo,
{rsql('quantile_cont(value, 0.99)', 12)} as hi from s group by param""")
def a9(spark, sf):
    return percentile_bounds(_series(spark, sf), ["param"]).select(
        "param", rounded("lo", 12).alias("lo"), rounded("hi", 12).alias("hi"))


@query("a9_pooled_price_bounds", f"""select l_returnflag as param, {rsql('quantile_cont(l_extendedprice, 0.01)', 4)} as lo,
{rsql('quantile_cont(l_extendedprice, 0.99)', 4)} as hi from lineitem group by l_returnflag""")
def a9_prices(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_returnflag as param", "l_extendedprice as value")
    return percentile_bounds(rows, ["param"]).select(
        "param", rounded("lo", 4).alias("lo"), rounded("hi", 4).alias("hi"))


_CLIP = f"case when param in ('eccentricity', 'inclination') then greatest(lo, least(value, hi)) when param = 'bstar' then greatest(1e-5, least(value, 5e-5)) else value end"


@query("s9_clip_per_object", f"""with {H}, s as ({_LONG}), b as (select norad, param, quantile_cont(value, 0.01) as lo,
quantile_cont(value, 0.99) as hi from s group by norad, param)
select norad, epoch, param, {rsql(_CLIP, 12)} as value from s join b using (norad, param)""")
def s9(spark, sf):
    return clip_series(_series(spark, sf), limits={"bstar": (1e-5, 5e-5)}).select(
        "norad", "epoch", "param", rounded("value", 12).alias("value"))


@query("s9_clip_pooled", f"""with {H}, s as ({_LONG}), b as (select param, quantile_cont(value, 0.01) as lo,
quantile_cont(value, 0.99) as hi from s group by param)
select norad, epoch, param, {rsql(_CLIP, 12)} as value from s join b using (param)""")
def s9_pooled(spark, sf):
    return clip_series(_series(spark, sf), pooled=True, limits={"bstar": (1e-5, 5e-5)}).select(
        "norad", "epoch", "param", rounded("value", 12).alias("value"))


# Clusters of ten objects; every 13th value is missing.
_HOLES = "case when event_id % 13 = 0 then null else value end"
_CLUSTERED = f"(select user_id // 10 as cluster, user_id as norad, ts as epoch, {_HOLES} as value from events)"


def _clustered(spark, sf, size=10):
    rows = table(spark, sf, "events").selectExpr("user_id as norad", "ts as epoch", f"{_HOLES} as value")
    members = rows.selectExpr("norad", f"norad div {size} as cluster")
    return CL.join_members(rows, members)


@query("su3_common_grid", f"select distinct cluster, epoch from {_CLUSTERED}")
def su3(spark, sf):
    return CL.common_grid(_clustered(spark, sf), ["cluster"])


@query("a11_coverage_spans", f"""select cluster, norad, min(epoch) as first, max(epoch) as last, count(*) as n
from {_CLUSTERED} group by cluster, norad""")
def a11(spark, sf):
    return CL.coverage_spans(_clustered(spark, sf), ["cluster", "norad"])


@query("j5_grid_coverage", f"""with s as {_CLUSTERED}, g as (select distinct cluster, epoch from s),
sp as (select cluster, norad, min(epoch) as lo, max(epoch) as hi from s group by cluster, norad having count(*) >= 2)
select cluster, epoch, count(norad) as n_covering from g left join sp using (cluster)
where norad is null or epoch between lo and hi group by cluster, epoch""")
def j5(spark, sf):
    return CL.coverage_counts(_clustered(spark, sf), ["cluster"])


def _interpolation_ctes(source: str) -> str:
    """f(cluster, norad, epoch, y): every member at every grid time of its cluster inside its span."""
    return f"""s as materialized {source}, g as (select distinct cluster, epoch from s),
sp as (select cluster, norad, min(epoch) as lo, max(epoch) as hi from s group by cluster, norad having count(*) >= 2),
seg as (select cluster, norad, epoch as t0, value as y0, lead(epoch) over w as t1, lead(value) over w as y1
  from s window w as (partition by cluster, norad order by epoch)),
f as (select g.cluster, sp.norad, g.epoch, case when g.epoch = seg.t0 then y0
    else y0 + (epoch_us(g.epoch) - epoch_us(t0)) * 1e0 / (epoch_us(t1) - epoch_us(t0)) * (y1 - y0) end as y
  from g join sp on g.cluster = sp.cluster and g.epoch between lo and hi
  join seg on seg.cluster = sp.cluster and seg.norad = sp.norad and g.epoch >= t0 and (g.epoch < t1 or t1 is null))"""


@query("a10_cluster_mean", f"""with {_interpolation_ctes(_CLUSTERED)}
select cluster, epoch, {rsql('avg(y)')} as mean, count(y) as n_members from f group by cluster, epoch having count(y) > 0""")
def a10(spark, sf):
    return CL.cluster_mean(_clustered(spark, sf), ["cluster"]).select(
        "cluster", "epoch", rounded("mean").alias("mean"), "n_members")


@query("a10_cluster_mean_all_objects", f"""with {_interpolation_ctes(_CLUSTERED.replace('user_id // 10', '0'))}
select epoch, {rsql('avg(y)')} as mean, count(y) as n_members from f group by epoch having count(y) > 0""")
def a10_all(spark, sf):
    rows = table(spark, sf, "events").selectExpr("user_id as norad", "ts as epoch", f"{_HOLES} as value")
    return CL.cluster_mean(rows, []).select("epoch", rounded("mean").alias("mean"), "n_members")


# Times 850 times as far apart reach from 1957 to 2024 and on; every third object has its rows twice, the second with value + 2.
_LONG_TIME = "timestamp '1957-10-04' + to_microseconds(cast((epoch_us(epoch) - epoch_us(timestamp '2024-01-01')) * 850 as bigint))"
_STRETCHED = f"""(select cluster, norad, {_LONG_TIME} as epoch, avg(value) as value from (select * from {_CLUSTERED}
  union all select cluster, norad, epoch, value + 2e0 from {_CLUSTERED} where norad % 3 = 0) group by all)"""


@query("a10_cluster_mean_over_70_years", f"""with {_interpolation_ctes(_STRETCHED)}
select cluster, epoch, {rsql('avg(y)')} as mean, count(y) as n_members from f group by cluster, epoch having count(y) > 0""")
def a10_long(spark, sf):
    rows = _clustered(spark, sf)
    rows = rows.unionByName(rows.where("norad % 3 = 0").withColumn("value", F.col("value") + 2.0))
    since = "(unix_micros(cast(epoch as timestamp)) - unix_micros(timestamp '2024-01-01 00:00:00Z')) * 850"
    rows = rows.withColumn("epoch", F.expr(f"timestamp_ntz'1957-10-04 00:00:00' + {since} * interval '0.000001' second"))
    return CL.cluster_mean(rows, ["cluster"]).select("cluster", "epoch", rounded("mean").alias("mean"), "n_members")


# The revised history with the time of each revision, as charts read it.
_REVISIONS = """(select l_suppkey as norad, l_shipdate as epoch, l_orderkey * 8 + l_linenumber as seq,
  l_extendedprice as sma, l_discount as eccentricity from lineitem)"""
_LATEST = f"""n as materialized (select * from (select *, row_number() over (partition by norad, epoch
  order by seq desc, sma desc, eccentricity desc) as rk from {_REVISIONS}) where rk = 1)"""


def _revisions(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_suppkey as norad", "l_shipdate as epoch", "l_extendedprice as sma", "l_discount as eccentricity",
        "timestamp_ntz'2000-01-01 00:00:00' + (l_orderkey * 8 + l_linenumber) * interval '1' second as creation_date")


@query("chart_series_of_revisions", f"""with {_LATEST}, s as (select norad, epoch, 'sma' as param, sma as value from n
  union all select norad, epoch, 'eccentricity', eccentricity from n),
b as (select norad, param, quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi from s group by norad, param)
select norad, epoch, param, {rsql("case when param = 'eccentricity' then greatest(lo, least(value, hi)) else value end", 9)} as value
from s join b using (norad, param)""")
def chart_revisions(spark, sf):
    from driftline.plans.series import chart_series
    return chart_series(_revisions(spark, sf), ["sma", "eccentricity"]).select(
        "norad", "epoch", "param", rounded("value", 9).alias("value"))


@query("chart_series_pooled_with_limits", f"""with {_LATEST}, s as (select norad, epoch, 'sma' as param, sma as value from n where norad in (7, 3)
  union all select norad, epoch, 'eccentricity', eccentricity from n where norad in (7, 3)),
b as (select param, quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi from s group by param)
select norad, epoch, param, {rsql("case when param = 'eccentricity' then greatest(0.02, least(value, 0.08)) else value end", 9)} as value from s""")
def chart_limits(spark, sf):
    """Several objects compared: limits given for one quantity."""
    from driftline.plans.series import chart_series
    rows = chart_series(_revisions(spark, sf), ["sma", "eccentricity"], norads=[7, 3], pooled=True, limits={"eccentricity": (0.02, 0.08)})
    return rows.select("norad", "epoch", "param", rounded("value", 9).alias("value"))


# Means of prices often end in a half of the last digit; a small shift keeps both engines off it.
@query("cluster_series_of_revisions", f"""with {_LATEST},
{_interpolation_ctes("(select norad // 10 as cluster, norad, epoch, sma / 1e3 as value from n)")}
select cluster, 'sma' as param, epoch, {rsql('avg(y) + 314159e-12', 6)} as mean, count(y) as n_members from f group by cluster, epoch having count(y) > 0""")
def cluster_revisions(spark, sf):
    from driftline.plans.series import cluster_series
    rows = _revisions(spark, sf).withColumn("sma", F.col("sma") / 1e3)
    members = rows.selectExpr("norad", "norad div 10 as cluster").distinct()
    return cluster_series(rows, members, ["sma"]).select("cluster", "param", "epoch", rounded(F.col("mean") + 314159e-12, 6).alias("mean"), "n_members")


_PAIRED = _CLUSTERED.replace("user_id // 10", "user_id // 2")


@query("w13_interpolation", f"""with {_interpolation_ctes(_PAIRED)}
select norad, epoch, {rsql('y')} as value from f""")
def w13(spark, sf):
    series = _clustered(spark, sf, size=2)
    spans = CL.coverage_spans(series, ["norad"]).where(F.col("n") >= 2)
    # In a cluster of two the grid of a member is its own rows and the other one's.
    other = series.select(F.col("norad").bitwiseXOR(F.lit(1)).alias("norad"), "epoch")
    targets = series.select("norad", "epoch").unionByName(other).join(spans, "norad").where(
        F.col("epoch").between(F.col("first"), F.col("last")))
    return CL.interpolate(series, targets, ["norad"]).withColumn("value", rounded("value"))


@query("a12_detection_counts", f"""with {P}, {residual_cte()}, {threshold_ctes('kr', 'keplerian_residual', 1)}
select norad, 'residual' as method, count(*) filter (abs(keplerian_residual) >= threshold) as n_maneuvers
from kr join th using (norad) group by norad""")
def a12(spark, sf):
    from driftline.plans.detect import detection_counts
    rows = with_thresholds(_residuals(spark, sf), {"keplerian_residual": ""}, 1.0).rows
    return detection_counts(rows.select(
        "norad", F.lit("residual").alias("method"), (F.col("magnitude") >= F.col("threshold")).alias("is_maneuver")))
