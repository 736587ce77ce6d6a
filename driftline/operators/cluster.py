"""Objects of one cluster on a common time grid.

The grid of a cluster is every time at which any member has a row. Evaluating every member at
every grid time would need members times grid rows. Instead each line between two rows of a
member opens at the first and closes at the second; running sums of the open lines' intercepts
and slopes give the sum over all members at any grid time, so the work grows with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.timing import micros
from driftline.functions.values import finite_or_null
from driftline.operators.blocks import (
    arrange, following, last_seen, long_groups, next_seen, previous, running, series_start)
from driftline.session import join_small, materialise, rows_per_block


def common_grid(series: DataFrame, keys: list[str], time: str = "epoch") -> DataFrame:
    """Distinct times per group, whether or not the values are missing."""
    return series.select(*keys, time).distinct()


def coverage_spans(
    series: DataFrame, keys: list[str], time: str = "epoch",
) -> DataFrame:
    """First and last time of each series with its number of rows."""
    return series.groupBy(*keys).agg(
        F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"))


def join_members(
    series: DataFrame, members: DataFrame, entity: str = "norad",
) -> DataFrame:
    """Add ``cluster`` to the series of its members; a member listed twice counts once."""
    listed = materialise(members.select("cluster", entity).distinct(), "members")
    return join_small(series, listed, [entity], "inner")


def coverage_counts(
    series: DataFrame, group: list[str], entity: str = "norad", time: str = "epoch",
) -> DataFrame:
    """Per grid time: how many members cover it with a span of at least two times."""
    spans = coverage_spans(series, [*group, entity], time).where(F.col("first") < F.col("last"))
    starts = spans.select(*group, F.col("first").alias(time), F.lit(1).alias("_open"), F.lit(0).alias("_shut"))
    ends = spans.select(*group, F.col("last").alias(time), F.lit(0).alias("_open"), F.lit(1).alias("_shut"))
    grid = series.select(*group, time, F.lit(0).alias("_open"), F.lit(0).alias("_shut"))
    events = grid.unionByName(starts).unionByName(ends).groupBy(*group, time).agg(
        F.sum("_open").alias("_open"), F.sum("_shut").alias("_shut"))
    swept = arrange(events, group, time, measure=series).extend(
        _opened=running(F.col("_open")), _ended=running(F.col("_shut")))
    covering = F.col("_opened") - F.col("_ended") + F.col("_shut")  # a span includes its end
    return swept.with_columns({"n_covering": covering.cast("bigint")}).result().select(
        *group, time, "n_covering")


# Times are exact seconds and all values are scaled to at most 1, so that sums of decimals
# cancel exactly: a closed line leaves nothing behind, however steep it was.
# Intercepts and slopes are narrow enough to be summed twice within Spark's 38 digits. A cluster may span
# 150 years: slopes are below 2e6 (a full scale in a microsecond), so intercepts have 16 digits at most.
_SECONDS, _VALUE, _SUM = "decimal(16,6)", "decimal(20,18)", "decimal(38,17)"
_LEVEL, _SLOPE = "decimal(33,17)", "decimal(30,22)"
_MICRO = "decimal(17,0)"


def cluster_mean(
    series: DataFrame, group: list[str], entity: str = "norad", time: str = "epoch",
    value: str = "value",
) -> DataFrame:
    """Per group and grid time: ``mean`` over the members and how many count, ``n_members``.

    Each member counts inside its own span, by linear interpolation; exactly at its rows. A
    missing value blanks both lines that meet at it. A member of one row does not count, and a
    time without any value is left out.
    """
    keys = [*group, entity]
    clean = series.select(*keys, time, finite_or_null(F.col(value).cast("double")).alias("_y"))
    # Sizes, scale and origin of members and groups come from one pass.
    members = materialise(clean.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_size"), F.min(micros(clean, time)).alias("_origin"), F.max(F.abs("_y")).alias("_top")), "members")
    power = F.pow(F.lit(10.0), F.ceil(F.log10(F.when(F.max("_top") > 0, F.max("_top")))))
    scales = materialise(members.groupBy(*group).agg(
        F.sum("_size").alias("_size"), F.coalesce(power, F.lit(1.0)).alias("_scale"), F.min("_origin").alias("_origin")), "scales")
    sizes = scales.select(*group, "_size")
    scales = scales.drop("_size")
    if group and long_groups(series, group, rows_per_block(series.sparkSession), "long-groups", sizes) is None:
        # Groups that one task may hold are brought together once; nothing that follows needs another exchange of rows.
        clean = clean.repartition(*group)
    # Rows of one member at one time count as one row with their mean.
    clean = clean.groupBy(*keys, time).agg(F.avg("_y").alias("_y"))
    clean = clean.withColumn("_us", micros(clean, time))
    scaled = join_small(clean, scales, group, "inner") if group else clean.join(F.broadcast(scales))
    scaled = scaled.withColumn("_f", F.col("_y") / F.col("_scale")).withColumns({
        "_y": F.col("_f").cast(_VALUE),
        "_t": (F.expr(f"cast(_us - _origin as {_MICRO})") * F.expr("cast(0.000001 as decimal(6,6))")).cast(_SECONDS),
    }).drop("_us", "_origin", "_scale")
    paired = arrange(scaled, keys, time, measure=series, sizes=members.select(*keys, "_size")).extend(
        _before=previous("_t"), _after=following("_t", "_f"))
    # A line is made once, at its first row; the row at its other end takes it over. The slope is a column of its own,
    # since its conversions cost more than all else and must not stand in two expressions.
    slope = (F.col("_after._f") - F.col("_f")) / (F.col("_after._t") - F.col("_t")).cast("double")
    paired = paired.with_columns({"_b": slope.cast(_SLOPE), "_lone": F.col("_before").isNull() & F.col("_after").isNull()})
    paired = paired.drop("_before", "_after", "_f").with_columns({
        "_a": (F.col("_y").cast(_SUM) - (F.col("_b") * F.col("_t")).cast(_SUM)).cast(_LEVEL)})
    paired = paired.extend(_last=previous("_a", "_b"))
    counts = F.col("_y").isNotNull() & ~F.col("_lone")
    parts = {"_open": ("_a", "_b"), "_shut": ("_last._a", "_last._b")}
    events = paired.result().groupBy(*group, time).agg(
        F.max("_t").alias("_t"),
        _total(F.when(counts, F.col("_y")), _SUM).alias("_here"),
        F.count_if(counts).alias("_n_here"),
        *[_total(F.col(part), kind).alias(f"{line}_{name}")
          for line, pair in parts.items() for name, part, kind in zip("ab", pair, (_LEVEL, _SLOPE), strict=True)],
        *[F.count(pair[1]).alias(f"{line}_n") for line, pair in parts.items()])
    net = {part: running(F.col(f"_open_{part}") - F.col(f"_shut_{part}")) for part in "abn"}
    swept = arrange(events, group, time, measure=series, sizes=sizes).extend(**{f"_net_{p}": step for p, step in net.items()})
    # At a grid time the lines that open there are not yet under way.
    live = {part: F.col(f"_net_{part}") - F.col(f"_open_{part}") for part in "abn"}
    passing = live["a"].cast(_SUM) + (live["b"].cast(_SLOPE) * F.col("_t")).cast(_SUM)
    n = (F.col("_n_here") + live["n"]).cast("bigint")
    out = swept.with_columns({
        "_sum": (F.col("_here").cast(_SUM) + passing).cast("double"), "n_members": n}).result()
    out = out.where(F.col("n_members") > 0)
    out = join_small(out, scales, group, "inner") if group else out.join(F.broadcast(scales))
    mean = F.col("_sum") * F.col("_scale") / F.col("n_members")
    return out.select(*group, time, mean.alias("mean"), "n_members")


def _total(x: Column, kind: str) -> Column:
    return F.coalesce(F.sum(x).cast(kind), F.lit(0).cast(kind))


def interpolate(
    series: DataFrame, targets: DataFrame, keys: list[str], time: str = "epoch",
    value: str = "value",
) -> DataFrame:
    """``targets`` (keys, time) with the ``value`` of their series at that time.

    Linear between neighbouring rows, exact at a row, nothing outside the series' span or where
    either neighbour's value is missing. Rows at one time count as one row with their mean. Targets of a series of one row give no value.
    """
    knots = series.select(*keys, time, finite_or_null(F.col(value).cast("double")).alias("_y"),
                          F.lit(True).alias("_knot"), F.lit(False).alias("_wanted"))
    wanted = targets.select(*keys, time).distinct().select(
        *keys, time, F.lit(None).cast("double").alias("_y"), F.lit(False).alias("_knot"),
        F.lit(True).alias("_wanted"))
    both = knots.unionByName(wanted)
    points = both.groupBy(*keys, time).agg(
        F.avg("_y").alias("_y"), F.max("_knot").alias("_knot"), F.max("_wanted").alias("_wanted"))
    points = points.withColumn("_us", micros(points, time))
    knot = F.when(F.col("_knot"), F.struct("_us", "_y"))
    ordered = arrange(points, keys, time, measure=both.select(*keys, time)).with_columns({"_at": knot})
    ordered = ordered.extend(
        _lo=last_seen(F.col("_at")), _hi=next_seen(F.col("_at")),
        _start=series_start(F.when(F.col("_knot"), F.col("_us"))),
        _stop=series_start(F.when(F.col("_knot"), -F.col("_us"))))
    share = ((F.col("_us") - F.col("_lo._us")).cast("double")
             / F.nullif(F.col("_hi._us") - F.col("_lo._us"), F.lit(0)).cast("double"))
    between = F.col("_lo._y") + share * (F.col("_hi._y") - F.col("_lo._y"))
    read = F.when(F.col("_knot"), F.col("_y")).otherwise(between)
    many = F.col("_start") != -F.col("_stop")
    return ordered.with_columns({"value": F.when(many, read)}).result().where(
        F.col("_wanted")).select(*keys, time, "value")
