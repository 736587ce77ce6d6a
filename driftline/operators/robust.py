"""Per-series statistics placed on every row, and the detection threshold."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.values import finite_or_null
from driftline.operators.blocks import BLOCK, Ordered
from driftline.operators.per_series import floats, map_groups
from driftline.operators.quantiles import long_quantiles, run_medians
from driftline.operators.tiles import NUMBERS, pack, write_tiles
from driftline.session import join_small, materialise

# Fixed value: scales a median absolute deviation to a standard deviation.
MAD_SCALE = 1.4826
_FEWEST = 3


def series_medians(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Add the exact median of each value over the whole of each short series."""
    held = {f"_x_{name}": value for name, value in values.items()}
    group = W.partitionBy(*keys)
    return rows.withColumns(held).withColumns({name: F.median(f"_x_{name}").over(group) for name in values}).drop(*held)


def _long_statistics(rows: DataFrame, keys: list[str], order: str, magnitudes: dict[str, str], step: Column | None) -> DataFrame:
    """``_n_``, ``_median_``, ``_mad_`` and ``_std_`` of each magnitude (name to column), and ``_step``: a row per long series.

    Each block's values are sorted into runs once, which serve the medians and the deviations from them alike.
    """
    names = list(magnitudes)
    values = {f"_v{i}": F.col(c) for i, c in enumerate(magnitudes.values())} | ({} if step is None else {f"_v{len(names)}": step})
    by = [*keys, "_which"]
    runs = write_tiles(_runs(rows.select(*keys, BLOCK, order, *[v.cast("double").alias(c) for c, v in values.items()]), keys, order, list(values)), "runs")
    medians = materialise(run_medians(runs, by, "_v"), "medians")
    known = join_small(runs.where(F.col("_which") < len(names)), medians.drop("n"), by, "inner")
    away = known.select(*by, F.sort_array(F.transform("_v", lambda x_: F.abs(x_ - F.col("median")))).alias("_v"))
    mads = materialise(run_medians(away, by, "_v").drop("n").withColumnRenamed("median", "mad"), "mads")
    of = lambda i, column: F.max(F.when(F.col("_which") == i, F.col(column)))
    columns = [of(i, held).alias(f"_{what}_{name}") for i, name in enumerate(names) for what, held in (("median", "median"), ("mad", "mad"))]
    if step is not None:
        columns.append(of(len(names), "median").alias("_step"))
    found = medians.join(mads, by, "left").groupBy(*keys).agg(*columns)
    sums = rows.groupBy(*keys).agg(*[f.alias(f"_{what}_{name}") for name, c in magnitudes.items()
                                     for what, f in (("n", F.count(c)), ("std", F.stddev_pop(c)))])
    return materialise(sums.join(found, keys, "left"), "per-series")


def _runs(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """``_which`` column (its number), and ``_v``, a block's values of it that aren't missing, sorted."""
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("_which", T.LongType()), T.StructField("_v", NUMBERS)])

    def change(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        block = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        parts = []
        for number, name in enumerate(columns):
            x = floats(table[name])
            some = ~np.isnan(x)
            x, of = x[some], block[some]
            out = table.select(keys).take(pa.array(bounds[:-1])).append_column("_which", pa.array(np.full(len(bounds) - 1, number)))
            parts.append(out.append_column("_v", pack(x[np.lexsort((x, of))], np.searchsorted(of, np.arange(len(bounds))))))
        return pa.concat_tables(parts)

    return map_groups(rows, [*keys, BLOCK], order, schema, change)


def _threshold(n: Column, median: Column, mad: Column, std: Column, sigma: float) -> Column:
    return F.when(n >= _FEWEST, median + F.lit(float(sigma)) * _scale(mad, std))


def _scale(mad: Column, std: Column) -> Column:
    return F.when(mad > 0, F.lit(MAD_SCALE) * mad).otherwise(std)


def with_thresholds(
    series: Ordered, signals: dict[str, str], sigma: float, min_days: float | None = None,
) -> Ordered:
    """Add ``<prefix>magnitude`` (absolute, NULL where not finite) and ``<prefix>threshold``.

    ``signals`` maps a signal column to its prefix. The threshold is the median plus ``sigma``
    scales; the scale is the scaled median absolute deviation or, where that is 0, the
    population standard deviation. Fewer than three finite values give no threshold.

    ``min_days`` also adds ``distance``, the number of samples that it spans at the series'
    median step: rounded half to even, at least 1, NULL where the step is unknown or not
    positive. The step that leads to the first paired row does not count.
    """
    out = series.with_columns({
        f"{p}magnitude": F.abs(finite_or_null(F.col(signal))) for signal, p in signals.items()})
    prefixes = list(signals.values())
    wanted = {f"_median_{p}": F.col(f"{p}magnitude") for p in prefixes}
    if min_days is not None:
        wanted["_step"] = F.when(F.col("k") >= 1, F.col("dt_days"))
    keys, group = list(series.keys), W.partitionBy(*series.keys)

    def short(rows: DataFrame) -> DataFrame:
        rows = series_medians(rows, keys, wanted)
        rows = series_medians(rows, keys, {f"_mad_{p}": F.abs(F.col(f"{p}magnitude") - F.col(f"_median_{p}")) for p in prefixes})
        return rows.withColumns({name: aggregate.over(group) for p in prefixes for name, aggregate in (
            (f"_n_{p}", F.count(f"{p}magnitude")), (f"_std_{p}", F.stddev_pop(f"{p}magnitude")))})

    def long(rows: DataFrame) -> DataFrame:
        rows = materialise(rows, "series")
        found = _long_statistics(rows, keys, series.order, {p: f"{p}magnitude" for p in prefixes}, wanted.get("_step"))
        return join_small(rows, found, keys, "left")

    out = out.map(short, long)
    columns = {f"{p}threshold": _threshold(
        *[F.col(f"_{c}_{p}") for c in ("n", "median", "mad", "std")], sigma) for p in prefixes}
    if min_days is not None:
        samples = F.rint(F.lit(float(min_days)) / F.nullif(F.col("_step"), F.lit(0.0))).cast("bigint")
        columns["distance"] = F.when(F.col("_step") > 0, F.greatest(F.lit(1), samples))
    used = [f"_{c}_{p}" for c in ("n", "median", "mad", "std") for p in prefixes]
    return out.with_columns(columns).drop(*used, "_step")


def threshold_of(magnitude, sigma: float) -> float:
    """The threshold of one whole series; NaN for fewer than three finite values."""
    x = magnitude[np.isfinite(magnitude)]
    if len(x) < _FEWEST:
        return np.nan
    median = np.median(x)
    mad = np.median(np.abs(x - median))
    return median + sigma * (MAD_SCALE * mad if mad > 0 else np.std(x))


def distance_of(k, dt, min_days: float) -> float:
    """The samples that ``min_days`` span at the median step of one whole series; NaN where the step is unknown or not positive."""
    steps = dt[(k >= 1) & np.isfinite(dt)]
    step = np.median(steps) if len(steps) else np.nan
    return max(1.0, np.rint(min_days / step)) if step > 0 else np.nan


def robust_summary(series: Ordered, signal: str, sigma: float) -> DataFrame:
    """One row per series: ``n``, ``median``, ``mad``, ``scale`` and ``threshold`` of the magnitude."""
    keys = list(series.keys)
    held = series.map(lambda rows: rows.select(*keys, F.abs(finite_or_null(F.col(signal))).alias("_x")).where("_x is not null"))
    group = W.partitionBy(*keys)
    parts = []
    if held.long is not None:
        long = materialise(held.long, "magnitudes")
        medians = long_quantiles(long, keys, "_x", [0.5]).select(*keys, F.col("quantiles")[0].alias("median"))
        away = join_small(long, medians, keys, "inner").withColumn("_d", F.abs(F.col("_x") - F.col("median")))
        mads = long_quantiles(away, keys, "_d", [0.5]).select(*keys, F.col("quantiles")[0].alias("mad"))
        sums = long.groupBy(*keys).agg(F.count("_x").alias("n"), F.stddev_pop("_x").alias("_std"))
        parts.append(sums.join(medians, keys).join(mads, keys))
    if held.short is not None:  # the window and the aggregate share one shuffle
        parts.append(held.short.withColumn("median", F.median("_x").over(group)).groupBy(*keys).agg(
            F.count("_x").alias("n"), F.max("median").alias("median"),
            F.median(F.abs(F.col("_x") - F.col("median"))).alias("mad"), F.stddev_pop("_x").alias("_std")))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.select(
        *keys, "n", "median", "mad", _scale(F.col("mad"), F.col("_std")).alias("scale"),
        _threshold(*[F.col(c) for c in ("n", "median", "mad", "_std")], sigma).alias("threshold"))
