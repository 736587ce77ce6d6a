"""Percentile bounds per series or pooled, and clipped series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.values import CLIP_PROBABILITIES, PERCENTILE_CLIP, clip, finite_or_null
from driftline.operators.quantiles import exact_quantiles
from driftline.session import join_small, materialise


def percentile_bounds(
    series: DataFrame, keys: list[str], value: str = "value",
    probabilities: tuple[float, float] = CLIP_PROBABILITIES,
) -> DataFrame:
    """``keys``, ``lo`` and ``hi`` over the finite values of each group."""
    finite = series.select(*keys, finite_or_null(F.col(value)).alias("_finite"))
    return exact_quantiles(finite, keys, "_finite", list(probabilities)).select(
        *keys, F.col("quantiles")[0].alias("lo"), F.col("quantiles")[1].alias("hi"))


def clip_series(
    series: DataFrame, pooled: bool = False, limits: dict[str, tuple[float, float]] | None = None,
    entity: str = "norad",
) -> DataFrame:
    """Long series with ``value`` clipped.

    Given ``limits`` win; otherwise the parameters of ``PERCENTILE_CLIP`` are clipped at the
    1st and 99th percentile, per object or over all objects; the others stay as they are.
    """
    limits = limits or {}
    cleaned = series.withColumn("value", finite_or_null(F.col("value")))
    computed = [p for p in PERCENTILE_CLIP if p not in limits]
    keys = ["param"] if pooled else [entity, "param"]
    bounds = materialise(
        percentile_bounds(cleaned.where(F.col("param").isin(computed)), keys), "bounds")
    out = join_small(cleaned, bounds, keys, "left")
    lo, hi = F.col("lo"), F.col("hi")
    for param, (low, high) in limits.items():
        given = F.col("param") == param
        lo, hi = _either(given, low, lo), _either(given, high, hi)
    return out.withColumn("value", clip(F.col("value"), lo, hi)).drop("lo", "hi")


def _either(condition: Column, value: float, otherwise: Column) -> Column:
    return F.when(condition, F.lit(float(value))).otherwise(otherwise)
