"""Value handling: missing numbers, clipping, labels, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Readable name and unit of each parameter.
LABELS = {
    "sma": ("Demi-grand axe", "km"),
    "eccentricity": ("Excentricité", "-"),
    "inclination": ("Inclination", "°"),
    "raan": ("RAAN", "°"),
    "arg_perigee": ("Argument of Perigee", "°"),
    "mean_anomaly": ("Mean Anomaly", "°"),
    "mean_motion": ("Mean Motion", "rev./day"),
    "period": ("Période", "s"),
    "velocity": ("Vitesse", "m/s"),
    "rev_at_epoch": ("Révolution à l'epoch", ""),
    "bstar": ("B*", "1/m"),
}
# Parameters clipped at these percentiles for display.
PERCENTILE_CLIP = ("eccentricity", "inclination", "bstar")
CLIP_PROBABILITIES = (0.01, 0.99)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_or_null(x: Column) -> Column:
    """NaN and infinities become NULL, so that aggregates skip them."""
    return F.when(is_finite(x), x)


def clean_doubles(df: DataFrame) -> DataFrame:
    """``finite_or_null`` on every floating column."""
    floating = (T.DoubleType, T.FloatType)
    return df.select([
        finite_or_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, floating)
        else F.col(f.name) for f in df.schema.fields])


def clip(x: Column, lo: Column, hi: Column) -> Column:
    """Missing values stay missing; a missing bound leaves the value alone."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, hi), lo))


def axis_label(param: Column) -> Column:
    """``"label [unit]"``, the label alone without a unit, else the parameter's own name."""
    known = F.create_map(*[
        F.lit(part) for name, (label, unit) in LABELS.items()
        for part in (name, f"{label} [{unit}]" if unit else label)])
    return F.coalesce(F.try_element_at(known, param), param)


def output_tag(pattern: Column, country: Column) -> Column:
    """Name of one selection's output; an empty part reads ``ALL``."""
    part = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("ALL"))
    return F.concat_ws("_", part(pattern), part(country))
