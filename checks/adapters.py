"""The given tables in the shapes the operators read, for Spark and as SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.orbit import GM, PI
from driftline.sources.readers import derive

_HISTORY = [
    ("norad", "user_id"),
    ("object_name", "concat('SAT-', cast(user_id as varchar(20)))"),
    ("epoch", "ts"),
    ("creation_date", "ts"),
    ("rev_at_epoch", "event_id"),
    ("inclination", "(user_id % 90) + (event_id % 100) / 1e3"),
    ("raan", "cast((event_id * 7) % 360 as double)"),
    ("arg_perigee", "cast((event_id * 11) % 360 as double)"),
    ("mean_anomaly", "cast((event_id * 13) % 360 as double)"),
    ("mean_motion", "1e0 + value / 1e3"),
    ("eccentricity", "(event_id % 1000) / 1e4"),
    ("bstar", "value * 1e-6"),
]
_LIST = ", ".join(f"{expr} as {name}" for name, expr in _HISTORY)

SMA_SQL = f"{GM ** (1.0 / 3.0)!r}e0 / pow({2.0 * PI / 86400.0!r} * mean_motion, {2.0 / 3.0!r}) / 1e3".replace("e0e0", "e0")
LONGITUDE_SQL = "(raan + arg_perigee + mean_anomaly)"


def floor_mod(x: str, m: str = "360e0") -> str:
    return f"(({x}) - {m} * floor(({x}) / {m}))"


def wrap_sql(x: str, half: str = "180e0") -> str:
    return f"({floor_mod(f'({x}) + {half}', f'(2e0 * {half})')} - {half})"


# h: history with semi-major axis and mean longitude; p: rows paired with their predecessor.
H = f"""h as (select *, {SMA_SQL} as sma, {floor_mod(LONGITUDE_SQL)} as lon, epoch_us(epoch) as us
  from (select {_LIST} from events))"""
P = f"""{H}, p as (select * from (select *, row_number() over w - 2 as k,
    (us - lag(us) over w) / 86400e6 as dt_days, (us - first_value(us) over w) / 86400e6 as elapsed_days,
    lag(lon) over w as lon0, lag(mean_motion) over w as n0, lag(sma) over w as sma0,
    lag(eccentricity) over w as ecc0, lag(inclination) over w as inc0, lag(raan) over w as raan0,
    lag(arg_perigee) over w as argp0, lag(mean_anomaly) over w as m0
  from h window w as (partition by norad order by epoch)) where k >= 0)"""
KEPLERIAN = wrap_sql(f"lon - {floor_mod('lon0 + n0 * 360e0 * dt_days')}")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def history(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as an element history."""
    return derive(table(spark, sf, "events").selectExpr(*[f"{e} as {n}" for n, e in _HISTORY]))


REVISED_SQL = """(select l_suppkey as norad, l_shipdate as epoch, l_orderkey as creation_seq,
  l_linenumber as tiebreak, l_extendedprice as sma, l_discount as eccentricity from lineitem)"""


def revised(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem`` as a history with several revisions per epoch."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_suppkey as norad", "l_shipdate as epoch", "l_orderkey as creation_seq",
        "l_linenumber as tiebreak", "l_extendedprice as sma", "l_discount as eccentricity")


CATALOGUE_SQL = """(select c_custkey as norad_cat_id, c_name as object_name, c_mktsegment as country_code,
  case when c_nationkey % 2 = 0 then 'PAYLOAD' else 'DEBRIS' end as object_type,
  c_acctbal as semimajor_axis from customer)"""


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """``customer`` as a catalogue."""
    return table(spark, sf, "customer").selectExpr(
        "c_custkey as norad_cat_id", "c_name as object_name", "c_mktsegment as country_code",
        "case when c_nationkey % 2 = 0 then 'PAYLOAD' else 'DEBRIS' end as object_type",
        "c_acctbal as semimajor_axis")


# Raw records: field, Spark text, DuckDB text.
_STAMP = ("date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")", "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f')")
_RAW = [("NORAD_CAT_ID", "norad", None), ("OBJECT_NAME", "object_name", None), ("EPOCH", "epoch", "t"),
        ("CREATION_DATE", "creation_date", "t"), ("REV_AT_EPOCH", "rev_at_epoch", None),
        ("INCLINATION", "inclination", 4), ("RA_OF_ASC_NODE", "raan", 1), ("ARG_OF_PERICENTER", "arg_perigee", 1),
        ("MEAN_ANOMALY", "mean_anomaly", 1), ("MEAN_MOTION", "mean_motion", 6), ("ECCENTRICITY", "eccentricity", 5),
        ("BSTAR", "bstar", 10)]


def _raw_text(column: str, kind, spark: bool) -> str:
    if kind is None:
        return f"cast({column} as varchar(40))"
    if kind == "t":
        return _STAMP[0 if spark else 1].format(column)
    return (f"format_string('%.{kind}f', {column})" if spark else f"printf('%.{kind}f', {column})")


RAW_SQL = f"(select {', '.join(f'{_raw_text(c, k, False)} as {f}' for f, c, k in _RAW)} from h)"


def raw_history(spark: SparkSession, sf: str) -> DataFrame:
    """The element history as it lands: every value a text."""
    return history(spark, sf).selectExpr(*[f"{_raw_text(c, k, True)} as {f}" for f, c, k in _RAW])


def rad(x: str) -> str:
    return f"(({x}) * {math.pi!r} / 180e0)"


def landed(df: DataFrame, path: str, batch: str, size: int = 50) -> str:
    """Write records as JSON arrays of one batch per line."""
    batches = df.groupBy(F.expr(f"{batch} div {size}").alias("_batch")).agg(
        F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    batches.select("value").write.text(path)
    return path
