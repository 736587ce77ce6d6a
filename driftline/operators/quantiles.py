"""Exact quantiles per group, for groups of any size.

Short groups are sorted and read at the wanted ranks. Long ones never meet in one task, nor do their distinct values: the digits
of a wanted value are found one after the other, each from a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from driftline.operators.blocks import long_groups
from driftline.operators.per_series import map_groups
from driftline.operators.tiles import LONGS, NUMBERS, lists, pack, ranges, starts, write_tiles
from driftline.session import join_small, materialise, rows_per_block

_DIGIT = 16  # bits found in a pass
_SIGN = np.int64(-1 << 63)
_SAMPLES = 64  # values that a run passes on in a round


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: list[float],
    rows: int | None = None,
) -> DataFrame:
    """``keys``, ``n`` non-null values and ``quantiles`` with linear interpolation.

    A group without non-null values gives no row.
    """
    limit = rows or rows_per_block(df.sparkSession)
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = long_groups(values, keys, limit, "long-groups")
    if sizes is None:
        return _short(values, keys, probabilities)
    values = materialise(values, "values")  # read several times from here on
    if not keys:
        return long_quantiles(values, keys, "_v", probabilities)
    short = join_small(values, sizes, keys, "left_anti")
    long = join_small(values, sizes, keys, "left_semi")
    return _short(short, keys, probabilities).unionByName(
        long_quantiles(long, keys, "_v", probabilities))


def _short(values: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    group = W.partitionBy(*keys)
    ranked = values.withColumns({
        "_at": F.row_number().over(group.orderBy("_v")) - F.lit(1), "n": F.count("_v").over(group)})
    places = [F.lit(float(p)) * (F.col("n") - F.lit(1)) for p in probabilities]
    wanted = reduce(lambda a, b: a | b, [
        F.col("_at").isin(F.floor(place), F.ceil(place)) for place in places])

    def read(place):
        low = F.max(F.when(F.col("_at") == F.floor(place), F.col("_v")))
        high = F.max(F.when(F.col("_at") == F.ceil(place), F.col("_v")))
        share = F.max(place - F.floor(place))
        return low * (F.lit(1.0) - share) + high * share

    return ranked.where(wanted).groupBy(*keys).agg(
        F.max("n").alias("n"), F.array(*[read(place) for place in places]).alias("quantiles"))


@F.pandas_udf(LongType())
def _image(value: pd.Series) -> pd.Series:
    """The bits of a double so turned that they order like the doubles when read as unsigned numbers."""
    x = value.to_numpy(dtype=float) + 0.0  # one zero
    bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
    return pd.Series(np.where(bits < 0, ~bits, bits ^ _SIGN))


@F.pandas_udf(DoubleType())
def _value(image: pd.Series) -> pd.Series:
    bits = image.to_numpy(dtype=np.int64)
    return pd.Series(np.where(bits < 0, bits ^ _SIGN, ~bits).view(np.float64))


def _same(columns: list[str], other: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{other}{c}")) for c in columns])


def long_quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: list[float],
) -> DataFrame:
    """The same for few, long groups; the values must be non-null. NaN counts as the largest value.

    Radix selection: a wanted rank is followed through the digits of 16 bits of the values' images. Each of four passes
    counts the values with the known leading digits by their next digit, at most 65,536 numbers, adds the counts up, and so finds
    the digit in which the rank falls.
    """
    values = materialise(df.select(*keys, _image(F.col(value).cast("double")).alias("_b")), "images")
    state = None
    for shift in range(64 - _DIGIT, -1, -_DIGIT):
        digit = F.shiftrightunsigned("_b", shift).bitwiseAND(F.lit((1 << _DIGIT) - 1)).alias("_digit")
        if state is None:
            held = values.select(*keys, F.lit(0).cast("long").alias("_prefix"), digit)
        else:
            known = materialise(state.select(*keys, "_prefix").distinct(), "prefixes")
            known = known.toDF(*[f"_known{c}" for c in known.columns])
            leading = values.withColumn("_prefix", F.shiftrightunsigned("_b", shift + _DIGIT))
            held = join_small(leading, known, _same([*keys, "_prefix"], "_known"), "left_semi").select(*keys, "_prefix", digit)
        counts = held.groupBy(*keys, "_prefix", "_digit").agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(W.partitionBy(*keys, "_prefix").orderBy("_digit").rowsBetween(W.unboundedPreceding, W.currentRow))
        counts = materialise(counts.withColumn("_upto", upto), "digit-counts")
        if state is None:
            sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("n"))
            places = [F.lit(float(p)) * (F.col("n") - F.lit(1)) for p in probabilities]
            ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)]))
            state = sizes.select(*keys, "n", F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_below"))
        state = materialise(state, "ranks")
        other = counts.toDF(*[f"_of{c}" for c in counts.columns])
        inside = F.col("_rank") - F.col("_below")
        falls = (F.col("_of_upto") - F.col("_of_c") <= inside) & (inside < F.col("_of_upto"))
        met = join_small(other, state, _same([*keys, "_prefix"], "_of"), "inner").where(falls)
        state = materialise(met.select(
            *keys, "n", "_rank", F.shiftleft("_prefix", _DIGIT).bitwiseOR(F.col("_of_digit")).alias("_prefix"),
            (F.col("_below") + F.col("_of_upto") - F.col("_of_c")).alias("_below")), "ranks")
    found = state.select(*keys, "n", "_rank", _value("_prefix").alias("_x"))
    found = found.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))
    low, high = ([F.col("_at")[f(p).cast("long")] for p in places] for f in (F.floor, F.ceil))
    share = [p - F.floor(p) for p in places]
    return found.select(*keys, "n", F.array(*[F.when(lo == hi, lo).otherwise(lo * (F.lit(1.0) - s) + hi * s)
                                              for lo, hi, s in zip(low, high, share)]).alias("quantiles"))


def run_medians(runs: DataFrame, keys: list[str], values: str) -> DataFrame:
    """``keys``, ``n`` and the exact ``median`` of finite values that come in ascending lists, any number of them per group.

    Each list passes on some of its values with their places, all of them if they are few. From these follow a lower and an upper
    bound of the two middle values; what lies between is some hundredth of the values, or nothing. Groups that still have some there
    take another round between their bounds. A group without values gives no row.
    """
    fields = [runs.schema[k] for k in keys]
    sent = StructType([*fields, StructField("_n", LongType()), StructField("_v", NUMBERS), StructField("_lt", LONGS), StructField("_le", LONGS)])
    told = StructType([*fields, StructField("n", LongType()), StructField("_done", BooleanType()), StructField("_low", DoubleType()), StructField("_high", DoubleType())])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            x, begin = lists(table[values])
            low, high = (table[c].to_numpy() if c in table.column_names else None for c in ("_low", "_high"))
            places = [_places(x[a:b], None if low is None else (low[i], high[i])) for i, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist()))]
            v, lt, le = (np.concatenate([p[c] for p in places]) if places else np.zeros(0) for c in range(3))
            bounds = np.concatenate([[0], np.cumsum([len(p[0]) for p in places], dtype=np.int64)])
            out = table.select(keys).append_column("_n", pa.array(np.diff(begin)))
            for name, column in (("_v", v), ("_lt", lt.astype(np.int64)), ("_le", le.astype(np.int64))):
                out = out.append_column(name, pack(column, bounds))
            yield from out.to_batches()

    def narrow(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        n = np.add.reduceat(table["_n"].to_numpy(), bounds[:-1])
        done, low, high = _brackets(n, lists(table["_v"])[0], lists(table["_lt"])[0], lists(table["_le"])[0], starts(table["_v"]), bounds)
        out = table.select(keys).take(pa.array(bounds[:-1])).append_column("n", pa.array(n))
        for name, column in (("_done", done), ("_low", low), ("_high", high)):
            out = out.append_column(name, pa.array(column))
        return out.filter(pa.array(n > 0))

    found, met = [], runs.select(*keys, values)
    while True:
        told_now = write_tiles(map_groups(met.mapInArrow(sample, sent), keys, "_n", told, narrow), "brackets")
        found.append(told_now.where("_done"))
        open_ = told_now.where("not _done")
        if open_.isEmpty():
            break
        met = join_small(runs.select(*keys, values), open_.select(*keys, "_low", "_high"), keys, "inner")
    median = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") * F.lit(0.5) + F.col("_high") * F.lit(0.5))
    return reduce(lambda a, b: a.unionByName(b), found).select(*keys, "n", median.alias("median"))


def _places(x: np.ndarray, between: tuple[float, float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some of the values between the bounds, and the bounds themselves: how many values stand before each, and up to it."""
    a, b = (0, len(x)) if between is None else (int(np.searchsorted(x, between[0], "right")), int(np.searchsorted(x, between[1], "left")))
    at = np.arange(a, b) if b - a <= _SAMPLES else np.linspace(a, b - 1, _SAMPLES).astype(np.int64)
    if between is None:
        return x[at], at, at + 1
    first, last = int(np.searchsorted(x, between[0], "left")), int(np.searchsorted(x, between[1], "right"))
    return np.concatenate([[between[0]], x[at], [between[1]]]), np.concatenate([[first], at, [b]]), np.concatenate([[a], at + 1, [last]])


def _brackets(n, v, lt, le, begin, bounds):
    """Of each group: whether its middle values are known, and the bounds of both, from the places of the runs' samples.

    Between two samples of a run at least as many values stand as up to the first and at most as many as before the second. Summed
    over the runs these are bounds of a value's place in the group.
    """
    size = np.diff(begin)
    run, last = np.repeat(np.arange(len(size)), size), begin[1:] - 1
    full = size > 0
    before = np.empty_like(le)  # up to the sample before, in the same run
    before[1:] = le[:-1]
    before[begin[:-1][full]] = lt[begin[:-1][full]]
    behind = np.empty_like(lt)  # before the next sample, in the same run
    behind[:-1] = lt[1:]
    behind[last[full]] = le[last[full]]
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    base = np.bincount(group[full], weights=lt[begin[:-1][full]], minlength=len(n))
    unsure = np.bincount(group[run], weights=behind - le, minlength=len(n)) > 0
    of = group[run]
    order = np.lexsort((v, of))
    of, v, upto, less = of[order], v[order], (le - before)[order], (behind - lt)[order]
    head = np.searchsorted(of, np.arange(len(n)))  # of each group
    tail = np.append(head[1:], len(of))
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    same_first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (of[1:] != of[:-1]))) if len(v) else np.zeros(0, int)
    number = np.repeat(np.arange(len(same_first)), np.diff(np.append(same_first, len(v))))
    same_end = np.append(same_first[1:], len(v))[number] if len(v) else same_first
    upto_sum, less_sum = sums(upto), sums(less)
    most_before = base[of] + less_sum[same_first[number]] - less_sum[head[of]]
    least_upto = base[of] + upto_sum[same_end] - upto_sum[head[of]]
    low_rank, high_rank = (n - 1) // 2, n // 2
    low, high = np.full(len(n), np.nan), np.full(len(n), np.nan)
    for i in np.flatnonzero(tail > head).tolist():
        a, b = head[i], tail[i]
        low[i] = v[a + np.searchsorted(most_before[a:b], low_rank[i], "right") - 1]
        high[i] = v[a + np.searchsorted(least_upto[a:b], high_rank[i] + 1, "left")]
    return ~unsure | (low == high), low, high
