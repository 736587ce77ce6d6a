"""Peaks of a signal along each series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators.blocks import BLOCK, Ordered, following, last_seen, next_seen, previous
from driftline.operators.per_series import Maker, add_columns, add_columns_by_block, floats, map_groups, to_arrow
from driftline.session import join_small, materialise, rows_per_block


def local_maxima(series: Ordered, heights: dict[str, str]) -> Ordered:
    """Mark strict local maxima: height column to flag column.

    A flat top counts once, at the floor of its middle. Missing heights count as 0. The first
    and last row are never peaks.
    """
    names = list(heights.values())
    held = [f"_h_{n}" for n in names]
    out = series.with_columns({
        f"_h_{n}": F.coalesce(F.col(h), F.lit(0.0)) for h, n in heights.items()})
    out = out.extend(_left=previous(*held), _right=following(*held))
    ends = {}
    for n in names:  # a run of equal heights knows its ends and the heights beyond them
        here = F.col(f"_h_{n}")
        for side, beyond in (("start", F.col(f"_left._h_{n}")), ("end", F.col(f"_right._h_{n}"))):
            edge = beyond.isNull() | (beyond != here)
            ends[f"_{side}_{n}"] = F.when(edge, F.struct(F.col("k").alias("k"), beyond.alias("beyond")))
    out = out.with_columns(ends).drop("_left", "_right")
    out = out.extend(
        **{f"_first_{n}": last_seen(F.col(f"_start_{n}")) for n in names},
        **{f"_last_{n}": next_seen(F.col(f"_end_{n}")) for n in names})
    peaks = {}
    for n in names:
        here = F.col(f"_h_{n}")
        peak = ((here > F.col(f"_first_{n}.beyond")) & (here > F.col(f"_last_{n}.beyond"))
                & (F.col("k") == F.expr(f"(`_first_{n}`.k + `_last_{n}`.k) div 2")))
        peaks[n] = F.coalesce(peak, F.lit(False))
    return out.with_columns(peaks).drop(
        *held, *ends, *[f"_{c}_{n}" for c in ("first", "last") for n in names])


def keep_distant(k, height, candidate, distance):
    """Highest first, drop candidates nearer than ``distance`` samples to a kept one.

    Of equal heights the later one goes first.
    """
    at = np.flatnonzero(candidate > 0)
    kept = np.zeros(len(k), dtype=bool)
    if len(at) == 0:
        return kept
    kept[at] = True
    gap = distance[at[0]]
    if not gap > 1:
        return kept
    places = k[at]
    for i in np.lexsort((places, height[at]))[::-1]:
        if kept[at[i]]:
            lo = np.searchsorted(places, places[i] - gap, side="right")
            hi = np.searchsorted(places, places[i] + gap, side="left")
            kept[at[lo:hi]] = False
            kept[at[i]] = True
    return kept


def maxima(heights):
    """Strict local maxima of one whole series; a flat top counts once, at the floor of its middle."""
    first = np.flatnonzero(np.append(True, heights[1:] != heights[:-1])) if len(heights) else np.zeros(0, int)
    last = np.append(first[1:], len(heights)) - 1
    level = heights[first]
    top = np.zeros(len(first), bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    out = np.zeros(len(heights), bool)
    out[(first[top] + last[top]) // 2] = True
    return out


def suppress_near(series: Ordered, peaks: list[tuple[str, str, str]], distance: str) -> Ordered:
    """Add kept flags: each entry is (candidate column, height column, output column).

    Short series pass through Python whole. The windows before have them in place already, so
    that is cheaper than shuffling all rows once more to join the few flags back.
    """
    makers = [
        Maker(("k", height, candidate, distance), {out: "boolean"},
              lambda *arrays: (keep_distant(*arrays),))
        for candidate, height, out in peaks]
    keys = list(series.keys)

    def long(rows: DataFrame) -> DataFrame:
        rows = materialise(rows, "suppress")
        out = rows
        for candidate, height, kept_name in peaks:
            kept = _keep_long(rows, keys, candidate, height, distance).withColumn(kept_name, F.lit(True))
            out = out.join(kept, [*keys, "k"], "left").withColumn(kept_name, F.coalesce(kept_name, F.lit(False)))
        return out

    return series.map(lambda rows: add_columns(rows, keys, series.order, makers), long)


_OPEN, _KEPT, _DROPPED = 0, 1, -1


def _keep_long(
    rows: DataFrame, keys: list[str], candidate: str, height: str, distance: str,
) -> DataFrame:
    """Keys and ``k`` of the kept candidates of the long series.

    Tiles of consecutive samples decide side by side. A tile leaves open what depends on an
    open candidate of another tile, and looks again once that one is decided; the highest open
    candidate is always decidable, so this ends.
    """
    gap = F.greatest(F.coalesce(F.col(distance), F.lit(1)), F.lit(1))
    width = F.greatest(F.lit(rows_per_block(rows.sparkSession)), F.col("_gap"))
    state = materialise(
        rows.where(F.col(candidate)).select(
            *keys, "k", F.col(height).alias("_h"), gap.cast("bigint").alias("_gap"))
        .withColumns({"_width": width.cast("bigint"), "_state": F.lit(_OPEN).cast("bigint")}), "candidates")
    fields = [state.schema[c] for c in state.columns]

    def decide(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        k, height, gap, tile = table["k"].to_numpy(), floats(table["_h"]), table["_gap"].to_numpy(), table["_tile"].to_numpy()
        own, states = k // table["_width"].to_numpy() == tile, np.array(table["_state"].to_numpy())
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            states[a:b] = decide_tile(k[a:b], height[a:b], gap[a], states[a:b], own[a:b])
        out = table.select([f.name for f in fields])
        at = out.schema.get_field_index("_state")
        return out.set_column(at, "_state", pa.array(states)).filter(pa.array(own & (states != _DROPPED)))

    while not state.where(F.col("_state") == _OPEN).isEmpty():
        reach = F.sequence(F.expr("greatest(k - _gap, 0) div _width"), F.expr("(k + _gap) div _width"))
        placed = state.withColumn("_tile", F.explode(reach))
        state = materialise(map_groups(placed, [*keys, "_tile"], "k", T.StructType(fields), decide), "decided")
    return state.select(*keys, "k")


def decide_tile(k, height, gap, state, own):
    """New states of one tile's candidates and their neighbours in other tiles."""
    state = state.copy()
    starts, stops = np.searchsorted(k, k - gap, side="right"), np.searchsorted(k, k + gap, side="left")
    falling = np.lexsort((k, height))[::-1]
    for i in falling[state[falling] == _OPEN].tolist():
        near = slice(starts[i], stops[i])
        if (state[near] == _KEPT).any():
            state[i] = _DROPPED
            continue
        higher = (height[near] > height[i]) | ((height[near] == height[i]) & (k[near] > k[i]))
        if own[i] and not (higher & (state[near] == _OPEN)).any():
            state[i] = _KEPT
    return state


# -- prominence ---------------------------------------------------------------------------


def with_prominence(series: Ordered, height: str, name: str = "prominence") -> Ordered:
    """Add each row's height above the higher of its two bases.

    A base is the lowest sample between the row and the nearest strictly higher one, or the
    series' end, on that side. Missing heights count as 0. Meant for rows that are peaks.
    """
    out = series.with_columns({"_h": F.coalesce(F.col(height), F.lit(0.0))})
    maker = Maker(("_h",), {name: "double"}, lambda h: (prominences(h),))
    keys = list(series.keys)
    return out.map(lambda rows: add_columns(rows, keys, series.order, [maker]),
                   lambda rows: _prominence_long(materialise(rows, "prominence"), keys, series.order, name)).drop("_h")


def prominences(h):
    left, _ = bases(h)
    right, _ = bases(h[::-1])
    return h - np.maximum(left, right[::-1])


def bases(h):
    """Lowest value back to the nearest higher one, and whether there is none."""
    low, open_end = np.empty(len(h)), np.zeros(len(h), dtype=bool)
    higher: list[tuple[float, float]] = []  # falling heights, each with the lowest value up to it
    for i, value in enumerate(h.tolist()):
        least = value
        while higher and higher[-1][0] <= value:
            least = min(least, higher.pop()[1])
        low[i], open_end[i] = least, not higher
        higher.append((value, least))
    return low, open_end


def _prominence_long(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Bases inside each block first; a row without a higher one there asks the nearest block
    whose maximum is higher, passing over the blocks between by their minima."""

    def local(h):
        left, left_open = bases(h)
        right, right_open = bases(h[::-1])
        return left, left_open, right[::-1], right_open[::-1]

    maker = Maker(("_h",), {"_low_l": "double", "_open_l": "boolean", "_low_r": "double",
                            "_open_r": "boolean"}, local)
    found = materialise(add_columns_by_block(rows, [*keys, BLOCK], order, [maker]), "bases")
    blocks = rows.groupBy(*keys, BLOCK).agg(F.max("_h").alias("top"), F.min("_h").alias("low"))
    lists = materialise(blocks.groupBy(*keys).agg(
        F.collect_list(F.struct(F.col(BLOCK).alias("at"), "top", "low")).alias("_blocks")), "block-extremes")
    asks = []
    for side, nearest, sign in (("l", F.array_max, -1), ("r", F.array_min, 1)):
        opened = found.where(F.col(f"_open_{side}")).select(*keys, BLOCK, order, F.col("_h").alias("_peak"))
        beyond = lambda b_: (b_["at"] - F.col(BLOCK)) * F.lit(sign) > 0  # noqa: B023, E731
        listed = join_small(opened, lists, keys, "inner").withColumn("_target", nearest(F.transform(
            F.filter("_blocks", lambda b_: beyond(b_) & (b_["top"] > F.col("_peak"))), lambda b_: b_["at"])))
        passed = F.filter("_blocks", lambda b_: beyond(b_) & (
            F.col("_target").isNull() | ((F.col("_target") - b_["at"]) * F.lit(sign) > 0)))
        asks.append(listed.select(
            *keys, order, "_peak", "_target", F.lit(sign).cast("bigint").alias("_sign"),
            F.array_min(F.transform(passed, lambda b_: b_["low"])).alias("_passed")))
    asks = materialise(asks[0].unionByName(asks[1]), "base-asks")
    fields = [rows.schema[c] for c in keys]
    schema = T.StructType([*fields, rows.schema[order], T.StructField("_sign", T.LongType()),
                           T.StructField("_part", T.DoubleType())])

    def answer(asked: pa.Table, block: pa.Table) -> pa.Table:
        h = floats(block.sort_by(order)["_h"])
        peak, sign = floats(asked["_peak"]), asked["_sign"].to_numpy()
        part = np.where(sign < 0, nearest_base(h[::-1], peak), nearest_base(h, peak))
        return asked.select([*keys, order, "_sign"]).append_column("_part", to_arrow(part, "double"))

    by_target = asks.where(F.col("_target").isNotNull()).groupBy(*keys, "_target")
    held = rows.select(*keys, F.col(BLOCK).alias("_target"), order, "_h").join(
        asks.select(*keys, "_target").distinct(), [*keys, "_target"], "left_semi")
    parts = by_target.cogroup(held.groupBy(*keys, "_target")).applyInArrow(answer, schema)
    outside = asks.select(*keys, order, "_sign", F.col("_passed").alias("_part")).unionByName(parts)
    sides = outside.groupBy(*keys, order).agg(
        F.min(F.when(F.col("_sign") < 0, F.col("_part"))).alias("_out_l"),
        F.min(F.when(F.col("_sign") > 0, F.col("_part"))).alias("_out_r"))
    merged = found.join(sides, [*keys, order], "left")
    base = F.greatest(F.least("_low_l", "_out_l"), F.least("_low_r", "_out_r"))
    return merged.withColumn(name, F.col("_h") - base).drop(
        "_low_l", "_open_l", "_low_r", "_open_r", "_out_l", "_out_r")


def nearest_base(h, peaks):
    """Lowest of ``h`` before its first value above each peak; NaN if that is the first."""
    tops, lows = np.maximum.accumulate(h), np.minimum.accumulate(h)
    first = np.searchsorted(tops, peaks, side="right")
    return np.where(first > 0, lows[np.maximum(first - 1, 0)], np.nan)
