"""Robust local linear smoothing (Cleveland 1979) of each series.

A series in one block is smoothed in one call. Longer ones are cut into tiles, each one packed
row (``tiles``). The neighbours of a tile's rows are found in the tiles that hold them, and the weighted sums of a fit are
added up tile by tile, so that a task holds the tiles of an Arrow batch at most, however many neighbours a fit has.

Where fits have many neighbours the sums come from moments of nested halves (``moments``), about two per level, so that the work grows with
the rows and not with rows times neighbours. Between the tiles with the ends of a row's neighbours whole tiles count by their moments.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.values import is_finite
from driftline.operators.blocks import BLOCK, Ordered
from driftline.operators.moments import Nodes, Tree, points, whole
from driftline.operators.per_series import Maker, add_columns, floats
from driftline.operators.quantiles import run_medians
from driftline.operators.tiles import LONGS, NUMBERS, lists, meet, pack, pack_blocks, ranges, tile, write_tiles
from driftline.session import join_small, materialise, rows_per_block

ROBUST_PASSES = 3
_CELLS = 1_000_000  # weights held at once
MANY_NEIGHBOURS = 512  # from here on sums come from moments
_TILE_ROWS = 65_536
_SUMS = ("sw", "su", "suu", "sy", "suy")


def neighbours(n: int, frac: float) -> int:
    """How many nearest rows a fit uses: the share ``frac``, but two where there are two."""
    return min(n, max(2, int(frac * n + 1e-10)))


def smooth(series: Ordered, columns: dict[str, tuple[str, float]], at: str = "elapsed_days",
           passes: int = ROBUST_PASSES, also: list[Maker] = ()) -> Ordered:
    """Add smoothed columns: output name to (value, frac). Missing values stay missing.

    ``also`` are further makers to run in the same pass.
    """
    makers = [smooth_maker(out, value, at, frac, passes) for out, (value, frac) in columns.items()]
    keys = list(series.keys)

    def long(rows: DataFrame) -> DataFrame:
        if also:
            raise ValueError("further makers cannot run on the blocks of a long series")
        done = rows = materialise(rows, "smooth")
        fits = _smooth_long(series, rows, list(columns.values()), at, passes)
        for number, out in enumerate(columns):
            of = fits.where(F.col("_column") == number).drop("_column").withColumnRenamed("_fit", out)
            done = done.join(of, [*keys, series.order], "left")
        return done

    return series.map(lambda rows: add_columns(rows, keys, series.order, [*makers, *also]), long)


def smooth_maker(out: str, value: str, at: str, frac: float, passes: int = ROBUST_PASSES) -> Maker:
    return Maker((at, value), {out: "double"}, lambda t, y: (smooth_array(t, y, frac, passes),))


def smooth_array(t, y, frac, passes=ROBUST_PASSES):
    """The smoothed values of one series in time order."""
    ok = np.isfinite(t) & np.isfinite(y)
    out = np.full(len(t), np.nan)
    n = int(ok.sum())
    if n == 0:
        return out
    t, y = t[ok], y[ok]
    k = neighbours(n, frac)
    if k <= 2 and (np.diff(t) > 0).all():
        out[ok] = y  # the farther of two neighbours weighs nothing
        return out
    first = first_neighbours(t, k)
    if k >= MANY_NEIGHBOURS:
        fits = lambda weights: moment_fits(t, y, weights, first, k)
    else:
        rows = max(1, _CELLS // k)
        spans = [slice(a, a + rows) for a in range(0, n, rows)]
        shapes = [neighbourhood(t, first, k, spans[0])] if len(spans) == 1 else None
        fits = lambda weights: local_fits(t, y, weights, first, k, spans, shapes)
    weights = np.ones(n)
    fit = fits(weights)
    for _ in range(passes):
        left = np.abs(y - fit)
        middle = np.median(left)
        if not middle > 0:
            break  # all weights stay 1
        weights = bisquare(left, middle)
        fit = fits(weights)
    out[ok] = fit
    return out


def first_neighbours(t, k):
    """Start of the ``k`` nearest rows of every row; an equidistant pair gives the earlier one."""
    sums = t[:len(t) - k] + t[k:]  # the window moves on while its far end is nearer
    return np.searchsorted(sums, 2.0 * t, side="left")


def bisquare(left, median):
    """Robustness weights from absolute residuals; all 1 when the median is 0."""
    if not median > 0:
        return np.ones(len(left))
    u = left / (6.0 * median)
    return np.where(u < 1.0, (1.0 - u * u) ** 2, 0.0)


def neighbourhood(t, first, k, at):
    """Neighbour positions, scaled distances and tricube weights of the rows ``at``."""
    near = first[at, None] + np.arange(k)
    u = t[near] - t[at, None]
    reach = np.maximum(np.abs(u[:, 0]), np.abs(u[:, -1]))
    u /= np.where(reach > 0, reach, 1.0)[:, None]
    return near, u, tricube(u)


def tricube(u):
    a = np.minimum(np.abs(u), 1.0)
    b = 1.0 - a * a * a
    return b * b * b


def local_fits(t, y, weights, first, k, spans, shapes=None):
    fit = np.empty(len(t))
    for i, at in enumerate(spans):
        near, u, shape = shapes[i] if shapes else neighbourhood(t, first, k, at)
        w = shape * weights[near]
        wu, seen = w * u, y[near]
        total = lambda a, b: np.einsum("ij,ij->i", a, b)
        fit[at] = solve(w.sum(1), wu.sum(1), total(wu, u), total(w, seen), total(wu, seen), y[at])
    return fit


def moment_fits(t, y, weights, first, k):
    """The same fits from a tree of moments."""
    reach = np.maximum(t - t[first], t[first + k - 1] - t)
    return solve(*Tree(points(t, y, weights)).around(first, first + k, t, reach), y)


def solve(sw, su, suu, sy, suy, own):
    """Fitted value at distance 0 from weighted sums over scaled distances.

    Without spread in time the weighted mean; without any weight the row's own value.
    """
    some = sw > 0
    total = np.where(some, sw, 1.0)
    mean_u, mean_y = su / total, sy / total
    spread = suu / total - mean_u * mean_u
    tilt = suy / total - mean_u * mean_y
    slope = np.where(spread > 1e-12, tilt / np.where(spread > 1e-12, spread, 1.0), 0.0)
    return np.where(some, mean_y - slope * mean_u, own)


# -- series of several blocks -------------------------------------------------------------


def _smooth_long(series: Ordered, rows: DataFrame, columns: list[tuple[str, float]], at: str, passes: int) -> DataFrame:
    """Keys, the number ``_column`` of the (value, frac), order column and ``_fit`` of the long series.

    All columns go through the same steps side by side, each series of each column for itself.
    """
    keys, order = [*series.keys, "_column"], series.order
    width = min(rows_per_block(rows.sparkSession), _TILE_ROWS)
    known = reduce(DataFrame.unionByName, [
        rows.where(is_finite(F.col(value))).select(
            *series.keys, F.lit(number).alias("_column"), BLOCK, order, F.col(at).alias("_t"), F.col(value).alias("_y"))
        for number, (value, _) in enumerate(columns)])
    blocks = write_tiles(pack_blocks(known, keys, order, ["_t", "_y"]), "smooth-blocks")
    sizes = materialise(blocks.groupBy(*keys).agg(F.sum("_len").alias("_n")), "sizes")
    frac = F.array(*[F.lit(float(frac)) for _, frac in columns])[F.col("_column")]
    share = F.floor(frac * F.col("_n") + F.lit(1e-10))
    tiles = join_small(tile(blocks, keys, [order, "_t", "_y"], width), sizes, keys, "inner").withColumn(
        "_k", F.least(F.col("_n"), F.greatest(F.lit(2), share)).cast("bigint")).drop("_n")
    base = write_tiles(tiles, "smooth-base")
    state = _reaches(base, keys, width)
    pairs = materialise(state.select(*keys, F.col("_tile").alias("_own"), F.explode("_ends").alias("_tile")), "tile-pairs")
    between = F.filter(F.sequence("_from", "_to"), lambda x_: x_ != F.col("_tile"))
    between = materialise(state.select(*keys, F.col("_tile").alias("_own"), F.explode(between).alias("_tile")).join(
        pairs, [*keys, "_own", "_tile"], "left_anti"), "tiles-between")  # those in pairs are added up row by row
    state = state.drop("_ends", "_from", "_to")
    weighed = state.withColumns({"_left": F.lit(None).cast(NUMBERS), "_median": F.lit(None).cast("double")})
    for turn in range(passes + 1):
        fits = write_tiles(_one_pass(weighed, pairs, between, keys, width), "fits")
        if turn == passes:
            break
        medians = materialise(run_medians(fits, keys, "_sorted").drop("n").withColumnRenamed("median", "_median"), "medians")
        left = F.transform(F.arrays_zip("_y", "_fit"), lambda x_: F.abs(x_["_y"] - x_["_fit"]))
        weighed = join_small(fits.withColumn("_left", left).drop("_fit", "_sorted"), medians, keys, "left")
    both = base.select(*keys, "_tile", order).join(fits.select(*keys, "_tile", "_fit", "_h"), [*keys, "_tile"])
    both = both.select(*keys, F.explode(F.arrays_zip(order, "_fit", "_h")).alias("_x")).where(~F.isnan("_x._h"))
    return both.select(*keys, f"_x.{order}", "_x._fit")


def _reaches(base: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Each tile's rows with the first neighbour ``_first`` of each and the farthest distance ``_h``; ``_ends`` are the tiles that hold
    an end of the neighbours or the row itself, and ``_from`` to ``_to`` those from the first neighbour to the last one.

    Of rows at one time the last one is fitted for all; the others have no distance (NaN) and no weight in the robust passes.

    The neighbours of a row start where ``t[j] + t[j + k]`` first reaches twice its time; both grow along the series, so counting
    the smaller sums gives the start. A tile's sums need the times of the tiles ``k`` rows on, and its rows only the sums of
    the tiles between its first time and its last one.
    """
    own = F.col("_tile").alias("_own")
    key_fields = [base.schema[k] for k in keys]
    on = F.explode(F.array(*[F.expr(f"_tile - _k div {width} - {i}") for i in (0, 1)])).alias("_own")
    asks = base.select(*keys, own, "_tile", "_i0", "_k", "_t")
    schema = T.StructType([*key_fields, T.StructField("_tile", T.LongType()), T.StructField("_s", NUMBERS), T.StructField("_low", T.DoubleType())])

    def add_far(far: np.ndarray, own: pa.Table, begin: np.ndarray, near: pa.Table, of: np.ndarray) -> None:
        times, at = lists(near["_t"])
        i0, k = own["_i0"].to_numpy()[of], own["_k"].to_numpy()[of]
        first = near["_i0"].to_numpy() - k  # whose far time is the near tile's first
        low, high = np.maximum(i0, first), np.minimum(i0 + np.diff(begin)[of], first + np.diff(at))
        size = np.maximum(high - low, 0)
        place = ranges(begin[:-1][of] + low - i0, size)
        far[0][place], far[1][place] = times[ranges(at[:-1] + low - first, size)], 1.0

    def sums(own: pa.Table, begin: np.ndarray, far: np.ndarray) -> pa.Table:
        there = far[1] > 0
        found = lists(own["_t"])[0][there] + far[0][there]
        bounds = np.concatenate([[0], np.cumsum(there)])[begin]
        some = np.diff(bounds) > 0
        out = own.select([*keys, "_tile"]).append_column("_s", pack(found, bounds)).filter(pa.array(some))
        return out.append_column("_low", pa.array(found[bounds[:-1][some]]))

    near = base.select(*keys, on, "_tile", "_i0", "_t").where("_own >= 0")
    steps = write_tiles(meet(asks, [near], keys, "_t", 2, schema, add_far, sums), "reach-sums")

    # The tiles of sums that hold the place of a tile's first and last row: the last ones whose smallest sum is less.
    events = steps.select(*keys, F.col("_low").alias("_at"), F.lit(1).alias("_sum"), F.col("_tile").alias("_number"), F.lit(None).cast("bigint").alias("_own"))
    for side, time in ((0, F.col("_t")[0]), (2, F.element_at("_t", -1))):
        events = events.unionByName(base.select(*keys, (F.lit(2.0) * time).alias("_at"), F.lit(0).alias("_sum"), F.lit(None).cast("bigint").alias("_number"), own))
    upto = F.max("_number").over(W.partitionBy(*keys).orderBy("_at", "_sum").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = events.withColumn("_upto", upto).where(F.col("_own").isNotNull()).groupBy(*keys, "_own").agg(
        F.min(F.coalesce("_upto", F.lit(-1))).alias("_begin"), F.max("_upto").alias("_stop"))
    behind = base.select(*keys, own, F.lead(F.col("_t")[0]).over(W.partitionBy(*keys).orderBy("_tile")).alias("_next"))
    found = materialise(found.join(behind, [*keys, "_own"]), "reach-tiles")
    wanted = found.where(F.col("_stop").isNotNull()).select(
        *keys, "_own", F.explode(F.sequence(F.greatest("_begin", F.lit(0)), "_stop")).alias("_tile"))
    near = steps.select(*keys, "_tile", "_s").join(wanted, [*keys, "_tile"])
    asks = base.select(*keys, own, "_tile", "_i0", "_k", "_t", "_y").join(found.select(*keys, "_own", "_begin", "_next"), [*keys, "_own"])
    schema = T.StructType([*key_fields, *[T.StructField(c, T.LongType()) for c in ("_tile", "_i0", "_k")], T.StructField("_t", NUMBERS), T.StructField("_y", NUMBERS),
                           T.StructField("_first", LONGS), T.StructField("_ends", LONGS), T.StructField("_from", T.LongType()), T.StructField("_to", T.LongType()), T.StructField("_next", T.DoubleType())])

    def add_smaller(smaller: np.ndarray, own: pa.Table, begin: np.ndarray, near: pa.Table, of: np.ndarray) -> None:
        twice, (found, at) = 2.0 * lists(own["_t"])[0], lists(near["_s"])
        for i, a, b in zip(of.tolist(), at[:-1].tolist(), at[1:].tolist()):
            rows = slice(begin[i], begin[i + 1])
            smaller[0, rows] += np.searchsorted(found[a:b], twice[rows], side="left")

    def first_rows(own: pa.Table, begin: np.ndarray, smaller: np.ndarray) -> pa.Table:
        row = np.repeat(np.arange(own.num_rows), np.diff(begin))
        first = (np.maximum(own["_begin"].to_numpy(), 0) * width)[row] + smaller[0].astype(np.int64)
        low, high = first // width, (first + own["_k"].to_numpy()[row] - 1) // width
        ends = np.unique(np.stack([np.tile(row, 3), np.concatenate([low, own["_tile"].to_numpy()[row], high])]), axis=1)
        out = own.select([*keys, "_tile", "_i0", "_k", "_t", "_y"]).append_column("_first", pack(first, begin))
        out = out.append_column("_ends", pack(ends[1], np.searchsorted(ends[0], np.arange(own.num_rows + 1))))
        return out.append_column("_from", pa.array(np.minimum.reduceat(low, begin[:-1]))).append_column(
            "_to", pa.array(np.maximum.reduceat(high, begin[:-1]))).append_column("_next", own["_next"])

    firsts = write_tiles(meet(asks, [near], keys, "_t", 1, schema, add_smaller, first_rows), "reach-firsts")
    pairs = firsts.select(*keys, F.col("_tile").alias("_own"), F.explode("_ends").alias("_tile"))
    near = base.select(*keys, "_tile", "_i0", "_t").join(pairs, [*keys, "_tile"])

    def add_ends(times: np.ndarray, own: pa.Table, begin: np.ndarray, near: pa.Table, of: np.ndarray) -> None:
        t, at = lists(near["_t"])
        first, k, i0 = lists(own["_first"])[0], own["_k"].to_numpy(), near["_i0"].to_numpy()
        size = np.diff(begin)[of]
        place, pair = ranges(begin[:-1][of], size), np.repeat(np.arange(len(of)), size)
        for side, wanted in enumerate((first[place], first[place] + k[of][pair] - 1)):
            inside = (wanted >= i0[pair]) & (wanted < (i0 + np.diff(at))[pair])
            times[side, place[inside]] = t[at[:-1][pair[inside]] + wanted[inside] - i0[pair[inside]]]

    def distances(own: pa.Table, begin: np.ndarray, times: np.ndarray) -> pa.Table:
        t = lists(own["_t"])[0]
        later = np.append(t[1:], np.nan)
        later[begin[1:] - 1] = floats(own["_next"])
        reach = np.where(t == later, np.nan, np.maximum(t - times[0], times[1] - t))
        return own.select(names).append_column("_h", pack(reach, begin))

    names = [c for c in firsts.columns if c != "_next"]
    schema = T.StructType([*[firsts.schema[c] for c in names], T.StructField("_h", NUMBERS)])
    return write_tiles(meet(firsts.withColumn("_own", F.col("_tile")), [near], keys, "_t", 2, schema, add_ends, distances), "smooth-targets")


def _one_pass(weighed: DataFrame, pairs: DataFrame, between: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The tiles' rows with ``_fit``, and the absolute residuals ``_sorted``."""
    asks = weighed.drop("_left", "_median").withColumn("_own", F.col("_tile"))
    near = weighed.select(*keys, "_tile", "_i0", "_t", "_y", "_left", "_median").join(pairs, [*keys, "_tile"])
    met = [near]
    if not between.isEmpty():
        inner = weighed.join(between.select(*keys, "_tile").distinct(), [*keys, "_tile"], "left_semi")
        met.append(_tile_moments(inner, keys).join(between, [*keys, "_tile"]))
    names = [*keys, "_tile", "_i0", "_k", "_t", "_y", "_first", "_h"]
    schema = T.StructType([*[weighed.schema[c] for c in names], T.StructField("_fit", NUMBERS), T.StructField("_sorted", NUMBERS)])

    def add_sums(sums: np.ndarray, own: pa.Table, begin: np.ndarray, near: pa.Table, of: np.ndarray) -> None:
        t, first, reach = (lists(own[c])[0] for c in ("_t", "_first", "_h"))
        k, kind = own["_k"].to_numpy(), near["_kind"].to_numpy()
        rows, row_of = near.filter(pa.array(kind == 1)), of[kind == 1]
        (seen, at), y = lists(rows["_t"]), lists(rows["_y"])[0]
        w, size = tile_weights(rows, at), np.diff(begin)[row_of]
        place, pair = ranges(begin[:-1][row_of], size), np.repeat(np.arange(len(row_of)), size)
        i0, length = rows["_i0"].to_numpy()[pair], np.diff(at)[pair]
        start, stop = (at[:-1][pair] + np.clip(x - i0, 0, length) for x in (first[place], first[place] + k[row_of][pair]))
        many = stop - start >= MANY_NEIGHBOURS
        fitted = np.isfinite(reach[place])
        many, few = many & fitted, ~many & fitted & (stop > start)
        add_ranges(sums, place[few], seen, y, w, t, reach, start[few], stop[few])
        for i in np.unique(pair[many]).tolist():
            chosen, tile_ = many & (pair == i), slice(at[i], at[i + 1])
            sums[:, place[chosen]] += Tree(points(seen[tile_], y[tile_], w[tile_])).around(
                start[chosen] - at[i], stop[chosen] - at[i], t[place[chosen]], reach[place[chosen]])
        if len(of) > len(rows):
            add_between(sums, own, begin, near.filter(pa.array(kind == 2)), of[kind == 2], t, first, reach)

    def add_between(sums, own, begin, tiles, of, t, first, reach) -> None:
        """Whole tiles behind the first neighbour's and before the last one's, but for those that the own tile met by rows."""
        for i in np.unique(of).tolist():
            chosen, rows = tiles.filter(pa.array(of == i)), slice(begin[i], begin[i + 1])
            here, number = own["_tile"][i].as_py(), chosen["_tile"].to_numpy()
            low, high = first[rows] // width + 1, (first[rows] + own["_k"][i].as_py() - 1) // width
            for side, start, stop in ((-1, low, np.minimum(here, high)), (1, np.maximum(low, here + 1), high)):
                part = chosen.filter(pa.array((number < here) if side < 0 else (number > here)))
                if not part.num_rows:
                    continue
                power = lambda c: lists(part[c])[0].reshape(part.num_rows, -1).T  # noqa: B023, E731
                tree = Tree(Nodes(floats(part["_low"]), floats(part["_high"]), power("_mu"), power("_nu")))
                on = part["_tile"].to_numpy()
                reached = np.nan_to_num(reach[rows])  # what rows without a distance add up is not used
                sums[:, rows] += tree.sums(np.searchsorted(on, start), np.searchsorted(on, stop), t[rows], reached, side)

    def fit(own: pa.Table, begin: np.ndarray, sums: np.ndarray) -> pa.Table:
        y = lists(own["_y"])[0]
        some = np.isfinite(lists(own["_h"])[0])
        fitted = np.where(some, solve(*sums, y), np.nan)
        left, of = np.abs(y - fitted)[some], np.repeat(np.arange(own.num_rows), np.diff(begin))[some]
        left = left[np.lexsort((left, of))]
        return own.select(names).append_column("_fit", pack(fitted, begin)).append_column("_sorted", pack(left, np.searchsorted(of, np.arange(own.num_rows + 1))))

    return meet(asks, met, keys, "_t", len(_SUMS), schema, add_sums, fit)


def tile_weights(tiles: pa.Table, begin: np.ndarray) -> np.ndarray:
    """Robustness weights of the tiles' rows, all 1 in the first pass; then 0 for rows without a fit of their own."""
    median = np.repeat(floats(tiles["_median"]), np.diff(begin))
    left = lists(tiles["_left"])[0]
    if not len(left):
        return np.ones(len(median))
    some = median > 0
    u = left / np.where(some, 6.0 * median, 1.0)
    return np.where(some, np.where(u < 1.0, (1.0 - u * u) ** 2, 0.0), np.where(np.isnan(left), 0.0, 1.0))


def _tile_moments(weighed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per tile: its moments as one node."""
    schema = T.StructType([*[weighed.schema[k] for k in keys], weighed.schema["_tile"], T.StructField("_low", T.DoubleType()),
                           T.StructField("_high", T.DoubleType()), T.StructField("_mu", NUMBERS), T.StructField("_nu", NUMBERS)])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            (t, begin), y = lists(table["_t"]), lists(table["_y"])[0]
            w = tile_weights(table, begin)
            nodes = [whole(points(t[a:b], y[a:b], w[a:b])) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
            out = table.select([*keys, "_tile"])
            for name, value in (("_low", [n.low[0] for n in nodes]), ("_high", [n.high[0] for n in nodes])):
                out = out.append_column(name, pa.array(value, pa.float64()))
            for name, value in (("_mu", [n.mu[:, 0].tolist() for n in nodes]), ("_nu", [n.nu[:, 0].tolist() for n in nodes])):
                out = out.append_column(name, pa.array(value, pa.list_(pa.float64())))
            yield from out.to_batches()

    return weighed.select(*keys, "_tile", "_t", "_y", "_left", "_median").mapInArrow(add_up, schema)


def add_ranges(sums, place, t, y, w, own_t, reach, start, stop):
    """Add to ``sums`` at ``place`` those over the rows ``start:stop``, row by row; ``own_t`` and ``reach`` are by place too."""
    size = stop - start
    ends = np.cumsum(size)
    cuts = [0, *(np.searchsorted(ends, np.arange(_CELLS, ends[-1], _CELLS)) + 1).tolist(), len(size)] if len(size) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        near, at = ranges(start[a:b], size[a:b]), np.repeat(place[a:b], size[a:b])
        u = (t[near] - own_t[at]) / np.where(reach[at] > 0, reach[at], 1.0)
        weight = tricube(u) * w[near]
        seen = y[near]
        heads = np.cumsum(size[a:b]) - size[a:b]
        for total, cells in zip(sums, (weight, weight * u, weight * u * u, weight * seen, weight * u * seen), strict=True):
            np.add.at(total, place[a:b], np.add.reduceat(cells, heads))


def range_sums(t, y, w, own_t, reach, start, stop):
    """Weighted sums of each target over its part ``start:stop`` of one tile."""
    out = np.zeros((5, len(own_t)))
    longest = int((stop - start).max(initial=0))
    if longest <= 0:
        return out
    if longest >= MANY_NEIGHBOURS:
        return Tree(points(t, y, w)).around(start, stop, own_t, reach)
    rows = max(1, _CELLS // longest)
    span = np.arange(longest)
    for a in range(0, len(own_t), rows):
        at = slice(a, a + rows)
        near = start[at, None] + span
        inside = near < stop[at, None]
        near = np.minimum(near, len(t) - 1)
        u = (t[near] - own_t[at, None]) / np.where(reach[at] > 0, reach[at], 1.0)[:, None]
        weight = np.where(inside, tricube(u) * w[near], 0.0)
        seen = y[near]
        out[:, at] = (weight.sum(1), (weight * u).sum(1), (weight * u * u).sum(1),
                      (weight * seen).sum(1), (weight * u * seen).sum(1))
    return out
