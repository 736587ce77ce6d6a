"""Series in time order, however long one series is.

A plain ``Window.partitionBy(key).orderBy(time)`` sends a whole series to one task, which
fails when one key holds a large share of all rows. ``arrange`` therefore cuts the series
longer than a limit into blocks of consecutive rows. Windows run inside blocks; the little
that crosses a block edge (a neighbouring row, a running total) travels through a table with
one row per block. Results do not depend on where the cuts fall.

Series within the limit, usually all of them, keep the plain window plan. They are a table of their own (``short``),
so one long series doesn't make the others' rows be written between steps.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.session import is_small, join_small, materialise, rows_per_block

BLOCK = "_block"  # 0: the whole series; 1, 2, ...: its blocks in order
_MAX_BLOCKS = 8192
_BROADCAST_CUTS = 4_000_000  # numbers, together at most 32 MB
_COARSE = 64


@dataclass(frozen=True)
class Step:
    """A value that each row takes from its place in the series.

    ``inside`` is the value within a block, ``edge`` what a block passes on, ``across`` what
    arrives at a block, and ``merge`` joins the two.
    """

    inside: Callable[[Ordered, list[str]], Column]
    edge: Callable[[Column], Column]
    across: Callable[[Ordered, Column], Column]
    merge: Callable[[Column, Column], Column] = lambda inside, across: F.coalesce(inside, across)


def previous(*values: str) -> Step:
    """Struct of ``values`` of the row before; NULL on the first row."""
    packed = F.struct(*values)
    return Step(
        lambda o, by: F.lag(packed).over(o.window(by)),
        lambda order: F.max_by(packed, order),
        lambda o, edge: F.lag(edge).over(o.block_window()))


def following(*values: str) -> Step:
    """Struct of ``values`` of the row after; NULL on the last row."""
    packed = F.struct(*values)
    return Step(
        lambda o, by: F.lead(packed).over(o.window(by)),
        lambda order: F.min_by(packed, order),
        lambda o, edge: F.lead(edge).over(o.block_window()))


def last_seen(value: Column) -> Step:
    """The last non-null ``value`` at or before the row."""
    return Step(
        lambda o, by: F.last(value, ignorenulls=True).over(
            o.window(by).rowsBetween(W.unboundedPreceding, W.currentRow)),
        lambda order: F.max_by(value, F.when(value.isNotNull(), order)),
        lambda o, edge: F.last(edge, ignorenulls=True).over(
            o.block_window().rowsBetween(W.unboundedPreceding, -1)))


def next_seen(value: Column) -> Step:
    """The first non-null ``value`` at or after the row."""
    # Read backwards: a frame that ends at the series' end is quadratic in Spark.
    return Step(
        lambda o, by: F.last(value, ignorenulls=True).over(
            o.window(by, backwards=True).rowsBetween(W.unboundedPreceding, W.currentRow)),
        lambda order: F.min_by(value, F.when(value.isNotNull(), order)),
        lambda o, edge: F.last(edge, ignorenulls=True).over(
            o.block_window(backwards=True).rowsBetween(W.unboundedPreceding, -1)))


def running(value: Column) -> Step:
    """Sum of ``value`` up to and including the row."""
    return Step(
        lambda o, by: F.sum(value).over(o.window(by).rowsBetween(W.unboundedPreceding, W.currentRow)),
        lambda order: F.sum(value),
        lambda o, edge: F.sum(edge).over(o.block_window().rowsBetween(W.unboundedPreceding, -1)),
        lambda inside, across: F.when(across.isNull(), inside).when(
            inside.isNull(), across).otherwise(inside + across))


def position(start: int = 0) -> Step:
    """Position of the row in its series."""
    return Step(
        lambda o, by: (F.row_number().over(o.window(by)) + F.lit(start - 1)).cast("bigint"),
        lambda order: F.count(F.lit(1)),
        lambda o, edge: F.sum(edge).over(o.block_window().rowsBetween(W.unboundedPreceding, -1)),
        lambda inside, across: inside + F.coalesce(across, F.lit(0)))


def series_start(value: Column) -> Step:
    """Smallest ``value`` of the whole series."""
    return Step(
        lambda o, by: F.min(value).over(W.partitionBy(*by)),
        lambda order: F.min(value),
        lambda o, edge: F.min(edge).over(W.partitionBy(*o.keys)),
        lambda inside, across: F.coalesce(across, inside))


@dataclass(frozen=True)
class Ordered:
    """Rows of many series with a total order inside each one.

    ``short`` holds the series of one block, ``long`` those of several, if there are any; one of the two may be missing.
    """

    short: DataFrame | None
    long: DataFrame | None
    keys: tuple[str, ...]
    order: str

    @property
    def heavy(self) -> bool:
        return self.long is not None

    @property
    def rows(self) -> DataFrame:
        """All rows; with column ``BLOCK``."""
        parts = [p for p in (self.short, self.long) if p is not None]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    @property
    def groups(self) -> list[str]:
        """Columns whose equal values a single task may hold, for the long series."""
        return [*self.keys, BLOCK]

    def map(self, change: Callable[[DataFrame], DataFrame], long: Callable[[DataFrame], DataFrame] | None = None) -> Ordered:
        """The same change of both tables, or another one for the long series."""
        return replace(self, short=None if self.short is None else change(self.short),
                       long=None if self.long is None else (long or change)(self.long))

    def only_short(self) -> Ordered | None:
        return None if self.short is None else replace(self, long=None)

    def only_long(self) -> Ordered | None:
        return None if self.long is None else replace(self, short=None)

    def with_columns(self, columns: dict[str, Column]) -> Ordered:
        return self.map(lambda rows: rows.withColumns(columns))

    def where(self, condition: Column) -> Ordered:
        return self.map(lambda rows: rows.where(condition))

    def drop(self, *columns: str) -> Ordered:
        return self.map(lambda rows: rows.drop(*columns))

    def window(self, groups: list[str], backwards: bool = False) -> W:
        order = F.col(self.order).desc() if backwards else F.col(self.order).asc()
        return W.partitionBy(*groups).orderBy(order)

    def block_window(self, backwards: bool = False) -> W:
        order = F.col(BLOCK).desc() if backwards else F.col(BLOCK).asc()
        return W.partitionBy(*self.keys).orderBy(order)

    def result(self) -> DataFrame:
        return self.rows.drop(BLOCK)

    def extend(self, **steps: Step) -> Ordered:
        """Add one column per step.

        The rows of long series are written first, since they are read twice: for the rows
        themselves and for the table of block edges. The join of the two moves only the edges;
        the rows are already partitioned by its columns for the window.
        """
        return self.map(
            lambda rows: rows.withColumns({name: step.inside(self, list(self.keys)) for name, step in steps.items()}),
            lambda rows: self._extend_long(rows, steps))

    def _extend_long(self, rows: DataFrame, steps: dict[str, Step]) -> DataFrame:
        rows = materialise(rows, "blocks")
        order = F.col(self.order)
        edges = rows.groupBy(*self.groups).agg(
            *[step.edge(order).alias(f"_edge_{name}") for name, step in steps.items()])
        across = edges.select(*self.groups, *[
            step.across(self, F.col(f"_edge_{name}")).alias(f"_edge_{name}")
            for name, step in steps.items()])
        inside = rows.withColumns({name: step.inside(self, self.groups) for name, step in steps.items()})
        joined = inside.join(across, self.groups, "left")
        kinds = {name: inside.schema[name].dataType for name in steps}
        merged = joined.withColumns({
            name: step.merge(F.col(name), F.col(f"_edge_{name}").cast(kinds[name])).cast(kinds[name])
            for name, step in steps.items()})
        return merged.drop(*[f"_edge_{name}" for name in steps])


def long_groups(df: DataFrame, keys: list[str], limit: int, what: str, sizes: DataFrame | None = None) -> DataFrame | None:
    """The groups with more than ``limit`` rows and their sizes, or None; ``sizes`` has them if they are known.

    There are fewer of them than ``rows / limit``, so the table stays small.
    """
    if sizes is None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    biggest = sizes.agg(F.max("_size")).head()[0]
    if biggest is None or biggest <= limit:
        return None
    return materialise(sizes.where(F.col("_size") > limit), what)


def arrange(
    df: DataFrame | Ordered, keys: list[str], order: str, rows: int | None = None,
    measure: DataFrame | None = None, sizes: DataFrame | None = None,
) -> Ordered:
    """Order each series, cutting those longer than ``rows`` (the session's limit by default).

    ``order`` must not repeat much inside a series: equal values are never separated.
    ``measure`` are rows with the same keys and order that are cheaper to read, such as the
    input of an aggregation that ``df`` is the result of; sizes and cuts are taken from them. ``sizes`` are the
    groups' numbers of rows (``_size``), or bounds of them, where they are known already.
    Already ordered input passes through. A series without a key (null) is short.
    """
    if isinstance(df, Ordered):
        return df
    measure = df if measure is None else measure
    limit = rows or rows_per_block(df.sparkSession)
    sizes = long_groups(measure, keys, limit, "long-series", sizes)
    if sizes is None:
        return Ordered(df.withColumn(BLOCK, F.lit(0)), None, tuple(keys), order)
    cuts = _cut_points(measure, keys, order, sizes, limit)
    if not keys or cuts.agg(F.sum(F.size("_cuts"))).head()[0] <= _BROADCAST_CUTS:
        cuts = F.broadcast(cuts)
    block = F.lit(1) + _locate(F.col("_cuts"), F.col("_coarse"), F.col(order))
    tagged = df.join(cuts, keys) if keys else df.join(cuts)  # without keys: one row
    long = tagged.withColumn(BLOCK, block).drop("_cuts", "_coarse").select(*df.columns, BLOCK)
    if not keys:
        return Ordered(None, long, (), order)
    known = functools.reduce(operator.and_, [F.col(k) == F.col(f"_long_{k}") for k in keys])
    names = sizes.select(*[F.col(k).alias(f"_long_{k}") for k in keys])
    short = df.join(F.broadcast(names) if is_small(names) else names, known, "left_anti")
    return Ordered(short.withColumn(BLOCK, F.lit(0)), long, tuple(keys), order)


def _cut_points(
    df: DataFrame, keys: list[str], order: str, sizes: DataFrame, limit: int,
) -> DataFrame:
    """Per long series: ascending order values at which a new block starts.

    Quantile sketches give them in one pass with map-side merging. They only balance the
    blocks, so their error is harmless, but every step must see the same ones: hence written.
    """
    biggest = sizes.agg(F.max("_size")).head()[0]
    parts = min(math.ceil(biggest / limit), _MAX_BLOCKS)
    probabilities = [i / parts for i in range(1, parts)]
    long_rows = join_small(df.select(*keys, order), sizes, keys, "inner") if keys else (
        df.select(order).withColumn("_size", F.lit(biggest)))
    sketch = long_rows.groupBy(*keys).agg(
        F.percentile_approx(order, probabilities, max(10_000, 8 * parts)).alias("_cuts"),
        F.max("_size").alias("_size"))
    # A series with fewer rows than the longest one keeps every n-th cut.
    every = F.greatest(
        F.lit(1), F.floor(F.lit(parts) / F.ceil(F.col("_size") / F.lit(limit))).cast("int"))
    cuts = sketch.withColumn("_every", every).withColumn(
        "_cuts", F.array_distinct(F.filter(
            "_cuts", lambda cut_, at_: (at_ + F.lit(1)) % F.col("_every") == 0)))
    cuts = cuts.withColumn("_coarse", F.filter(
        "_cuts", lambda cut_, at_: at_ % F.lit(_COARSE) == _COARSE - 1))
    return materialise(cuts.select(*keys, "_cuts", "_coarse"), "cut-points")


def _locate(cuts: Column, coarse: Column, value: Column) -> Column:
    """How many cuts are at or below ``value``: coarse steps first, then inside one step."""
    steps = F.size(F.filter(coarse, lambda cut_: cut_ <= value))
    inside = F.slice(cuts, steps * F.lit(_COARSE) + F.lit(1), F.lit(_COARSE))
    return steps * F.lit(_COARSE) + F.size(F.filter(inside, lambda cut_: cut_ <= value))
