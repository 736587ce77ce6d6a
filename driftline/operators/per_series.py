"""Ordered per-series work that needs a loop: Arrow tables of one bounded group at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARROW = {"double": pa.float64(), "boolean": pa.bool_(), "bigint": pa.int64()}
_SPARK = {"double": T.DoubleType(), "boolean": T.BooleanType(), "bigint": T.LongType()}


@dataclass(frozen=True)
class Maker:
    """New columns (name to Spark type) from arrays of one time-ordered group."""

    inputs: tuple[str, ...]
    outputs: dict[str, str]
    make: Callable[..., tuple[np.ndarray, ...]]


def floats(column: pa.ChunkedArray) -> np.ndarray:
    """NULL becomes NaN."""
    return np.asarray(column.cast(pa.float64()).to_numpy(), dtype=float)


def to_arrow(values: np.ndarray, kind: str) -> pa.Array:
    """NaN becomes NULL."""
    if kind == "double":
        return pa.array(values, pa.float64(), mask=~np.isfinite(values))
    return pa.array(values, _ARROW[kind])


def add_columns(rows: DataFrame, groups: list[str], order: str, makers: list[Maker]) -> DataFrame:
    """Run all makers on each group in one pass; the groups must be of bounded size."""
    schema = T.StructType(rows.schema.fields + [
        T.StructField(name, _SPARK[kind]) for m in makers for name, kind in m.outputs.items()])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        for maker in makers:
            arrays = maker.make(*[floats(table[c]) for c in maker.inputs])
            for (name, kind), values in zip(maker.outputs.items(), arrays, strict=True):
                table = table.append_column(name, to_arrow(values, kind))
        return table

    return rows.groupBy(*groups).applyInArrow(run, schema)


# -- groups that are many and small, as the blocks of long series may be -------------------


def map_groups(
    rows: DataFrame, groups: list[str], order: str, schema: T.StructType, change: Callable[[pa.Table, np.ndarray], pa.Table],
) -> DataFrame:
    """``change`` of tables of whole groups in order; group ``i`` has the rows ``bounds[i]`` to ``bounds[i + 1]``.

    One call takes about as many groups as fit an Arrow batch, so what a call costs does not count once per group. A larger group is
    held whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, groups):
            yield from change(table, np.concatenate([[0], 1 + np.flatnonzero(_changes(table, groups)), [table.num_rows]])).to_batches()

    # The exchange is asked for, since mapInArrow itself asks for no distribution.
    placed = rows.repartition(*groups).sortWithinPartitions(*groups, F.col(order).asc_nulls_last())
    return placed.mapInArrow(run, schema)


def add_columns_by_block(rows: DataFrame, groups: list[str], order: str, makers: list[Maker]) -> DataFrame:
    """``add_columns`` with one call for many groups."""
    schema = T.StructType(rows.schema.fields + [
        T.StructField(name, _SPARK[kind]) for m in makers for name, kind in m.outputs.items()])

    def change(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        for maker in makers:
            inputs = [floats(table[c]) for c in maker.inputs]
            made = [maker.make(*[x[a:b] for x in inputs]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            for (name, kind), parts in zip(maker.outputs.items(), zip(*made, strict=True), strict=True):
                table = table.append_column(name, to_arrow(np.concatenate(parts), kind))
        return table

    return map_groups(rows, groups, order, schema, change)


def whole_groups(batches: Iterator[pa.RecordBatch], groups: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group ends; equal values of ``groups`` must stand side by side."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = held[-1].slice(held[-1].num_rows - 1) if held else batch.slice(0, 0)
        seam = pa.Table.from_batches([last, batch])
        changed = np.flatnonzero(_changes(seam, groups))
        if len(changed):
            cut = int(changed[-1]) + 1 - last.num_rows
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _changes(table: pa.Table, groups: list[str]) -> np.ndarray:
    """Whether each row but the first differs from the one before; NULLs are alike, and so are NaNs."""
    changed = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for name in groups:
        now, before = table[name].slice(1), table[name].slice(0, len(changed))
        differ = pc.fill_null(pc.not_equal(now, before), False)
        if pa.types.is_floating(now.type):
            differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(now), pc.is_nan(before)), False))
        changed |= np.asarray(pc.or_(differ, pc.xor(pc.is_null(now), pc.is_null(before))))
    return changed
