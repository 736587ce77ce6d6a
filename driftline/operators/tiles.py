"""Long series packed: one row per tile of consecutive samples, each column a list.

Exchanges, joins and calls of Python then count tiles, not samples, however small the tiles are. A task holds one tile and another one
that it meets (``meet``), or as many as fit an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators.blocks import BLOCK
from driftline.operators.per_series import map_groups
from driftline.session import arrow_batches, materialise

NUMBERS = T.ArrayType(T.DoubleType())
LONGS = T.ArrayType(T.LongType())
_BATCH_ROWS, _BATCH_BYTES = 10_000, 32 << 20


def write_tiles(tiles: DataFrame, name: str) -> DataFrame:
    """``materialise`` of packed rows, which reach Python some megabytes at a time."""
    with arrow_batches(tiles.sparkSession, _BATCH_ROWS, _BATCH_BYTES):
        return materialise(tiles, name)


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists one behind the other, and where each begins; NULL is an empty list."""
    parts = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in column.chunks]
    return np.concatenate(parts) if parts else np.zeros(0), starts(column)


def starts(column: pa.ChunkedArray) -> np.ndarray:
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def pack(values: np.ndarray | pa.Array, bounds: np.ndarray) -> pa.Array:
    values = pa.array(values) if isinstance(values, np.ndarray) else values
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``start`` to ``start + size`` of each, one range behind the other."""
    size = np.asarray(size, dtype=np.int64)
    ends = np.cumsum(size)
    return np.repeat(np.asarray(start, dtype=np.int64) - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def pack_blocks(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row per block: its number of rows ``_len`` and the lists of ``order`` and of ``columns``, in order."""
    groups = [*keys, BLOCK]
    schema = T.StructType([*[rows.schema[c] for c in groups], T.StructField("_len", T.LongType()),
                           *[T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in (order, *columns)]])

    def change(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        out = table.select(groups).take(pa.array(bounds[:-1])).append_column("_len", pa.array(np.diff(bounds).astype(np.int64)))
        for name in (order, *columns):
            out = out.append_column(name, pack(pa.concat_arrays(table[name].chunks), bounds))
        return out

    return map_groups(rows.select(*groups, order, *columns), groups, order, schema, change)


def tile(blocks: DataFrame, keys: list[str], columns: list[str], width: int) -> DataFrame:
    """``_tile`` and the lists of its ``width`` samples, from packed blocks of any lengths; ``_i0`` is the first one's position.

    Blocks are cut where a tile begins, and the pieces of a tile are put together.
    """
    before = F.sum("_len").over(W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1))
    begins = blocks.select(*keys, BLOCK, "_len").select(*keys, BLOCK, F.coalesce(before, F.lit(0)).alias("_i0"))
    placed = blocks.join(begins, [*keys, BLOCK]).select(*keys, "_i0", *columns)
    schema = T.StructType([*[blocks.schema[k] for k in keys], T.StructField("_tile", T.LongType()), T.StructField("_i0", T.LongType()),
                           *[blocks.schema[c] for c in columns]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            begin = starts(table[columns[0]])
            row = np.repeat(np.arange(table.num_rows), np.diff(begin))
            if not len(row):
                continue
            at = table["_i0"].to_numpy()[row] + np.arange(len(row)) - begin[row]
            cuts = np.flatnonzero((np.arange(len(row)) == begin[row]) | (at % width == 0))
            out = table.select(keys).take(pa.array(row[cuts]))
            out = out.append_column("_tile", pa.array(at[cuts] // width)).append_column("_i0", pa.array(at[cuts]))
            bounds = np.append(cuts, len(row))
            for name in columns:
                out = out.append_column(name, pack(pa.concat_arrays([c.flatten() for c in table[name].chunks]), bounds))
            yield from out.to_batches()

    def put_together(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        out = table.select([*keys, "_tile", "_i0"]).take(pa.array(bounds[:-1]))
        begin = starts(table[columns[0]])[bounds]
        for name in columns:
            out = out.append_column(name, pack(pa.concat_arrays([c.flatten() for c in table[name].chunks]), begin))
        return out

    return map_groups(placed.mapInArrow(cut, schema), [*keys, "_tile"], "_i0", schema, put_together)


def meet(
    asks: DataFrame, near: list[DataFrame], keys: list[str], samples: str, sums: int, schema: T.StructType,
    add: Callable[[np.ndarray, pa.Table, np.ndarray, pa.Table, np.ndarray], None], finish: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table],
) -> DataFrame:
    """Each tile ``_own`` of ``asks`` with the rows of ``near`` that are for it, some at a time.

    ``add`` gets ``sums`` numbers for each of the tiles' ``samples``, all 0 at first, to add to; the tiles and where the samples of each
    begin; rows of ``near`` (``_kind`` 1 for the first table, and so on) and the tile that each is for. ``finish`` gets tiles that have
    met all their rows. A tile whose rows fill more than a batch is held with its numbers meanwhile, not with the rows.
    """
    both = asks.withColumn("_kind", F.lit(0))
    for kind, rows in enumerate(near, 1):
        both = both.unionByName(rows.withColumn("_kind", F.lit(kind)), allowMissingColumns=True)
    placed = both.repartition(*keys, "_own").sortWithinPartitions(*keys, "_own", "_kind", "_tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, so_far = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            asking = table["_kind"].to_numpy() == 0
            own = table.filter(pa.array(asking))
            of = (np.cumsum(asking) - 1 + (held is not None))[~asking]
            own = own if held is None else pa.concat_tables([held, own])
            begin = starts(own[samples])
            numbers = np.zeros((sums, begin[-1]))
            if held is not None:
                numbers[:, :begin[1]] = so_far
            if len(of):
                add(numbers, own, begin, table.filter(pa.array(~asking)), of)
            if own.num_rows > 1:
                yield from finish(own.slice(0, own.num_rows - 1), begin[:-1], numbers[:, :begin[-2]]).to_batches()
            held, so_far = own.slice(own.num_rows - 1), numbers[:, begin[-2]:].copy()
        if held is not None:
            yield from finish(held, starts(held[samples]), so_far).to_batches()

    return placed.mapInArrow(run, schema)
