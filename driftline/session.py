"""Session helpers: settings, the shared work folder, checked broadcasts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructField, StructType

ROWS_PER_BLOCK_CONF = "driftline.rowsPerBlock"
DEFAULT_ROWS_PER_BLOCK = 500_000
BROADCAST_ROWS_CONF = "driftline.broadcastRows"
DEFAULT_BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES_CONF = "driftline.broadcastBytes"
DEFAULT_BROADCAST_BYTES = 32 * 1024 * 1024


_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_PARTITION_BYTES = 128 * 1024 * 1024


def build_session(
    app: str, master: str | None = None, input_bytes: int | None = None, **conf: str,
) -> SparkSession:
    """A session with the settings the operators are tuned for.

    ``input_bytes``, the size of the table to work on, sets how finely shuffles are split:
    adaptive execution merges partitions that turn out small but cannot split large ones.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.legacy.parquet.nanosAsLong", "true")
    )
    if input_bytes:
        parts = max(200, -(-input_bytes // _PARTITION_BYTES))
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def rows_per_block(spark: SparkSession) -> int:
    """Largest number of rows of one series that a single task is asked to hold."""
    return int(spark.conf.get(ROWS_PER_BLOCK_CONF, str(DEFAULT_ROWS_PER_BLOCK)))


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    It is the cluster's ``spark.checkpoint.dir``. A machine-local folder is set up only when
    none is named and the session itself is local, as in tests.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="driftline-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read, and pins values that later
    steps must all see alike.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int, most_bytes: int | None = None) -> Iterator[None]:
    """Jobs inside send at most ``rows`` rows at once to Python, and no more than about ``most_bytes`` bytes or one row: texts of
    some kilobytes each fill tens of megabytes by default, in the JVM and again in Python."""
    before = {name: spark.conf.get(name) for name in (_BATCH_CONF, _BATCH_BYTES_CONF)}
    held = int(before[_BATCH_CONF])
    spark.conf.set(_BATCH_CONF, str(min(rows, held) if held > 0 else rows))
    if most_bytes:
        spark.conf.set(_BATCH_BYTES_CONF, str(most_bytes))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _width(value: Column, kind: DataType) -> Column | int:
    """About the bytes that a value takes in memory; a number where all values take the same."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind), 16)
    if isinstance(kind, MapType):
        return _width(F.map_entries(value), ArrayType(StructType([StructField("key", kind.keyType), StructField("value", kind.valueType)])))
    if isinstance(kind, ArrayType):
        each = _width(F.lit(None).cast(kind.elementType), kind.elementType)
        if isinstance(each, int):
            return F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)) * each + 24
        total = F.aggregate(value, F.lit(0).cast("long"), lambda t, x: t + _width(x, kind.elementType))
        return F.coalesce(total, F.lit(0).cast("long")) + 24
    return 8


def is_small(df: DataFrame) -> bool:
    """Whether ``df`` is within the limits of a broadcast, in rows and in bytes. Pass a materialised one."""
    spark = df.sparkSession
    rows = int(spark.conf.get(BROADCAST_ROWS_CONF, str(DEFAULT_BROADCAST_ROWS)))
    most = int(spark.conf.get(BROADCAST_BYTES_CONF, str(DEFAULT_BROADCAST_BYTES)))
    held = df.limit(rows + 1).count()
    if held > rows:
        return False
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), 16)
    if isinstance(width, int):
        return held * width <= most
    return (df.agg(F.sum(width)).first()[0] or 0) <= most


def join_small(left: DataFrame, right: DataFrame, on: list[str] | Column, how: str) -> DataFrame:
    """Join ``left`` with a side expected to be small.

    ``right`` is measured first and broadcast only below the limits; beyond them the join is a
    shuffle join, whose hot keys adaptive execution splits. Pass a materialised ``right``, so
    that measuring it is cheap.
    """
    return left.join(F.broadcast(right) if is_small(right) else right, on, how)
