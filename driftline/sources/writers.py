"""Writers of history tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from driftline.functions.values import output_tag
from driftline.operators.blocks import long_groups
from driftline.session import join_small, rows_per_block


def write_history(
    df: DataFrame, path: str, name_pattern: Column, country: Column, run: Column,
    mode: str = "append",
) -> int:
    """Write Parquet in folders by selection tag and run; returns the number of rows.

    Rows meet by tag, object and month and are sorted by object and epoch within a file, so that readers
    of one object skip row groups, and an object with many rows spreads over several files. Nothing is
    sampled: ``df`` is computed once.
    """
    tagged = df.withColumns({"tag": output_tag(name_pattern, country), "run": run})
    layout = (tagged.repartition("tag", "norad", F.date_trunc("month", "epoch"))
              .sortWithinPartitions("tag", "norad", "epoch"))
    return _counted(layout, lambda out: out.write.mode(mode).partitionBy("tag", "run").parquet(path))


def write_clustered(df: DataFrame, path: str, buckets: int, entity: str = "norad", time: str = "epoch") -> int:
    """Write Parquet in ``buckets`` by object, sorted by object and time within a file; returns the number of rows.

    ``read_clustered`` reads it so that work on one object reads one bucket, and work by object (newest revisions, detectors) needs no
    exchange. The rows of a bucket make one file, but an object beyond ``driftline.rowsPerBlock`` is written by several tasks.
    """
    spark = df.sparkSession
    bucket, part = F.pmod(F.hash(entity), F.lit(buckets)), F.lit(0)
    long = long_groups(df, [entity], rows_per_block(spark), "long-series")
    rows = df
    if long is not None:
        sizes = long.select(F.col(entity).alias("_long"), "_size")
        rows = join_small(df, sizes, F.col(entity) == F.col("_long"), "left").drop("_long")
        parts = F.ceil(F.col("_size") / rows_per_block(spark))
        part = F.coalesce(F.pmod(F.xxhash64(time), parts), F.lit(0))
    rows = rows.repartition(bucket, part).drop("_size")
    written = _counted(rows, lambda out: out.write.bucketBy(buckets, entity).sortBy(entity, time).format("parquet").option(
        "path", path).saveAsTable(clustered_name(path)))
    layout = json.dumps({"buckets": buckets, "entity": entity, "time": time})
    spark.createDataFrame([(layout,)], "value string").coalesce(1).write.text(f"{path.rstrip('/')}/_layout")
    return written


def clustered_name(path: str) -> str:
    """The catalogue's name of the clustered table at ``path``."""
    return f"clustered_{hashlib.md5(path.rstrip('/').encode()).hexdigest()}"


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write the same rows as CSV with a header; returns the number of rows."""
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"  # the default keeps milliseconds only
    return _counted(df, lambda out: out.write.mode(mode).options(
        header=True, timestampFormat=micros + "XXX", timestampNTZFormat=micros).csv(path))


def write_rejects(rejects: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Write rejected records, as text with their ``faults``; returns their number."""
    return _counted(rejects, lambda out: out.write.mode(mode).parquet(path))


def _counted(df: DataFrame, write) -> int:
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get["rows"]
