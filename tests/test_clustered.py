import datetime as dt
import re

from pyspark.sql import functions as F
from test_detect import COLUMNS, orbit_rows

from driftline.operators.history import latest_revision, newest_in_order
from driftline.plans.detect import compare_methods
from driftline.session import new_path
from driftline.sources.readers import read_clustered
from driftline.sources.writers import clustered_name, write_clustered


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def revisions(n_objects=5, n=40):
    rows = [r for i in range(n_objects) for r in orbit_rows(i, n, jump_at=20, angle_jump=5.0, noise=0.01, seed=i)]
    return rows + [(*r[:2], r[2] - dt.timedelta(days=1), *r[3:9], 0.0) for r in rows[::3]] + [(*r[:2], None, *r[3:9], 1.0) for r in rows[::5]]


def test_work_by_object_needs_no_exchange(spark):
    rows = spark.createDataFrame(revisions(), COLUMNS).repartition(6)
    path = new_path(spark, "clustered")
    assert write_clustered(rows, path, 4) == rows.count()
    spark.sql(f"drop table {clustered_name(path)}")  # another session finds the layout beside the files
    table = read_clustered(spark, path)
    assert sorted(map(repr, table.collect())) == sorted(map(repr, rows.collect()))
    assert "Exchange" not in plan(latest_revision(table))
    found = compare_methods(table)
    assert not re.search(r"\bExchange ", plan(found)) and sorted(map(repr, found.collect())) == sorted(map(repr, compare_methods(rows).collect()))


def test_a_long_object_is_written_by_several_tasks(spark, tiny_blocks):
    rows = spark.createDataFrame(orbit_rows(1, 200) + orbit_rows(2, 4), COLUMNS)
    path = new_path(spark, "clustered")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one task's
    try:
        write_clustered(rows, path, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    table = read_clustered(spark, path)
    files = table.select("norad", F.input_file_name().alias("file")).distinct().groupBy("norad").agg(F.count("*").alias("n")).collect()
    assert {r.norad: r.n > 1 for r in files} == {1: True, 2: False} and table.count() == 204


def test_newest_in_order_is_the_latest_revision(spark):
    rows = spark.createDataFrame(revisions() + revisions()[:7] + [(None, None, None, *[1.0] * 7)] * 2, COLUMNS)
    assert sorted(map(repr, newest_in_order(rows).collect())) == sorted(map(repr, latest_revision(rows).collect()))
