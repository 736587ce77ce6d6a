import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from driftline.operators import kalman, lowess
from driftline.session import join_small, materialise, work_dir


def fake(named=None, master="yarn", current=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: current)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named or default), sparkContext=context)


def test_work_dir_is_the_named_shared_folder():
    assert work_dir(fake(named="hdfs:///shared")) == "hdfs:///shared"
    assert work_dir(fake(current="hdfs:///set")) == "hdfs:///set"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_dir(fake())


def test_materialised_rows_have_no_lineage(spark):
    frame = materialise(spark.range(10).withColumn("x", F.rand(3)), "t")
    assert frame.collect() == frame.collect()
    assert "Range" not in frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", ["1", "100"])
@pytest.mark.parametrize("how,rows", [("inner", 20), ("left", 100), ("left_semi", 20), ("left_anti", 80)])
def test_join_small_gives_the_same_either_way(spark, limit, how, rows):
    left = spark.range(100).withColumn("k", F.col("id") % 10)
    spark.conf.set("driftline.broadcastRows", limit)
    try:
        assert join_small(left, spark.createDataFrame([(1,), (2,)], "k long"), ["k"], how).count() == rows
    finally:
        spark.conf.unset("driftline.broadcastRows")


@pytest.mark.parametrize("maker", [kalman.filter_maker(.1, 1.0, 10.0, "z"), lowess.smooth_maker("o", "v", "t", .5, 3)])
def test_task_functions_run_without_the_package(tmp_path, maker):
    code = ("import pickle, sys, numpy as np; m = pickle.loads(sys.stdin.buffer.read()); a = np.arange(1.0, 9.0); "
            "print(len(m.make(*[a for _ in m.inputs])[0]), 'driftline' in sys.modules)")
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(maker), capture_output=True,
                          cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=False)
    assert done.stdout.decode().split() == ["8", "False"], done.stderr.decode()
