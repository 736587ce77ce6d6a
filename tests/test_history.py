import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftline.operators.catalog import (
    Rule, between_epochs, chunked, first_n, first_n_per_rule, history_of, in_orbit_range, match_rules, payloads,
    random_n)
from driftline.operators.history import (
    concatenate, counts, distinct_in_order, latest_revision, load_history, require_rows, unpivot)

D = dt.datetime
SCHEMA = "norad long, epoch timestamp_ntz, creation_date timestamp_ntz, rev_at_epoch long, sma double"


def test_latest_revision(spark):
    rows = [(1, D(2026, 1, 1), D(2026, 1, 2), 1, 10.0), (1, D(2026, 1, 1), D(2026, 1, 3), 2, 11.0),
            (1, D(2026, 1, 1), None, 3, 12.0), (1, D(2026, 1, 2), None, 4, 13.0),
            (2, D(2026, 1, 1), D(2026, 1, 2), 5, 14.0), (2, D(2026, 1, 1), D(2026, 1, 2), 6, 15.0),
            (3, None, D(2026, 1, 2), 7, 16.0), (3, None, D(2026, 1, 4), 8, 17.0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.rev_at_epoch for r in latest_revision(frame.repartition(5)).collect()) == [2, 4, 6, 8]
    assert latest_revision(frame.drop("creation_date")).count() == len(rows)


def test_copies_of_one_key_shrink_before_the_shuffle(spark):
    frame = spark.range(1000).selectExpr(
        "id div 1000 as norad", "timestamp_ntz'2026-01-01' + (id div 1000) * interval '1' day as epoch", "id as creation_date")
    plan = latest_revision(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert latest_revision(frame).head().creation_date == 999


def test_load_history(spark, tmp_path):
    rows = [(n, D(2026, 1, d), D(2026, 2, r), d, float(r)) for n in (1, 2) for d in (5, 1, 3, 2, 4) for r in (1, 2)]
    path = str(tmp_path / "h")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    table = spark.read.parquet(path)
    got = load_history(table, ["sma"], [2], dt.date(2026, 1, 2), D(2026, 1, 4))
    assert [(r.norad, r.epoch.day, r.sma) for r in got.collect()] == [(2, 2, 2.0), (2, 3, 2.0), (2, 4, 2.0)]
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        got._jdf.queryExecution(), "formatted")
    scan = [line for line in plan.splitlines() if line.startswith("PushedFilters")][0]
    assert "EqualTo(norad,2)" in scan and "GreaterThanOrEqual(epoch" in scan and "LessThanOrEqual(epoch" in scan
    read = [line for line in plan.splitlines() if line.startswith("ReadSchema")][0]
    assert "rev_at_epoch" not in read and "sma" in read
    with pytest.raises(Exception, match="perigee"):
        load_history(table, ["perigee"])
    with pytest.raises(ValueError, match="norad 9"):
        require_rows(load_history(table, ["sma"], [9]), "norad 9")
    long = unpivot(load_history(table, ["sma", "rev_at_epoch"]), ["sma", "rev_at_epoch"])
    assert long.count() == 20 and long.columns == ["norad", "epoch", "param", "value"]
    assert counts(table).head()[:] == (20, 2) and counts(table.where("false")).head()[:] == (0, 0)
    assert concatenate([table, table, table]).count() == 60


def test_end_date_means_its_midnight(spark):
    frame = spark.createDataFrame([(D(2026, 4, 1),), (D(2026, 4, 1, 0, 0, 1),)], "epoch timestamp_ntz")
    assert between_epochs(frame, dt.date(2026, 4, 1), dt.date(2026, 4, 1)).count() == 1


def test_distinct_in_order(spark):
    frame = spark.createDataFrame([(5, 0), (3, 1), (5, 2), (9, 3), (3, 4)], "id long, at long")
    assert [r.id for r in distinct_in_order(frame, "id", "at").collect()] == [5, 3, 9]


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [(1, "GSAT 1", "IND", "PAYLOAD", 42100.0), (2, "GSAT 2 DEB", "IND", "DEBRIS", 42100.0),
            (3, "STARLINK-1", "US", "PAYLOAD", 6900.0), (4, "GALILEO 5", "ESA", "PAYLOAD", 42000.0),
            (5, "gsat 7", "IND", "PAYLOAD", 43000.0), (6, "G%AT", "US", "PAYLOAD", None)]
    return spark.createDataFrame(
        rows, "norad_cat_id long, object_name string, country_code string, object_type string, semimajor_axis double")


def ids(frame):
    return sorted(r.norad_cat_id for r in frame.collect())


def test_selection(spark, catalogue):
    assert ids(payloads(catalogue)) == [1, 3, 4, 5, 6]
    assert ids(in_orbit_range(catalogue, 42000.0, 43000.0)) == [1, 2, 4, 5]
    assert in_orbit_range(catalogue, 1.0, None) is catalogue
    assert ids(match_rules(catalogue, [Rule()])) == [1, 3, 4, 5, 6]
    assert ids(match_rules(catalogue, [Rule("GSAT")])) == [1]
    assert ids(match_rules(catalogue, [Rule("G%")])) == [6]
    assert ids(match_rules(catalogue, [Rule("G", "US"), Rule("", "US")])) == [3, 6, 6]
    assert ids(match_rules(catalogue, [])) == []
    plan = match_rules(catalogue, [Rule("G"), Rule("", "US")])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert ids(first_n(catalogue, 2)) == [1, 2]
    both = match_rules(catalogue, [Rule(), Rule("", "US")])
    assert sorted((r.rule, r.norad_cat_id) for r in first_n_per_rule(both, 1).collect()) == [("ALL_ALL", 1), ("ALL_US", 3)]
    batches = chunked(spark.range(7).select((F.col("id") * 2).alias("norad_cat_id")).repartition(3), 3)
    assert [r.batch_id for r in batches.orderBy("norad_cat_id").collect()] == [0, 0, 0, 1, 1, 1, 2]


def test_random_n_does_not_depend_on_partitions(spark):
    frame = spark.range(500).withColumnRenamed("id", "norad_cat_id")
    a, b = random_n(frame.repartition(3), 20, 7), random_n(frame.repartition(11), 20, 7)
    assert ids(a) == ids(b) != ids(random_n(frame, 20, 8))


def test_id_list_beyond_the_broadcast_limit(spark):
    history = spark.range(1000).select((F.col("id") % 10).alias("norad"), F.col("id").alias("epoch"))
    wanted = spark.createDataFrame([(3,), (4,), (3,)], "norad_cat_id long")
    hinted = lambda f: "strategy=broadcast" in f._jdf.queryExecution().logical().toString()
    small = history_of(history, wanted)
    spark.conf.set("driftline.broadcastRows", "1")
    try:
        large = history_of(history, wanted)
    finally:
        spark.conf.unset("driftline.broadcastRows")
    assert hinted(small) and not hinted(large)
    assert small.count() == large.count() == 200
