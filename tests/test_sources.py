import datetime as dt
import json

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from driftline.operators.catalog import Rule
from driftline.plans.acquire import acquire
from driftline.schema import HISTORY, RAW_HISTORY
from driftline.sources.readers import (
    read_catalogue, read_history, read_raw_history, split_catalogue, split_history, typed_history)
from driftline.sources.writers import export_csv, write_history


def record(norad=1, **changes):
    base = {"NORAD_CAT_ID": str(norad), "OBJECT_NAME": f"SAT {norad}", "EPOCH": "2026-01-02T03:04:05.123456",
            "CREATION_DATE": "2026-01-03T00:00:00", "REV_AT_EPOCH": "12", "INCLINATION": "0.05", "RA_OF_ASC_NODE": "10",
            "ARG_OF_PERICENTER": "20", "MEAN_ANOMALY": "30", "MEAN_MOTION": "1.0027", "ECCENTRICITY": "0.0002", "BSTAR": "0"}
    return {**base, **changes}


def raw(spark, *records):
    return spark.createDataFrame([tuple(r[f.name] for f in RAW_HISTORY) for r in records], RAW_HISTORY)


def test_typed_rows(spark):
    frame = typed_history(raw(spark, record()))
    row = frame.head()
    assert [f.dataType for f in frame.schema] == [f.dataType for f in HISTORY] and frame.columns == HISTORY.names
    assert row.epoch == dt.datetime(2026, 1, 2, 3, 4, 5, 123456) and row.norad == 1 and abs(row.sma - 42165) < 5


@pytest.mark.parametrize("change", [{"BSTAR": None}, {"REV_AT_EPOCH": "1.5"}, {"EPOCH": "soon"}, {"MEAN_MOTION": "0"},
                                    {"CREATION_DATE": "x"}, {"ECCENTRICITY": ""}])
def test_unusable_records(spark, change):
    frame = raw(spark, record(1), record(2, **change))
    with pytest.raises(Exception, match="unusable " + next(iter(change))):
        typed_history(frame).collect()
    good, rejects = split_history(frame)
    assert [r.norad for r in good.collect()] == [1]
    assert [(r.NORAD_CAT_ID, r.faults) for r in rejects.collect()] == [("2", list(change))]


def test_missing_creation_date_is_allowed(spark):
    assert typed_history(raw(spark, record(CREATION_DATE=None, OBJECT_NAME=None))).head().creation_date is None


def test_empty_input_keeps_the_schema(spark, tmp_path):
    path = str(tmp_path / "out")
    assert write_history(typed_history(raw(spark, record()).where("false")), path, F.lit("A"), F.lit("B"), F.lit("r")) == 0
    assert typed_history(raw(spark, record()).where("false")).columns == HISTORY.names


def test_nanosecond_parquet(spark, tmp_path):
    frame = pd.DataFrame({"norad": [1, 2], "epoch": pd.to_datetime(["2026-01-02 03:04:05.123456", "1969-12-31 23:59:59.5"]),
                          "creation_date": pd.to_datetime(["2026-01-02", None])})
    path = str(tmp_path / "n.parquet")
    table = pa.Table.from_pandas(frame).cast(pa.schema(
        [("norad", pa.int64()), ("epoch", pa.timestamp("ns")), ("creation_date", pa.timestamp("ns"))]))
    pq.write_table(table, path, version="2.6")
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    try:
        rows = {r.norad: r for r in read_history(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.legacy.parquet.nanosAsLong")
    assert rows[1].epoch == dt.datetime(2026, 1, 2, 3, 4, 5, 123456) and rows[2].creation_date is None
    assert rows[2].epoch == dt.datetime(1969, 12, 31, 23, 59, 59, 500000)


def test_csv_keeps_microseconds(spark, tmp_path):
    rows = typed_history(raw(spark, record()))
    path = str(tmp_path / "csv")
    assert export_csv(rows, path) == 1
    back = spark.read.option("header", True).schema(rows.schema).csv(path)
    assert back.collect() == rows.collect()


def test_acquire(spark, tmp_path):
    catalogue = [{"NORAD_CAT_ID": n, "OBJECT_NAME": name, "COUNTRY_CODE": c, "OBJECT_TYPE": t, "SEMIMAJOR_AXIS": a}
                 for n, name, c, t, a in [(1, "GSAT 1", "IND", "PAYLOAD", 42164.0), (2, "GSAT 2", "IND", "DEBRIS", 42164.0),
                                          (3, "ECHO", "US", "PAYLOAD", 42164.0), (4, "LEO", "US", "PAYLOAD", 7000.0),
                                          (5, "GSAT 5", "IND", "PAYLOAD", 42164.0)]]
    history = [record(n, EPOCH=f"2026-0{m}-01T00:00:00") for n in range(1, 6) for m in (1, 4, 5)]
    (tmp_path / "cat.json").write_text(json.dumps(catalogue, indent=1))
    (tmp_path / "h1.json").write_text(json.dumps(history[:7], indent=1))
    (tmp_path / "h2.json").write_text(json.dumps(history[7:]))
    assert read_catalogue(spark, str(tmp_path / "cat.json")).count() == 5
    assert read_raw_history(spark, str(tmp_path / "h*.json")).count() == 15
    out = str(tmp_path / "out")
    n = acquire(spark, str(tmp_path / "cat.json"), str(tmp_path / "h*.json"), out, [Rule("GSAT", ""), Rule()], "run1",
                (42000.0, 43000.0), dt.date(2026, 1, 1), dt.date(2026, 4, 1), per_rule=2)
    back = read_history(spark, out)
    assert n == (back.count(), 0) == (8, 0)
    found = {(r.tag, r.norad) for r in back.select("tag", "norad").distinct().collect()}
    assert found == {("GSAT_ALL", 1), ("GSAT_ALL", 5), ("ALL_ALL", 1), ("ALL_ALL", 3)}


def test_acquire_keeps_every_object_and_rule(spark, tmp_path):
    catalogue = [{"NORAD_CAT_ID": str(n), "OBJECT_NAME": f"ALL {n}", "COUNTRY_CODE": "IND", "OBJECT_TYPE": "PAYLOAD", "SEMIMAJOR_AXIS": "42164.5"}
                 for n in range(1, 402)] + [{"NORAD_CAT_ID": "x", "OBJECT_NAME": None, "COUNTRY_CODE": None, "OBJECT_TYPE": None, "SEMIMAJOR_AXIS": None}]
    history = [record(n, EPOCH="2026-02-01T00:00:00") for n in range(1, 402)] + [record("y"), record(1, BSTAR="?"), record(999, BSTAR="?")]
    (tmp_path / "cat.json").write_text(json.dumps(catalogue))
    (tmp_path / "h.json").write_text(json.dumps(history))
    out = str(tmp_path / "out")
    done = acquire(spark, str(tmp_path / "cat.json"), str(tmp_path / "h.json"), out, [Rule("ALL"), Rule(), Rule()], "r", strict=False)
    back = read_history(spark, out)
    assert done == (1203, 3) and back.count() == 1203 and {r.tag for r in back.select("tag").distinct().collect()} == {"ALL_ALL"}
    assert {(r.rule_no, r["count"]) for r in back.groupBy("rule_no").count().collect()} == {(0, 401), (1, 401), (2, 401)}
    assert spark.read.parquet(f"{out}-rejects/r/history").count() == 2 and spark.read.parquet(f"{out}-rejects/r/catalogue").count() == 1
    with pytest.raises(Exception, match="unusable NORAD_CAT_ID"):
        acquire(spark, str(tmp_path / "cat.json"), str(tmp_path / "h.json"), out, [Rule()], "s")


def test_a_record_that_is_no_json(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"NORAD_CAT_ID": 1, "SEMIMAJOR_AXIS": "7000"}\n{broken\n')
    with pytest.raises(Exception, match="unusable NORAD_CAT_ID"):
        read_catalogue(spark, str(tmp_path / "c.json"), array_files=False).collect()
    good, bad = split_catalogue(spark, str(tmp_path / "c.json"), array_files=False)
    assert [(r.NORAD_CAT_ID, r.SEMIMAJOR_AXIS) for r in good.collect()] == [(1, 7000.0)]
    assert [r.faults for r in bad.collect()] == [["record", "NORAD_CAT_ID"]]
