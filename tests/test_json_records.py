import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.sources.json_records import Walk, in_string, json_records, open_braces, split
from driftline.sources.readers import read_raw_history, split_catalogue


def records(n, seed=1):
    draw = random.Random(seed)
    odd = ["}", "{", "[{", "}]", '"', "\\", '\\"', "},{", "é日", "\n", "plain", ""]
    out = []
    for i in range(n):
        r = {"NORAD_CAT_ID": str(i), "OBJECT_NAME": "".join(draw.choices(odd, k=draw.randint(0, 6))), "EPOCH": "2026-01-01T00:00:00"}
        if draw.random() < 0.2:
            r["BSTAR"] = draw.choice([{"a": {"b": "}{"}}, [1, {"c": "]"}], 1.5, None])
        if draw.random() < 0.05:
            r["MEAN_MOTION"] = "}" * draw.randint(1, 300)
        out.append(r)
    return out


def written(path, text):
    path.write_bytes(text.encode())
    return str(path)


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("split_bytes", [37, 256, 5000, 1 << 20])
def test_every_object_is_read_once(spark, tmp_path, split_bytes, indent):
    rows = records(120, seed=split_bytes)
    paths = [written(tmp_path / "a.json", json.dumps(rows[:70], ensure_ascii=False, indent=indent)),
             written(tmp_path / "b.json", "\ufeff" + json.dumps(rows[70:119], indent=indent) + "\n"),
             written(tmp_path / "c.json", json.dumps(rows[119], indent=indent)), written(tmp_path / "d.json", "[]"), written(tmp_path / "e.json", "")]
    got = [json.loads(r.record) for r in json_records(spark, paths, split_bytes).collect()]
    assert sorted(got, key=json.dumps) == sorted(rows, key=json.dumps)


def test_parsed_values_are_those_of_the_plain_reader(spark, tmp_path):
    text = json.dumps(records(200), ensure_ascii=False, separators=(",", ":"))
    (tmp_path / "in").mkdir()
    path = written(tmp_path / "in" / "a.json", text)
    written(tmp_path / "in" / "small.json", json.dumps(records(2, seed=9)))
    plain = sorted(map(repr, read_raw_history(spark, str(tmp_path / "in")).collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        frame = read_raw_history(spark, str(tmp_path / "in"))
        assert sorted(map(repr, frame.collect())) == plain and len(plain) == 202
        tasks = json_records(spark, [path], 1000).select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 0.8 * len(text.encode()) / 1000 and tasks > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("split_bytes", [30, 1000])
def test_a_truncated_file_loses_only_its_last_record(spark, tmp_path, split_bytes):
    text = json.dumps([{"a": str(i), "b": i} for i in range(40)])
    for cut in (len(text) - 2, len(text) - 6, len(text) - 12):
        got = [r.record for r in json_records(spark, [written(tmp_path / f"{cut}.json", text[:cut])], split_bytes).collect()]
        good = [r for r in got if r.endswith("}")]
        assert sorted(json.loads(r)["b"] for r in good) == list(range(39)) and len(got) == 40


def test_text_between_objects_is_a_malformed_record(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20")
    try:
        path = written(tmp_path / "a.json", '[{"NORAD_CAT_ID": "1"}, oops, {"NORAD_CAT_ID": 2},\n{"NORAD_CAT_ID": 3')
        good, bad = split_catalogue(spark, path)
        assert sorted(r.NORAD_CAT_ID for r in good.collect()) == [1, 2]
        assert sorted(len(r.faults) for r in bad.collect()) == [2, 2]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_state_of_every_byte():
    text = rb'{"a\\": "}\"{", "b": {"c": [1]}}'
    data = np.frombuffer(text, np.uint8)
    inside, escaped, depth, want = False, False, 0, []
    for c in text.decode():
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == '"':
            inside = not inside
        elif not inside:
            depth += (c == "{") - (c == "}")
        want.append((inside, depth))
    within = in_string(data, False)
    assert list(zip(within.tolist(), open_braces(data, within, 0).tolist())) == want
    walk = Walk(False, 0)
    assert walk.feed(text + b", ") == [text] and walk.rest == b", " and split(b", ") == []


def test_a_task_takes_many_small_ranges(spark, tmp_path):
    rows = records(150, seed=3)
    paths = [written(tmp_path / f"{i}.json", json.dumps(rows[15 * i:15 * i + 15], ensure_ascii=False)) for i in range(10)]
    frame = json_records(spark, paths, 40)
    ranges = sum(-(-len((tmp_path / f"{i}.json").read_bytes()) // 40) for i in range(10))
    assert ranges > 100 and frame.rdd.getNumPartitions() < ranges / 2
    assert sorted((json.loads(r.record) for r in frame.collect()), key=json.dumps) == sorted(rows, key=json.dumps)


@pytest.mark.parametrize("split_bytes", [37, 1000])
def test_starts_too_many_to_broadcast(spark, tmp_path, split_bytes):
    rows = records(120, seed=4)
    paths = [written(tmp_path / f"{i}.json", json.dumps(rows[60 * i:60 * i + 60], ensure_ascii=False, indent=1)) for i in range(2)]
    spark.conf.set("driftline.broadcastRows", "1")
    try:
        got = [json.loads(r.record) for r in json_records(spark, paths, split_bytes).collect()]
    finally:
        spark.conf.unset("driftline.broadcastRows")
    assert sorted(got, key=json.dumps) == sorted(rows, key=json.dumps)
