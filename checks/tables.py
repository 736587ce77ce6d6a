"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapters import CATALOGUE_SQL, H, RAW_SQL, catalogue, history, landed, raw_history
from checks.registry import query, rounded, rsql
from driftline.functions.values import output_tag
from driftline.schema import DERIVED, RAW_HISTORY_FIELDS
from driftline.session import new_path
from driftline.sources.readers import (
    read_catalogue, read_history, read_raw_history, split_history, typed_history)
from driftline.sources.writers import export_csv, write_history

_CATALOGUE = "NORAD_CAT_ID, OBJECT_NAME, COUNTRY_CODE, OBJECT_TYPE, SEMIMAJOR_AXIS"


@query("io1_read_catalogue", f"""select {', '.join(f'{c.strip().lower()} as {c.strip()}' for c in _CATALOGUE.split(','))}
from {CATALOGUE_SQL}""")
def io1(spark, sf):
    rows = catalogue(spark, sf)
    rows = rows.toDF(*[c.upper() for c in rows.columns])
    path = landed(rows, new_path(spark, "catalogue"), "NORAD_CAT_ID")
    return read_catalogue(spark, path, array_files=False)


@query("io2_read_raw_history", f"with {H} select {', '.join(RAW_HISTORY_FIELDS)} from {RAW_SQL}")
def io2(spark, sf):
    path = landed(raw_history(spark, sf), new_path(spark, "history"), "cast(REV_AT_EPOCH as bigint)")
    return read_raw_history(spark, path, array_files=False)


_DOUBLES = ["inclination", "raan", "arg_perigee", "mean_anomaly", "mean_motion", "eccentricity", "bstar", *DERIVED]
_EXACT = ["norad", "object_name", "epoch", "creation_date", "rev_at_epoch"]
GM_SQL, PI_SQL = "398600441800000e0", "3.14159265358979e0"
_TYPED = f"""select {', '.join(_EXACT)}, {', '.join(f'{rsql(c, 9 if c == "bstar" else 6)} as {c}' for c in _DOUBLES)}
from (select *, sma * (1e0 + eccentricity) - 6378.137e0 as apogee,
  2e0 * {PI_SQL} * sqrt(pow(sma * 1e3, 3) / {GM_SQL}) as period, sqrt({GM_SQL} / (sma * 1e3)) as velocity from h)"""


def _typed(rows):
    return rows.select(*_EXACT, *[rounded(c, 9 if c == "bstar" else 6).alias(c) for c in _DOUBLES])


def _landed_text(rows, path, key):
    """Records with every value as text, one JSON array per file."""
    text = rows.select([F.col(c).cast("string").alias(c) for c in rows.columns])
    batches = text.groupBy(F.expr(f"cast({key} as bigint) div 500").alias("_batch")).agg(
        F.to_json(F.collect_list(F.struct(*text.columns))).alias("value"))
    batches.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("io1_text_catalogue_in_array_files", f"""select {', '.join(f'{c.strip().lower()} as {c.strip()}' for c in _CATALOGUE.split(','))}
from {CATALOGUE_SQL}""")
def io1_text(spark, sf):
    rows = catalogue(spark, sf)
    rows = rows.toDF(*[c.upper() for c in rows.columns])
    return read_catalogue(spark, _landed_text(rows, new_path(spark, "catalogue"), "NORAD_CAT_ID"))


@query("io2_raw_history_in_array_files", f"with {H} select {', '.join(RAW_HISTORY_FIELDS)} from {RAW_SQL}")
def io2_arrays(spark, sf):
    return read_raw_history(spark, _landed_text(raw_history(spark, sf), new_path(spark, "history"), "REV_AT_EPOCH"))


@query("io2_split_array_files", f"with {H} select {', '.join(RAW_HISTORY_FIELDS)} from {RAW_SQL}")
def io2_split(spark, sf):
    """Array files above the size of a split, each read by several tasks."""
    path = _landed_text(raw_history(spark, sf), new_path(spark, "history"), "REV_AT_EPOCH")
    return read_raw_history(spark, path, split_bytes=32_768)


@query("io3_typed_rows", f"with {H} {_TYPED}")
def io3(spark, sf):
    return _typed(typed_history(raw_history(spark, sf)))


_SPOILED = {"ECCENTRICITY": (17, "'n/a'"), "EPOCH": (23, "'2024-13-45'"), "MEAN_MOTION": (29, "null"),
            "REV_AT_EPOCH": (31, "'12.5'")}


@query("io3_rejects", f"""with {H}, r as (select *, cast(REV_AT_EPOCH as bigint) as id from {RAW_SQL}),
f as (select unnest(list_filter([{', '.join(f"case when id % {m} = 0 then '{f}' end" for f, (m, _) in _SPOILED.items())}],
  lambda x: x is not null)) as fault from r)
select fault, count(*) as n from f group by fault
union all select 'usable', count(*) from r where {' and '.join(f'id % {m} <> 0' for m, _ in _SPOILED.values())}""")
def io3_rejects(spark, sf):
    raw = raw_history(spark, sf).withColumn("id", F.col("REV_AT_EPOCH").cast("bigint"))
    for field, (m, text) in _SPOILED.items():
        raw = raw.withColumn(field, F.when(F.col("id") % m == 0, F.expr(text).cast("string")).otherwise(F.col(field)))
    good, bad = split_history(raw.drop("id"))
    faults = bad.select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))
    return faults.unionByName(good.select(F.lit("usable").alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("n")))


@query("io4_parquet_scan", f"""with {H} select norad, epoch, creation_date, {rsql('mean_motion')} as mean_motion,
true as has_creation_date from h""")
def io4(spark, sf):
    path = new_path(spark, "scan")
    history(spark, sf).write.parquet(path)
    rows = read_history(spark, path)
    return rows.select("norad", "epoch", "creation_date", rounded("mean_motion").alias("mean_motion"),
                       F.lit("creation_date" in rows.columns).alias("has_creation_date"))


@query("io5_parquet_sink", f"""with {H} select tag, '2024-02-01' as run, norad, n, first_epoch, cast(sum(n) over () as bigint) as n_written
from (select 'SAT_ALL' as tag, norad, count(*) as n, min(epoch) as first_epoch from h group by norad)""")
def io5(spark, sf):
    path = new_path(spark, "sink")
    written = write_history(history(spark, sf), path, F.lit("SAT"), F.lit(""), F.lit("2024-02-01"))
    back = spark.read.parquet(path).groupBy("tag", "run", "norad").agg(
        F.count(F.lit(1)).alias("n"), F.min("epoch").alias("first_epoch"))
    return back.select("tag", F.date_format("run", "yyyy-MM-dd").alias("run"), "norad", "n", "first_epoch",
                       F.lit(written).cast("bigint").alias("n_written"))


@query("io6_output_tag", f"""select concat_ws('_', coalesce(nullif(pattern, ''), 'ALL'), coalesce(nullif(country, ''), 'ALL')) as tag,
count(*) as n from (select case when norad_cat_id % 3 = 0 then '' else 'SAT' end as pattern,
case when object_type = 'DEBRIS' then '' else country_code end as country from {CATALOGUE_SQL}) group by 1""")
def io6(spark, sf):
    rows = catalogue(spark, sf)
    pattern = F.when(F.col("norad_cat_id") % 3 == 0, F.lit("")).otherwise(F.lit("SAT"))
    country = F.when(F.col("object_type") == "DEBRIS", F.lit("")).otherwise(F.col("country_code"))
    return rows.groupBy(output_tag(pattern, country).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("io7_csv_export", f"with {H} select norad, epoch, {rsql('sma')} as sma, {rsql('bstar', 9)} as bstar from h")
def io7(spark, sf):
    path = new_path(spark, "export")
    rows = history(spark, sf)
    export_csv(rows, path)
    back = spark.read.option("header", True).schema(rows.schema).csv(path)
    return back.select("norad", "epoch", rounded("sma").alias("sma"), rounded("bstar", 9).alias("bstar"))


@query("acquire_selected_history", f"""with {H}, c as {CATALOGUE_SQL}, rules as (
  select * from (values ('Customer#00000000_ALL', 'Customer#00000000', ''), ('ALL_BUILDING', '', 'BUILDING')) r(rule, pattern, country)),
m as (select rule, norad_cat_id, row_number() over (partition by rule order by norad_cat_id) as rk from c, rules
  where object_type = 'PAYLOAD' and semimajor_axis between 0 and 5000 and (pattern = '' or starts_with(object_name, pattern))
  and (country = '' or country_code = country))
select rule, norad, epoch, {rsql('sma')} as sma from h join m on norad = norad_cat_id
where rk <= 300 and epoch between timestamp '2024-01-03' and timestamp '2024-01-25'""")
def acquire_check(spark, sf):
    import datetime as dt

    from driftline.operators.catalog import Rule
    from driftline.plans.acquire import select_objects, selected_history
    chosen = select_objects(catalogue(spark, sf), [Rule("Customer#00000000", ""), Rule("", "BUILDING")], (0.0, 5000.0), 300)
    rows, _ = selected_history(raw_history(spark, sf), chosen, dt.date(2024, 1, 3), dt.date(2024, 1, 25))
    return rows.select("rule", "norad", "epoch", rounded("sma").alias("sma"))


@query("acquire_random", f"""with {H}, c as {CATALOGUE_SQL}, rules as (
  select * from (values ('Customer#00000000_ALL', 'Customer#00000000', ''), ('ALL_BUILDING', '', 'BUILDING')) r(rule, pattern, country)),
m as (select rule, norad_cat_id, row_number() over (partition by rule order by md5(concat(norad_cat_id, ':11')), norad_cat_id) as rk from c, rules
  where object_type = 'PAYLOAD' and (pattern = '' or starts_with(object_name, pattern)) and (country = '' or country_code = country))
select rule as tag, norad, count(*) as n, min(epoch) as first_epoch from h join m on norad = norad_cat_id where rk <= 20 group by all""")
def acquire_random(spark, sf):
    """The whole job with objects at random, from landed files to the tagged table."""
    from driftline.operators.catalog import Rule
    from driftline.plans.acquire import acquire
    rows = catalogue(spark, sf)
    at = _landed_text(rows.toDF(*[c.upper() for c in rows.columns]), new_path(spark, "catalogue"), "NORAD_CAT_ID")
    landed_at, out = _landed_text(raw_history(spark, sf), new_path(spark, "history"), "REV_AT_EPOCH"), new_path(spark, "acquired")
    acquire(spark, at, landed_at, out, [Rule("Customer#00000000", ""), Rule("", "BUILDING")], "run1", per_rule=20, seed=11)
    return read_history(spark, out).groupBy("tag", "norad").agg(F.count(F.lit(1)).alias("n"), F.min("epoch").alias("first_epoch"))


_JOB_RULES = [("", ""), ("Customer#00000000", ""), ("ALL", ""), ("", ""), ("", "BUILDING")]


@query("acquire_written", f"""with {H}, raw as {RAW_SQL}, c as {CATALOGUE_SQL},
rules as (select * from (values {', '.join(f"({n}, '{p or 'ALL'}_{k or 'ALL'}', '{p}', '{k}')" for n, (p, k) in enumerate(_JOB_RULES))}) r(rule_no, tag, pattern, country)),
m as (select distinct rule_no, tag, norad_cat_id from c, rules where object_type = 'PAYLOAD' and semimajor_axis between 0 and 5000
  and (pattern = '' or starts_with(object_name, pattern)) and (country = '' or country_code = country)),
r as (select cast(NORAD_CAT_ID as bigint) as id, cast(REV_AT_EPOCH as bigint) as rev, cast(EPOCH as timestamp) as seen from raw),
hit as (select * from r where rev % 37 <> 0 and id in (select norad_cat_id from m) and (rev % 23 = 0 or seen between timestamp '2024-01-03' and timestamp '2024-01-25'))
select tag, rule_no, id as norad, count(*) as n from hit join m on id = norad_cat_id where rev % 17 <> 0 and rev % 23 <> 0 group by all
union all select 'rejects', -1, -1, (select count(*) from r where rev % 37 = 0) + (select count(*) from hit where rev % 17 = 0 or rev % 23 = 0)""")
def acquire_written(spark, sf):
    """JSON landed with spoiled values, the whole job with rules that overlap and read alike, and what it wrote."""
    import datetime as dt

    from driftline.operators.catalog import Rule
    from driftline.plans.acquire import acquire
    raw = raw_history(spark, sf).withColumn("rev", F.col("REV_AT_EPOCH").cast("bigint"))
    for field, m, text in (("ECCENTRICITY", 17, "n/a"), ("EPOCH", 23, "2024-13-45"), ("NORAD_CAT_ID", 37, "A7")):
        raw = raw.withColumn(field, F.when(F.col("rev") % m == 0, F.lit(text)).otherwise(F.col(field)))
    rows = catalogue(spark, sf)
    at = _landed_text(rows.toDF(*[c.upper() for c in rows.columns]), new_path(spark, "catalogue"), "NORAD_CAT_ID")
    landed_at, out = _landed_text(raw.drop("rev"), new_path(spark, "history"), "REV_AT_EPOCH"), new_path(spark, "acquired")
    done = acquire(spark, at, landed_at, out, [Rule(*r) for r in _JOB_RULES], "run1", (0.0, 5000.0),
                   dt.date(2024, 1, 3), dt.date(2024, 1, 25), strict=False)
    back = read_history(spark, out).groupBy("tag", "rule_no", "norad").agg(F.count(F.lit(1)).alias("n"))
    rejects = spark.read.parquet(f"{out}-rejects/run1/history").agg(F.count(F.lit(1)).alias("n"))
    if rejects.head().n != done.rejects:
        raise ValueError("the count of rejects differs from what was written")
    return back.unionByName(rejects.select(F.lit("rejects").alias("tag"), F.lit(-1).alias("rule_no"), F.lit(-1).cast("bigint").alias("norad"), "n"))
