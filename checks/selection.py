"""Filters, joins, ordering, batching and set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.adapters import CATALOGUE_SQL, H, REVISED_SQL, catalogue, history, revised, table
from checks.registry import ORACLES, query, rounded, rsql
from driftline.functions.values import is_finite
from driftline.operators import catalog as C
from driftline.operators.history import (
    concatenate, distinct_in_order, latest_revision, load_history, newest_in_order, require_rows, unpivot)
from driftline.session import new_path
from driftline.sources.readers import read_clustered
from driftline.sources.writers import write_clustered

_RULES = [C.Rule(), C.Rule("Customer#00000000"), C.Rule("", "BUILDING")]
_START, _END = dt.date(2024, 1, 5), dt.date(2024, 1, 20)
_ALL = "norad_cat_id, object_name, country_code, object_type, semimajor_axis"


@query("f1_payloads", f"select {_ALL} from {CATALOGUE_SQL} where object_type = 'PAYLOAD'")
def f1(spark, sf):
    return C.payloads(catalogue(spark, sf))


@query("f2_orbit_range", f"select {_ALL} from {CATALOGUE_SQL} where semimajor_axis between 0 and 5000")
def f2(spark, sf):
    return C.in_orbit_range(catalogue(spark, sf), 0.0, 5000.0)


@query("f3_name_prefix", f"select {_ALL}, 'Customer#00000_ALL' as rule from {CATALOGUE_SQL} "
       "where object_type = 'PAYLOAD' and starts_with(object_name, 'Customer#00000')")
def f3(spark, sf):
    return C.match_rules(catalogue(spark, sf), [C.Rule("Customer#00000")]).drop("rule_no")


@query("f4_country", f"select {_ALL}, 'ALL_MACHINERY' as rule from {CATALOGUE_SQL} "
       "where object_type = 'PAYLOAD' and country_code = 'MACHINERY'")
def f4(spark, sf):
    return C.match_rules(catalogue(spark, sf), [C.Rule("", "MACHINERY")]).drop("rule_no")


@query("f5_epoch_range_dates", f"""with {H} select norad, epoch, rev_at_epoch from h
where epoch >= timestamp '2024-01-05' and epoch <= timestamp '2024-01-20'""")
def f5(spark, sf):
    return C.between_epochs(history(spark, sf), _START, _END).select("norad", "epoch", "rev_at_epoch")


@query("f6_entity_filter", f"with {H} select norad, epoch, {rsql('sma')} as sma from h where norad = 7")
def f6(spark, sf):
    return load_history(history(spark, sf), ["sma"], [7]).withColumn("sma", rounded("sma"))


_NEWEST = f"""select norad, epoch, creation_seq, tiebreak, sma, eccentricity from (select *, row_number() over (
  partition by norad, epoch order by creation_seq desc, tiebreak desc, sma desc, eccentricity desc) as rk from {REVISED_SQL}) where rk = 1"""


@query("f7_epoch_range_after_dedup", f"""select norad, epoch, sma, eccentricity from ({_NEWEST})
where epoch >= timestamp '1996-01-01' and epoch <= timestamp '1999-12-31'""")
def f7(spark, sf):
    newest = latest_revision(revised(spark, sf), creation="creation_seq",
                             ties=["tiebreak", "sma", "eccentricity"])
    return C.between_epochs(newest, dt.date(1996, 1, 1), dt.date(1999, 12, 31)).select(
        "norad", "epoch", "sma", "eccentricity")


@query("f8_projection", f"with {H} select norad, epoch, {rsql('sma')} as sma, inclination from h")
def f8(spark, sf):
    rows = load_history(history(spark, sf), ["sma", "inclination"])
    return rows.withColumn("sma", rounded("sma"))


@query("f9_finite", """select user_id, event_id, value from events
where event_id % 5 <> 0 and event_id % 7 <> 0 and event_id % 11 <> 0""")
def f9(spark, sf):
    odd = (F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("-inf")))
           .when(F.col("event_id") % 11 != 0, F.col("value")))
    rows = table(spark, sf, "events").withColumn("value", odd)
    return rows.where(is_finite(F.col("value"))).select("user_id", "event_id", "value")


@query("f10_non_empty_guard", f"with {H} select norad, count(*) as n from h group by norad")
def f10(spark, sf):
    rows = require_rows(history(spark, sf), "the whole table")
    return rows.groupBy("norad").agg(F.count(F.lit(1)).alias("n"))


@query("j1_history_of_ids", f"""with {H} select norad, epoch, rev_at_epoch from h
where norad in (select norad_cat_id from {CATALOGUE_SQL} where object_type = 'PAYLOAD')""")
def j1(spark, sf):
    return C.history_of(history(spark, sf), C.payloads(catalogue(spark, sf))).select("norad", "epoch", "rev_at_epoch")


@query("j2_rule_join", f"""select rule, norad_cat_id from {CATALOGUE_SQL} c, (values ('ALL_ALL', '', ''),
  ('Customer#00000000_ALL', 'Customer#00000000', ''), ('ALL_BUILDING', '', 'BUILDING')) r(rule, pattern, country)
where object_type = 'PAYLOAD' and semimajor_axis between 0 and 5000
  and (pattern = '' or starts_with(object_name, pattern)) and (country = '' or country_code = country)""")
def j2(spark, sf):
    return C.match_rules(catalogue(spark, sf), _RULES, (0.0, 5000.0)).select("rule", "norad_cat_id")


@query("o1_order_by_id", f"select {_ALL} from {CATALOGUE_SQL} order by norad_cat_id")
def o1(spark, sf):
    return catalogue(spark, sf).orderBy("norad_cat_id")


@query("o2_first_n", f"select norad_cat_id from {CATALOGUE_SQL} where object_type = 'PAYLOAD' order by norad_cat_id limit 300")
def o2(spark, sf):
    return C.first_n(C.payloads(catalogue(spark, sf)), 300).select("norad_cat_id")


@query("o2_first_n_per_rule", f"""select rule, norad_cat_id from (select rule, norad_cat_id,
  row_number() over (partition by rule order by norad_cat_id) as rk from {CATALOGUE_SQL} c, (values ('ALL_ALL', '', ''),
  ('Customer#00000000_ALL', 'Customer#00000000', ''), ('ALL_BUILDING', '', 'BUILDING')) r(rule, pattern, country)
where object_type = 'PAYLOAD' and (pattern = '' or starts_with(object_name, pattern)) and (country = '' or country_code = country))
where rk <= 50""")
def o2_rule(spark, sf):
    return C.first_n_per_rule(C.match_rules(catalogue(spark, sf), _RULES), 50).select("rule", "norad_cat_id")


@query("o3_random_n", f"select norad_cat_id from {CATALOGUE_SQL} where object_type = 'PAYLOAD' "
       "order by md5(concat(norad_cat_id, ':42')), norad_cat_id limit 300")
def o3(spark, sf):
    return C.random_n(C.payloads(catalogue(spark, sf)), 300, seed=42).select("norad_cat_id")


_RANDOM_RANKED = f"""(select rule, norad_cat_id, row_number() over (partition by rule order by md5(concat(norad_cat_id, ':7')), norad_cat_id) as rk
from {CATALOGUE_SQL} c, (values ('ALL_ALL', '', ''), ('Customer#00000000_ALL', 'Customer#00000000', ''), ('ALL_BUILDING', '', 'BUILDING')) r(rule, pattern, country)
where object_type = 'PAYLOAD' and (pattern = '' or starts_with(object_name, pattern)) and (country = '' or country_code = country))"""


@query("o3_random_n_per_rule", f"select rule, norad_cat_id from {_RANDOM_RANKED} where rk <= 50")
def o3_rule(spark, sf):
    return C.first_n_per_rule(C.match_rules(catalogue(spark, sf), _RULES), 50, seed=7).select("rule", "norad_cat_id")


@query("o3_random_half_per_rule", f"select rule, norad_cat_id from {_RANDOM_RANKED} where rk <= 1200")
def o3_many(spark, sf):
    """More than a window trims to: ranks of the whole series."""
    return C.first_n_per_rule(C.match_rules(catalogue(spark, sf), _RULES), 1200, seed=7).select("rule", "norad_cat_id")


@query("o4_order_by_id_epoch", f"with {H} select norad, epoch, rev_at_epoch from h order by norad, epoch")
def o4(spark, sf):
    return load_history(history(spark, sf), ["rev_at_epoch"])


@query("o5_sort_by_time", f"with {H} select epoch, norad from h order by epoch")
def o5(spark, sf):
    return history(spark, sf).select("epoch", "norad").orderBy("epoch")


@query("o6_chunks", f"""select norad_cat_id, (row_number() over (order by norad_cat_id) - 1) // 50 as batch_id
from {CATALOGUE_SQL} where object_type = 'PAYLOAD'""")
def o6(spark, sf):
    return C.chunked(C.payloads(catalogue(spark, sf)).select("norad_cat_id"), 50)


@query("su1_concatenate", f"""with {H} select norad, epoch from h where epoch < timestamp '2024-01-10'
union all select norad, epoch from h where epoch >= timestamp '2024-01-10'""")
def su1(spark, sf):
    rows = history(spark, sf).select("norad", "epoch")
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    return concatenate([rows.where(F.col("epoch") < cut), rows.where(F.col("epoch") >= cut)])


@query("su2_distinct_in_order", "select user_id, min(event_id) as event_id from events group by user_id order by 2")
def su2(spark, sf):
    return distinct_in_order(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("su4_unpivot", f"with {H} " + " union all ".join(
    f"select norad, epoch, '{p}' as param, {p} as value from h" for p in ("inclination", "eccentricity", "bstar")))
def su4(spark, sf):
    return unpivot(history(spark, sf), ["inclination", "eccentricity", "bstar"])


@query("w1_latest_revision", _NEWEST)
def w1(spark, sf):
    return latest_revision(revised(spark, sf), creation="creation_seq", ties=["tiebreak", "sma", "eccentricity"])


def _clustered(spark, rows):
    path = new_path(spark, "clustered")
    write_clustered(rows, path, 8)
    return read_clustered(spark, path)


@query("f6_clustered_history", ORACLES["f6_entity_filter"])
def f6_clustered(spark, sf):
    return load_history(_clustered(spark, history(spark, sf)), ["sma"], [7]).withColumn("sma", rounded("sma"))


@query("j1_clustered_history", ORACLES["j1_history_of_ids"])
def j1_clustered(spark, sf):
    rows = _clustered(spark, history(spark, sf))
    return C.history_of(rows, C.payloads(catalogue(spark, sf))).select("norad", "epoch", "rev_at_epoch")


@query("w1_clustered_history", _NEWEST)
def w1_clustered(spark, sf):
    return latest_revision(_clustered(spark, revised(spark, sf)), creation="creation_seq", ties=["tiebreak", "sma", "eccentricity"])


@query("w1_newest_in_order", _NEWEST)
def w1_in_order(spark, sf):
    return newest_in_order(revised(spark, sf), creation="creation_seq", ties=["tiebreak", "sma", "eccentricity"])
