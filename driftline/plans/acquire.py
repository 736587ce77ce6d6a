"""Landed records to a typed, tagged history table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.catalog import Rule, first_n_per_rule, match_rules
from driftline.session import join_small, materialise
from driftline.sources.readers import read_catalogue, read_raw_history, split_catalogue, split_history, typed_history
from driftline.sources.writers import write_history, write_rejects


def lower_names(catalogue: DataFrame) -> DataFrame:
    return catalogue.toDF(*[c.lower() for c in catalogue.columns])


class Acquired(NamedTuple):
    """Rows written and records rejected."""

    rows: int
    rejects: int


def select_objects(
    catalogue: DataFrame, rules: list[Rule], orbit_range: tuple[float, float] | None = None,
    per_rule: int | None = None, seed: int | None = None,
) -> DataFrame:
    """``rule``, ``rule_no`` and ``norad_cat_id`` of the first ``per_rule`` objects of every rule, or of all.

    With a ``seed`` they are ``per_rule`` objects at random.
    """
    matches = match_rules(lower_names(catalogue), rules, orbit_range)
    return first_n_per_rule(matches.select("rule", "rule_no", "norad_cat_id"), per_rule, seed=seed)


def _of_selection(raw: DataFrame, chosen: DataFrame, start, end) -> DataFrame:
    """The raw records of chosen objects inside the time range, and those that may be: ids or epochs that can't be read.

    Only id and epoch are cast here, before anything else of a record is parsed.
    """
    keyed = raw.withColumn("_id", F.col("NORAD_CAT_ID").try_cast("bigint"))
    ids = chosen.select(F.col("norad").alias("_id")).distinct().withColumn("_chosen", F.lit(True))
    held = join_small(keyed, materialise(ids, "chosen-ids"), ["_id"], "left")
    epoch = F.col("EPOCH").try_cast("timestamp_ntz")
    inside = F.lit(True)
    if start is not None:
        inside &= epoch >= F.lit(start).cast("timestamp_ntz")
    if end is not None:
        inside &= epoch <= F.lit(end).cast("timestamp_ntz")
    wanted = F.col("_id").isNull() | (F.col("_chosen") & F.coalesce(inside, F.lit(True)))
    return held.where(wanted).select(*raw.columns)


def selected_history(
    raw: DataFrame, chosen: DataFrame, start=None, end=None, strict: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """Typed history of the chosen objects with their ``rule``, and the rejected records.

    An object chosen by several rules appears once per rule, its rejects once. Records of other objects or
    times are neither parsed nor rejected. Strict reading has no rejects: an unusable record fails the job.
    """
    chosen = materialise(chosen.withColumnRenamed("norad_cat_id", "norad"), "chosen")
    records = _of_selection(raw, chosen, start, end)
    typed, rejects = (typed_history(records), None) if strict else split_history(records)
    return join_small(typed, chosen, ["norad"], "inner"), rejects


def acquire(
    spark: SparkSession, catalogue_path: str, history_path: str, out_path: str,
    rules: list[Rule], run: str, orbit_range: tuple[float, float] | None = None,
    start=None, end=None, per_rule: int | None = None, strict: bool = True, array_files: bool = True,
    seed: int | None = None,
) -> Acquired:
    """The whole job for all rules at once; returns the numbers of rows written and of records rejected.

    ``per_rule`` takes the smallest ids of each rule, or with a ``seed`` as many at random. Rows carry ``rule_no``, the place of their rule: rules that read alike share a tag, and so a folder. Without
    ``strict``, rejected records go to ``<out_path>-rejects/<run>/history`` and ``.../catalogue``.
    """
    aside = f"{out_path.rstrip('/')}-rejects/{run}"
    rejected = 0
    if strict:
        catalogue = read_catalogue(spark, catalogue_path, array_files)
    else:
        catalogue, bad = split_catalogue(spark, catalogue_path, array_files)
        rejected += write_rejects(bad, f"{aside}/catalogue")
    chosen = select_objects(catalogue, rules, orbit_range, per_rule, seed)
    rows, bad = selected_history(read_raw_history(spark, history_path, array_files), chosen, start, end, strict)
    if bad is not None:
        rejected += write_rejects(bad, f"{aside}/history")
    pattern, country = F.lit(""), F.lit("")
    for number, rule in enumerate(rules):
        hit = F.col("rule_no") == number
        pattern = F.when(hit, F.lit(rule.name_pattern)).otherwise(pattern)
        country = F.when(hit, F.lit(rule.country)).otherwise(country)
    return Acquired(write_history(rows, out_path, pattern, country, F.lit(run)), rejected)
