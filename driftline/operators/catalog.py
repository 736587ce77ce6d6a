"""Selection of objects from a catalogue, and of their history."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.operators.blocks import arrange, position
from driftline.session import join_small, materialise

# Spark trims groups before the shuffle only up to this rank.
_TRIMMED_RANK = 1000


@dataclass(frozen=True)
class Rule:
    """One selection; an empty pattern or country matches everything."""

    name_pattern: str = ""
    country: str = ""

    @property
    def tag(self) -> str:
        return f"{self.name_pattern or 'ALL'}_{self.country or 'ALL'}"

    def matches(self) -> Column:
        tests = [F.lit(True)]
        if self.name_pattern:
            tests.append(F.col("object_name").startswith(self.name_pattern))
        if self.country:
            tests.append(F.col("country_code") == self.country)
        return reduce(lambda a, b: a & b, tests)


def payloads(catalogue: DataFrame) -> DataFrame:
    return catalogue.where(F.col("object_type") == "PAYLOAD")


def in_orbit_range(catalogue: DataFrame, lower: float | None, upper: float | None) -> DataFrame:
    """Inclusive range of the semi-major axis; without both bounds no restriction."""
    if lower is None or upper is None:
        return catalogue
    return catalogue.where(F.col("semimajor_axis").between(lower, upper))


def match_rules(
    catalogue: DataFrame, rules: list[Rule], orbit_range: tuple[float, float] | None = None,
) -> DataFrame:
    """One row per payload and matching rule, with ``rule``, its tag, and ``rule_no``, its place in the list.

    Different rules may read alike as tags, and a rule may be listed twice; ``rule_no`` tells
    them apart. The rules come from the job's configuration, so they are part of the plan: a single pass
    over the catalogue without a join, and their common part reaches the scan.
    """
    picked = in_orbit_range(payloads(catalogue), *(orbit_range or (None, None)))
    if not rules:
        return picked.where(F.lit(False)).withColumns({"rule": F.lit(""), "rule_no": F.lit(0)})
    picked = picked.where(reduce(lambda a, b: a | b, [r.matches() for r in rules]))
    hits = F.array_compact(F.array(*[
        F.when(r.matches(), F.struct(F.lit(r.tag).alias("rule"), F.lit(i).alias("rule_no"))) for i, r in enumerate(rules)]))
    return picked.withColumn("_hit", F.explode(hits)).select("*", "_hit.*").drop("_hit")


def first_n(catalogue: DataFrame, n: int, key: str = "norad_cat_id") -> DataFrame:
    """The ``n`` smallest ids, in order."""
    return catalogue.orderBy(key).limit(n)


def shuffled(key: str, seed: int) -> Column:
    """A place in an order that depends on id and seed alone: the MD5 of both as text, which other engines have, too, to 60 bits."""
    text = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def first_n_per_rule(matches: DataFrame, n: int | None, key: str = "norad_cat_id", seed: int | None = None) -> DataFrame:
    """The ``n`` smallest ids of every rule, or with a ``seed`` ``n`` at random, one row each; all of them without ``n``.

    Rules are told apart by ``rule_no``, or by ``rule`` in a table without it. A random choice is the same for any
    partitioning, and each rule has its own part of one order.
    """
    rule = "rule_no" if "rule_no" in matches.columns else "rule"
    distinct = matches.dropDuplicates([rule, key])
    if n is None:
        return distinct
    placed = distinct.withColumn("_place", F.col(key) if seed is None else shuffled(key, seed))
    if n <= _TRIMMED_RANK:
        rank = F.row_number().over(W.partitionBy(rule).orderBy("_place", key))
        return placed.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank", "_place")
    ranked = arrange(placed, [rule], "_place").extend(_rank=position(1))
    return ranked.where(F.col("_rank") <= n).drop("_rank", "_place").result()


def random_n(catalogue: DataFrame, n: int, seed: int, key: str = "norad_cat_id") -> DataFrame:
    """``n`` ids in an order that depends on the seed alone, not on the partitioning."""
    return catalogue.orderBy(shuffled(key, seed), key).limit(n)


def chunked(ids: DataFrame, size: int, key: str = "norad_cat_id") -> DataFrame:
    """Add ``batch_id``: consecutive ids in groups of ``size``."""
    numbered = arrange(ids, [], key).extend(_at=position())
    return numbered.with_columns(
        {"batch_id": F.expr(f"_at div {int(size)}")}).drop("_at").result()


def history_of(history: DataFrame, ids: DataFrame, id_column: str = "norad_cat_id") -> DataFrame:
    """History of the listed objects; a long list joins by shuffle instead of broadcast."""
    wanted = materialise(ids.select(F.col(id_column).alias("norad")).distinct(), "ids")
    return join_small(history, wanted, ["norad"], "left_semi")


def between_epochs(
    history: DataFrame, start=None, end=None, time: str = "epoch",
) -> DataFrame:
    """Inclusive time range; a date means its midnight."""
    if start is not None:
        history = history.where(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        history = history.where(F.col(time) <= F.lit(end).cast("timestamp_ntz"))
    return history
