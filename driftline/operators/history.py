"""Reading and shaping of element histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions.values import axis_label
from driftline.operators.blocks import arrange, position
from driftline.operators.catalog import between_epochs


def latest_revision(
    history: DataFrame, entity: str = "norad", time: str = "epoch",
    creation: str = "creation_date", ties: list[str] | None = None,
) -> DataFrame:
    """The newest publication of each object and epoch; a missing date is the oldest.

    Without the creation column nothing is dropped. Ties are settled by ``ties``, by default
    all other columns, so that a recomputed task keeps the same row. Each map task keeps one
    row per key before the shuffle, so copies of one key do not pile up.
    """
    if creation not in history.columns:
        return history
    if ties is None:
        ties = [c for c in history.columns if c not in (entity, time, creation)]
    newest = W.partitionBy(entity, time).orderBy(
        F.col(creation).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in ties])
    return (history.withColumn("_rank", F.row_number().over(newest))
            .where(F.col("_rank") == 1).drop("_rank"))


def newest_in_order(
    history: DataFrame, entity: str = "norad", time: str = "epoch",
    creation: str = "creation_date", ties: list[str] | None = None,
) -> DataFrame:
    """``latest_revision`` for series of bounded length: the first row of each epoch, in order of the object.

    It asks for nothing but the rows of an object together, so what follows in time order needs no second exchange, and a table
    clustered by object none at all.
    """
    if creation not in history.columns:
        return history
    if ties is None:
        ties = [c for c in history.columns if c not in (entity, time, creation)]
    order = [F.col(time), *[F.col(c).desc_nulls_last() for c in (creation, *ties)]]
    before = F.lag(F.struct(time)).over(W.partitionBy(entity).orderBy(*order))
    marked = history.withColumn("_before", before)
    return marked.where(F.col("_before").isNull() | ~F.col(f"_before.{time}").eqNullSafe(F.col(time))).drop("_before")


def load_history(
    history: DataFrame, params: list[str], norads: list[int] | None = None, start=None, end=None,
    time: str = "epoch", ordered: bool = True,
) -> DataFrame:
    """Deduplicated ``norad``, time and ``params`` of the wanted objects and period.

    Both filters are on deduplication keys, so they go first and reach the scan.
    """
    picked = between_epochs(history, start, end, time)
    if norads is not None:
        picked = picked.where(F.col("norad").isin([int(n) for n in norads]))
    # Only what the result needs is read and shuffled; ties are settled by the values themselves.
    held = [c for c in ("creation_date",) if c in history.columns and c not in params]
    kept = latest_revision(picked.select("norad", time, *params, *held), time=time)
    kept = kept.select("norad", time, *params)
    return kept.orderBy("norad", time) if ordered else kept


def require_rows(history: DataFrame, what: str) -> DataFrame:
    """The frame itself; an empty one is an error."""
    if history.isEmpty():
        raise ValueError(f"no data for {what}")
    return history


def unpivot(history: DataFrame, params: list[str], time: str = "epoch") -> DataFrame:
    """Long series: ``norad``, time, ``param``, ``value``."""
    doubles = history.select("norad", time, *[F.col(p).cast("double").alias(p) for p in params])
    return doubles.unpivot(["norad", time], params, "param", "value")


def with_labels(series: DataFrame) -> DataFrame:
    return series.withColumn("label", axis_label(F.col("param")))


def grouped_pages(
    history: DataFrame, columns: list[str], page_rows: int = 1000, entity: str = "norad",
    time: str = "epoch",
) -> DataFrame:
    """Each object's rows as ordered lists of at most ``page_rows`` structs, one row per page."""
    placed = arrange(history.select(entity, time, *columns), [entity], time).extend(_at=position())
    paged = placed.result().withColumn("page", F.expr(f"_at div {int(page_rows)}"))
    records = F.array_sort(F.collect_list(F.struct("_at", time, *columns)))
    return paged.groupBy(entity, "page").agg(records.alias("_records")).select(
        entity, "page",
        F.transform("_records", lambda item_: item_.dropFields("_at")).alias("records"))


def counts(history: DataFrame, entity: str = "norad") -> DataFrame:
    """Rows and distinct objects, in one row."""
    per_object = history.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
    return per_object.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(entity).alias("n_objects"))


def concatenate(batches: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), batches)


def distinct_in_order(ids: DataFrame, key: str, at: str) -> DataFrame:
    """Each id once, at its first position."""
    return ids.groupBy(key).agg(F.min(at).alias(at)).orderBy(at)
