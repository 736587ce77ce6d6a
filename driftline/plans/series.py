"""Histories shaped for charts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from driftline.operators.clipping import clip_series
from driftline.operators.cluster import cluster_mean, join_members
from driftline.operators.history import load_history, unpivot, with_labels
from driftline.session import materialise


def chart_series(
    history: DataFrame, params: list[str], norads: list[int] | None = None, start=None, end=None,
    pooled: bool = False, limits: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """``norad, epoch, param, value, label`` of all wanted objects from one scan.

    ``pooled`` clips all objects at common bounds, as for a comparison of objects.
    """
    loaded = load_history(history, params, norads, start, end, ordered=False)
    # The bounds and the series both read it: deduplicate once.
    loaded = materialise(loaded, "loaded")
    return with_labels(clip_series(unpivot(loaded, params), pooled, limits))


def cluster_series(
    history: DataFrame, members: DataFrame, params: list[str], start=None, end=None,
) -> DataFrame:
    """``cluster, param, epoch, mean, n_members, label`` on each cluster's common grid."""
    loaded = materialise(load_history(history, params, None, start, end, ordered=False), "loaded")
    series = join_members(unpivot(loaded, params), members)
    return with_labels(cluster_mean(series, ["cluster", "param"])).select(
        "cluster", "param", "epoch", "mean", "n_members", "label")
