"""Queries again with series cut into many blocks, as long series are."""

from __future__ import annotations

from checks import ordered, selection, statistics  # noqa: F401
from checks.registry import ORACLES, QUERIES, query
from driftline.session import ROWS_PER_BLOCK_CONF

# Query and the rows that a block may hold; the objects have 45 to 99 rows.
CUT = {
    "w4_keplerian_residual": 25, "w6_lowess": 40, "w7_flagged_residual": 25, "w8_local_maxima": 25,
    "w9_distance_suppression": 25, "w10_prominence": 25, "w11_kalman_filter": 25,
    "detect_keplerian_unsmoothed": 25, "a1_grouped_history": 25, "a6_threshold": 25,
    "detect_keplerian": 40, "detect_j2": 40, "j3_compare_methods": 40, "w5_j2_residual": 25, "a7_sample_distance": 25, "s9_clip_per_object": 25,
    "a9_pooled_bounds": 500, "a9_pooled_price_bounds": 500, "a10_cluster_mean": 100,
    "a10_cluster_mean_all_objects": 500, "j5_grid_coverage": 100, "w13_interpolation": 50, "o6_chunks": 100,
}


def _cut(name: str, rows: int) -> None:
    run = QUERIES[name]

    def in_blocks(spark, sf):
        before = spark.conf.get(ROWS_PER_BLOCK_CONF, None)
        spark.conf.set(ROWS_PER_BLOCK_CONF, str(rows))
        try:
            return run(spark, sf)
        finally:
            if before is None:
                spark.conf.unset(ROWS_PER_BLOCK_CONF)
            else:
                spark.conf.set(ROWS_PER_BLOCK_CONF, before)

    query(f"{name}_in_blocks", ORACLES[name])(in_blocks)


for _name, _rows in CUT.items():
    _cut(_name, _rows)
