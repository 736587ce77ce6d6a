"""Run queries against their SQL: ``python -m checks.run [scale] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

from checks import ORACLES, QUERIES
from driftline.session import build_session

TABLES = "events lineitem customer supplier part orders nation region".split()


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as text, rows in order."""
    out = pd.DataFrame(index=frame.index)
    for name in sorted(frame.columns):
        column = frame[name]
        out[name] = ["" if v is None or v is pd.NaT or v != v else
                     str(pd.Timestamp(v)) if hasattr(v, "year") else
                     repr(float(v)) if type(v).__name__ in ("Decimal", "float", "float64") else str(v) for v in column]
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def compare(spark, base: str, name: str) -> tuple[bool, str]:
    start = time.time()
    got = QUERIES[name](spark, base).toPandas()
    took = time.time() - start
    if name not in ORACLES:
        return len(got) > 0, f"{len(got)} rows, no SQL, {took:.1f}s"
    link = duckdb.connect()
    for t in TABLES:
        link.execute(f"create view {t} as select * from read_parquet('{base}/{t}.parquet')")
    start = time.time()
    want = link.execute(ORACLES[name]).df()
    note = f"{len(got)} rows, spark {took:.1f}s, sql {time.time() - start:.1f}s"
    if sorted(got.columns) != sorted(want.columns):
        return False, f"{note}: columns {sorted(got.columns)} against {sorted(want.columns)}"
    if len(got) != len(want):
        return False, f"{note}: {len(want)} rows expected"
    a, b = normal(got), normal(want)
    off = (a != b).any(axis=1)
    if off.any():
        return False, f"{note}: {off.sum()} rows differ\n{a[off].head(5)}\n{b[off].head(5)}"
    return True, note


def main() -> int:
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("driftline-checks", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for name in names:
        try:
            good, note = compare(spark, str(Path("/root/testdata") / f"sf{scale}"), name)
        except Exception as error:  # noqa: BLE001
            good, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print("ok  " if good else "FAIL", name, note, flush=True)
        failed += [] if good else [name]
    print(f"{len(names) - len(failed)} of {len(names)} agree", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
