import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from driftline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "driftline-tests", "local[8]", **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
            "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny_blocks(spark):
    """Blocks of a few rows, so that small fixtures take the long-series plans."""
    spark.conf.set("driftline.rowsPerBlock", "5")
    yield
    spark.conf.unset("driftline.rowsPerBlock")
