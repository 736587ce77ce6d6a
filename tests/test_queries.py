"""Every query of the checks against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks import QUERIES
from checks.run import compare

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(BASE).exists(), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    good, note = compare(spark, BASE, name)
    assert good, note


def test_entry(spark):
    assert entry.entry(spark).count() == 985


def test_every_check_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
