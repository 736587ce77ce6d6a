"""Queries over the given tables with an independent SQL statement of each result."""

from checks import blocks, ordered, scalars, selection, statistics, tables  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
