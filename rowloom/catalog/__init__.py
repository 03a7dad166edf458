"""All registered queries."""

from rowloom.catalog import graphs, learning, matching, streams, tables  # noqa: F401
from rowloom.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
