"""The queries of the library over the driver's tables, and the same in SQL."""

from .catalog import QUERIES, entry
from .sql import ORACLES

__all__ = ["ORACLES", "QUERIES", "entry"]
