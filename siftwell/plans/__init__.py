"""Queries over the library's operators."""

from . import evidence as _evidence
from . import pictures as _pictures
from . import queries as _queries
from . import trials as _trials
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "_evidence", "_pictures", "_queries", "_trials"]
