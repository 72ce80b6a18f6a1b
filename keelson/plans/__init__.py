"""Registered queries over the test tables, with the SQL that checks them."""

from . import lineage, quality, rowlevel, tables  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
