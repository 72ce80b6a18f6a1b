"""Imports the operators, which register their queries."""

from . import decontamination, embeddings, filters, language, licenses, lines, mixing, negatives, quality, secrets, sharding, simhash, substrings  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
