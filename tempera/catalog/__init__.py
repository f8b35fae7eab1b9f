"""Importing the package registers every query."""

from tempera.catalog import binning, chains, evidence, formats, series, vectors  # noqa: F401
from tempera.catalog.registry import QUERIES

__all__ = ["QUERIES"]
