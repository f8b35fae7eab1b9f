"""Tempered Monte-Carlo analytics on Spark DataFrames."""

from tempera.session import get_session

__all__ = ["get_session"]
