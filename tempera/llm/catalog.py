"""Registered queries of this subpackage, each beside its SQL equivalent if one exists."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tempera.catalog.registry import Query

QUERIES: dict[str, Query] = {}

_MODULES = ("html_extract", "merge_dropout", "edit_counts", "slack_packing", "warc", "ball_tree", "rule_quality", "bayes_dedup", "disclosure", "spot_signatures", "line_cleaning", "hard_negatives", "merkle_manifest", "pipeline_query")


def llm_query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(fn, sql)
        return fn

    return register


def load() -> dict[str, Query]:
    for module in _MODULES:
        import_module(f"tempera.llm.{module}")
    return QUERIES
