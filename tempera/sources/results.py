"""Run parameters, summaries and result tables."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempera.operators.energy import temperatures
from tempera.plans.settings import RunSettings


def save_settings(spark: SparkSession, settings: RunSettings, path: str) -> None:
    spark.createDataFrame([asdict(settings)]).coalesce(1).write.mode("overwrite").json(path)


def load_settings(spark: SparkSession, path: str) -> RunSettings:
    return RunSettings(**spark.read.json(path).first().asDict())


def run_summary(spark: SparkSession, settings: RunSettings) -> DataFrame:
    """Human-readable (name, value) rows."""
    ladder = temperatures(settings.levels, settings.t_low, settings.t_high)
    rows = [(k, str(v)) for k, v in asdict(settings).items()]
    rows.append(("temperatures", " ".join(f"{t:g}" for t in ladder)))
    return spark.createDataFrame(rows, "name string, value string")


def wide_result(long: DataFrame, rows: list[str], column: str, value: str, names: list[str]) -> DataFrame:
    """Long result rows (dates x series, dates x regimes) as one column per name."""
    return long.groupBy(*rows).pivot(column, names).agg(F.first(value))


def write_result(result: DataFrame, path: str) -> None:
    result.write.mode("overwrite").option("header", True).csv(path)
