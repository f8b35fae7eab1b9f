"""The driver's tables read as the engine's inputs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempera.functions.logmath import HALF_LOG_2PI

LEVELS = 5


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per order: the priority is the level, cheap orders have the highest weight."""
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("level"),
        (-F.col("o_totalprice") / 10000.0).alias("weight"),
    )


def vector_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per embedding; its weight is minus the first coordinate's square, in percent."""
    data = F.col("embedding").cast("array<double>")
    return _read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label"), data.alias("data"), (-100.0 * data[0] * data[0]).alias("weight")
    )


def evidence_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as draws: views and clicks from the proposal, the rest from the posterior.

    x = ln(value); the proposal is N(3.3, 1.4), the kernel e**2.5 times the
    N(3.5, 1.2) density without its constant.
    """
    x = F.log("value")
    zh, zk = (x - 3.3) / 1.4, (x - 3.5) / 1.2
    return (
        _read(spark, sf_dir, "events")
        .where(F.col("value") > 0)
        .select(
            F.col("event_id").alias("id"),
            F.when(F.col("event_type").isin("view", "click"), "proposal").otherwise("posterior").alias("src"),
            (F.lit(-HALF_LOG_2PI - math.log(1.4)) - 0.5 * zh * zh).alias("ln_h"),
            (F.lit(2.5) - 0.5 * zk * zk).alias("ln_k"),
        )
    )


def quarterly_orders(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Order volume per ``key`` and quarter: (key, dt, value)."""
    from tempera.operators.timeseries import quarter_of

    return (
        _read(spark, sf_dir, "orders")
        .groupBy(F.col(key).alias("key"), quarter_of(F.col("o_orderdate")).alias("dt"))
        .agg(F.sum("o_totalprice").alias("value"))
    )
