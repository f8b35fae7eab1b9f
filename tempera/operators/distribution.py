"""Empirical distribution, importance sampling and normal generators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempera.functions.counter_rng import box_muller, with_uniforms
from tempera.plans.staging import materialize

# Coefficients of Acklam's rational approximation of the inverse normal CDF.
CENTRAL_NUM = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
               1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
CENTRAL_DEN = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
               6.680131188771972e01, -1.328068155288572e01, 1.0]
TAIL_NUM = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
            -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
TAIL_DEN = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
            3.754408661907416e00, 1.0]
TAIL_FROM = 0.02425


def ecdf_grid(df: DataFrame, by: list[str], value: str, points: int = 100) -> DataFrame:
    """Share of values <= x on an even grid from minimum to maximum.

    Each row finds the first grid point at or above it by arithmetic, so the
    data meet the grid through a partial count per point, not through a join.
    """
    edges = df.groupBy(*by).agg(F.min(value).alias("_min"), F.max(value).alias("_max"), F.count(value).alias("_n"))
    edges = materialize(edges.withColumn("_inc", (F.col("_max") - F.col("_min")) / (points - 1)), "edges")
    placed = df.select(*by, value).join(edges, by)
    guess = F.ceil((F.col(value) - F.col("_min")) / F.col("_inc")).cast("int")

    def point(i: Column) -> Column:
        return F.col("_min") + i * F.col("_inc")

    # Rounding can put the guess one step off; settle it against the grid value itself.
    exact = F.when(F.col("_inc") == 0, F.lit(0)).when(point(guess - 1) >= F.col(value), guess - 1).when(
        point(guess) >= F.col(value), guess
    ).otherwise(guess + 1)
    slot = F.least(F.greatest(exact, F.lit(0)), F.lit(points))
    counts = placed.groupBy(*by, slot.alias("slot")).agg(F.count(F.lit(1)).alias("_c"))
    grid = edges.select(*by, "_min", "_inc", "_n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("slot"))
    upto = Window.partitionBy(*by).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    joined = grid.join(counts, [*by, "slot"], "left")
    return joined.select(
        *by,
        F.col("slot").alias("point"),
        point(F.col("slot")).alias("x"),
        (F.sum(F.coalesce("_c", F.lit(0))).over(upto) / F.col("_n")).alias("share"),
    )


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and population standard deviation from raw moments."""
    n = F.count(value)
    mean = F.sum(value) / n
    var = (F.sum(F.col(value) * F.col(value)) - F.sum(value) * F.sum(value) / n) / n
    return df.groupBy(*by).agg(mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"), n.alias("n"))


def importance_summary(df: DataFrame, by: list[str], value: str, log_weight: Column) -> DataFrame:
    """Largest and mean weight, and the self-normalised mean of ``value``."""
    weighted = df.select(*by, value, F.exp(log_weight).alias("_w"))
    return weighted.groupBy(*by).agg(
        F.max("_w").alias("max_weight"),
        F.avg("_w").alias("mean_weight"),
        (F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("mean"),
    )


def _horner(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def with_inverse_normal(df: DataFrame, p: str, out: str) -> DataFrame:
    """Normal quantile of column ``p``; intermediate columns keep the polynomials small."""
    df = df.withColumns(
        {
            "_q": F.col(p) - 0.5,
            "_r": (F.col(p) - 0.5) * (F.col(p) - 0.5),
            "_t": F.sqrt(F.lit(-2.0) * F.log(F.least(F.col(p), F.lit(1.0) - F.col(p)))),
        }
    )
    central = _horner(CENTRAL_NUM, F.col("_r")) * F.col("_q") / _horner(CENTRAL_DEN, F.col("_r"))
    tail = _horner(TAIL_NUM, F.col("_t")) / _horner(TAIL_DEN, F.col("_t"))
    value = F.when(F.col(p) < TAIL_FROM, tail).when(F.col(p) > 1.0 - TAIL_FROM, -tail).otherwise(central)
    return df.withColumn(out, value).drop("_q", "_r", "_t")


def normal_draws(df: DataFrame, key: str, mu: float, sigma: float, seed: int) -> DataFrame:
    """Three normal generators side by side, one draw of each per row."""
    u = with_uniforms(df.select(key), F.col(key), {"_a": 0, "_b": 2, "_c": 3}, seed)
    u = with_inverse_normal(u, "_a", "_z")
    cosine, sine = box_muller(F.col("_b"), F.col("_c"))
    return u.select(
        key,
        (F.lit(mu) + F.lit(sigma) * F.col("_z")).alias("inverse_cdf"),
        (F.lit(mu) + F.lit(sigma) * cosine).alias("box_muller_cos"),
        (F.lit(mu) + F.lit(sigma) * sine).alias("box_muller_sin"),
    )


def normal_cdf(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))
