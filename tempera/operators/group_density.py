"""Normal densities of samples under a full covariance of their own group.

A group's covariance is factored once; samples meet their group's factor in bounded slices, and a slice is solved as a
whole: one forward substitution over all its samples, dimension by dimension.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempera.functions.logmath import HALF_LOG_2PI, chi2_cdf
from tempera.plans.staging import materialize
from tempera.schema import NEG_INF

FACTORS = "grp long, n long, mean array<double>, factor binary, half_log_det double"
DENSITIES = "id long, grp long, distance double, kernel double, density double, truncated double"
#: Samples of a group that are solved together.
SLICE = 20_000


def group_factors(cov: DataFrame, means: DataFrame, ridge: float = 0.0) -> DataFrame:
    """``FACTORS`` of every group: the lower triangular factor of its covariance plus ``ridge`` on the diagonal.

    ``cov`` is (grp, i, j, cov, n), ``means`` (grp, pos, mean). A covariance that is not positive definite
    even with the ridge has no density: its factor is null.
    """

    def factor(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["grp", "n", "mean", "factor", "half_log_det"])
        d = int(left["i"].max()) + 1
        matrix = np.zeros((d, d))
        matrix[left["i"], left["j"]] = left["cov"]
        try:
            low = np.linalg.cholesky(0.5 * (matrix + matrix.T) + ridge * np.eye(d))
        except np.linalg.LinAlgError:
            low = None
        mean = right.sort_values("pos")["mean"].to_list()
        half = None if low is None else -float(np.log(np.diag(low)).sum())
        raw = None if low is None else low.tobytes()
        return pd.DataFrame({"grp": [left["grp"].iloc[0]], "n": [int(left["n"].iloc[0])], "mean": [mean], "factor": [raw], "half_log_det": [half]})

    return cov.groupBy("grp").cogroup(means.groupBy("grp")).applyInPandas(factor, FACTORS)


def solve_lower(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """z with low z = b for a lower triangular matrix and many right-hand sides, one a column."""
    z = np.empty_like(b)
    for i in range(len(low)):
        z[i] = (b[i] - low[i, :i] @ z[:i]) / low[i, i]
    return z


def group_log_density(rows: DataFrame, factors: DataFrame, truncation: float | None = None) -> DataFrame:
    """``DENSITIES`` of (id, grp, data): squared distance to the group's mean in units of its covariance, log kernel, log
    density, and log density truncated to distances up to ``truncation`` (null without one).

    Groups without a factor, and samples of another dimension, have no density: nulls. A group is cut into slices by a
    hash of the id, so no task holds more than about ``SLICE`` samples of it.
    """
    sizes = materialize(factors.select("grp", F.ceil(F.col("n") / F.lit(SLICE)).cast("int").alias("slices")), "slices")
    placed = rows.select("id", "grp", "data").join(sizes, "grp").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    copies = factors.join(sizes, "grp").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

    def density(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"id": left["id"], "grp": left["grp"]})
        for c in ("distance", "kernel", "density", "truncated"):
            out[c] = np.nan
        if not len(right) or right["factor"].iloc[0] is None:
            return out.astype(object).where(out.notna(), None)
        mean = np.asarray(right["mean"].iloc[0])
        d = len(mean)
        fits = np.array([x is not None and len(x) == d for x in left["data"]], dtype=bool)
        low = np.frombuffer(right["factor"].iloc[0]).reshape(d, d)
        if fits.any():
            z = solve_lower(low, np.stack(left["data"][fits]).T - mean[:, None])
            distance = (z * z).sum(axis=0)
            constant = -HALF_LOG_2PI * d + right["half_log_det"].iloc[0]
            out.loc[fits, "distance"], out.loc[fits, "kernel"], out.loc[fits, "density"] = distance, -0.5 * distance, constant - 0.5 * distance
            if truncation is not None:
                inside = constant - math.log(chi2_cdf(truncation, d)) - 0.5 * distance
                out.loc[fits, "truncated"] = np.where(distance > truncation, NEG_INF, inside)
        return out.astype(object).where(out.notna(), None)

    left = placed.select("id", "grp", "data", "slice").groupBy("grp", "slice")
    right = copies.select("grp", "slice", "mean", "factor", "half_log_det").groupBy("grp", "slice")
    return left.cogroup(right).applyInPandas(density, DENSITIES)
