"""Mean vectors, covariance matrices and their factors.

Each task folds its Arrow batches into one (count, sum, sum of outer products)
row per group, so what is shuffled is d*d numbers per task, not d*d per sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLUSH_CELLS = 4_000_000  # partial sums held per task before they are passed on


def _partial_sums(df: DataFrame, group: str, vector: str) -> DataFrame:
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def flush() -> pa.RecordBatch:
            keys = list(sums)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array([sums[k][0] for k in keys], pa.int64()),
                    pa.array([sums[k][1] for k in keys], pa.list_(pa.float64())),
                    pa.array([sums[k][2].ravel() for k in keys], pa.list_(pa.float64())),
                ],
                names=["grp", "n", "s", "ss"],
            )

        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = batch.column(1)
            x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            x = x.reshape(batch.num_rows, -1)
            keys, where = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            for i, key in enumerate(keys.tolist()):
                rows = x[where == i]
                n, s, ss = sums.get(key, (0, 0.0, 0.0))
                sums[key] = (n + len(rows), s + rows.sum(axis=0), ss + rows.T @ rows)
            if len(sums) * x.shape[1] ** 2 > _FLUSH_CELLS:
                yield flush()
                sums.clear()
        if sums:
            yield flush()

    slim = df.select(F.col(group).cast("long").alias("grp"), F.col(vector).cast("array<double>").alias("x"))
    return slim.mapInArrow(fold, "grp long, n long, s array<double>, ss array<double>")


def mean_vector(df: DataFrame, group: str, vector: str = "data") -> DataFrame:
    """Mean of each coordinate; a task ships one sum per group, not a row per coordinate."""
    parts = _partial_sums(df, group, vector).select("grp", "n", F.posexplode("s").alias("pos", "v"))
    return parts.groupBy("grp", "pos").agg((F.sum("v") / F.sum("n")).alias("mean"))


def covariance(df: DataFrame, group: str, dim: int, vector: str = "data") -> DataFrame:
    """Population covariance E[xx'] - E[x]E[x]', one row per (group, i, j)."""
    parts = _partial_sums(df, group, vector)
    cells = parts.select("grp", F.posexplode("ss").alias("cell", "v"))
    second = cells.groupBy("grp", "cell").agg(F.sum("v").alias("ss"))
    first = (
        parts.select("grp", "n", F.posexplode("s").alias("pos", "v"))
        .groupBy("grp", "pos")
        .agg(F.sum("v").alias("s"), F.sum("n").alias("n"))
    )
    means = first.groupBy("grp").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("m")))),
            lambda t: t["m"],
        ).alias("means"),
        F.max("n").alias("n"),
    )
    i, j = F.floor(F.col("cell") / dim).cast("int"), (F.col("cell") % dim).cast("int")
    cov = F.col("ss") / F.col("n") - F.element_at("means", i + 1) * F.element_at("means", j + 1)
    return second.join(means, "grp").select(
        "grp", i.alias("i"), j.alias("j"), cov.alias("cov"), "n"
    )


def covariance_factor(cov: DataFrame) -> DataFrame:
    """U diag(sqrt(d)) of each group's (small) covariance matrix, as rows (grp, i, j, value)."""

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["i"].max()) + 1
        matrix = np.zeros((d, d))
        matrix[pdf["i"], pdf["j"]] = pdf["cov"]
        u, s, _ = np.linalg.svd(0.5 * (matrix + matrix.T))
        b = u * np.sqrt(s)
        i, j = np.indices((d, d))
        return pd.DataFrame(
            {"grp": pdf["grp"].iloc[0], "i": i.ravel(), "j": j.ravel(), "value": b.ravel()}
        )

    schema = T.StructType(
        [
            T.StructField("grp", T.LongType()),
            T.StructField("i", T.IntegerType()),
            T.StructField("j", T.IntegerType()),
            T.StructField("value", T.DoubleType()),
        ]
    )
    return cov.select("grp", "i", "j", "cov").groupBy("grp").applyInPandas(factor, schema)


def scale_blocks(factor_rows: list, dim: int, scheme: list[list[int]] | None = None) -> dict[int, list[np.ndarray]]:
    """Turn factor rows of a full or per-block covariance into n x b proposal blocks per group."""
    scheme = scheme or [list(range(dim))]
    dense: dict[int, np.ndarray] = {}
    for r in factor_rows:
        dense.setdefault(r["grp"], np.zeros((dim, dim)))[r["i"], r["j"]] = r["value"]
    out = {}
    for grp, matrix in dense.items():
        blocks = []
        if len(scheme) == 1:
            blocks.append(matrix)
        else:
            full = matrix @ matrix.T
            for dims in scheme:
                u, s, _ = np.linalg.svd(full[np.ix_(dims, dims)])
                block = np.zeros((dim, len(dims)))
                block[dims] = u * np.sqrt(s)
                blocks.append(block)
        out[grp] = blocks
    return out
