"""Weights of samples under a target density, evaluated only where they are out of date."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempera.operators.chains import LogDensity
from tempera.schema import NEG_INF


def data_changed(samples: DataFrame) -> DataFrame:
    """Mark every weight as out of date."""
    return samples.withColumn("calculated", F.lit(False))


def refresh_weights(samples: DataFrame, density: LogDensity) -> DataFrame:
    """Recompute the log posterior of samples whose weight is not current."""
    names = samples.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            old = (~pdf["calculated"].to_numpy(dtype=bool)).nonzero()[0]
            if len(old):
                x = np.stack(pdf["data"].to_numpy()[old]).astype(float)
                weight = pdf["weight"].to_numpy(dtype=float, copy=True)
                weight[old] = np.maximum(np.nan_to_num(density(x, {}), nan=NEG_INF), NEG_INF)
                pdf = pdf.assign(weight=weight, calculated=True)
            yield pdf[names]

    return samples.mapInPandas(run, samples.schema)


def start_from_file(spark: SparkSession, path: str, density: LogDensity) -> DataFrame:
    """The first sample of a record file with its weight recomputed."""
    first = spark.read.format("sample_record").load(path).limit(1)
    return refresh_weights(data_changed(first), density)
