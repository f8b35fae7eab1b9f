"""How compute-heavy rows are spread."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows that each cost a lot of computing: as many tasks as the session's shuffle setting.

    Left alone they would be grouped by their (few) bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
