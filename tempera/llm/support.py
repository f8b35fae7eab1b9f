"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempera.plans.staging import materialize


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def about(df: DataFrame, rows: int, of: int, *keys: str) -> DataFrame:
    """Rows picked by a hash of their keys, about twice ``rows`` of the ``of`` there are.

    For drawing a bounded sample: a top-n by hash behind it gets few rows from all tasks together, not n from each.
    """
    share = min(1.0, 2.0 * rows / max(1, of))
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def id_and_text(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, whatever else the table has; null texts are empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))


def numbered(df: DataFrame, *keys: str, label: str = "numbered") -> DataFrame:
    """The rows with ``_n``: their number, from 0, in ascending order of ``keys`` (nulls first).

    Rows are sorted by range, so no key is too frequent for a task: rows equal in all keys are told apart by their
    place in a written table. What is broadcast is one row a range.
    """
    placed = materialize(df.withColumn("_tie", F.monotonically_increasing_id()), f"{label}-rows")
    spread = placed.repartitionByRange(shuffle_width(df.sparkSession), *keys, "_tie").sortWithinPartitions(*keys, "_tie")
    ordered = materialize(spread.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), f"{label}-order")
    part = F.shiftright("_at", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    number = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_n", number).drop("_part", "_start", "_at")
