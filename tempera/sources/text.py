"""Samples and posterior draws as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempera.plans.staging import materialize
from tempera.sources.record import read_records, write_records

FIELD_SEPARATOR = "\t"


def to_lines(samples: DataFrame, *kept: str) -> DataFrame:
    """dim, values, id, weight, flag; doubles print with all the digits they need. ``kept`` columns stay beside the line."""
    flag = F.when(F.col("calculated"), "1").otherwise("0")
    return samples.select(
        *kept,
        F.concat_ws(
            FIELD_SEPARATOR,
            F.size("data").cast("string"),
            F.transform("data", lambda v: v.cast("string")),
            F.col("id").cast("string"),
            F.col("weight").cast("string"),
            flag,
        ).alias("value")
    )


def from_lines(lines: DataFrame, *kept: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.length(F.trim("value")) > 0).select(*kept, parts.alias("p"))
    rows = rows.withColumn("d", F.col("p")[0].cast("int"))
    return rows.select(
        *kept,
        F.slice("p", F.lit(2), F.col("d")).cast("array<double>").alias("data"),
        F.element_at("p", F.col("d") + 2).cast("int").alias("id"),
        F.element_at("p", F.col("d") + 3).cast("double").alias("weight"),
        (F.element_at("p", F.col("d") + 4) == "1").alias("calculated"),
    )


def write_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    to_lines(samples).write.mode(mode).text(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return from_lines(spark.read.text(path))


def read_posterior_draws(spark: SparkSession, path: str, dim: int | None = None, draws: int | None = None) -> DataFrame:
    """Lines 'log posterior, log likelihood, x...' to samples, all or the first ``draws``; the likelihood is dropped.

    The id is the number of the line, empty ones not counted, through the files in order of their names, however they are split
    for reading. ``draws`` beyond the lines there are is an error, as for the converter of single files.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_at"))
    lines = materialize(lines.where(F.length(F.trim("value")) > 0), "draw-lines")  # written, so that a line keeps its place
    block = ["file_path", "file_block_start"]
    blocks = lines.groupBy(*block).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    # Lines of a block are numbered by rank in it: positions count empty lines, too.
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = materialize(blocks.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0))).drop("_first", "_lines"), "draw-blocks")
    rank = F.row_number().over(Window.partitionBy(*block).orderBy("_at")) - 1
    numbered = lines.withColumn("_rank", rank).join(starts, block).withColumn("id", (F.col("_before") + F.col("_rank")).cast("long"))
    if draws is not None:
        if lines.count() < draws:
            raise ValueError(f"{path} holds fewer than {draws} draws")
        numbered = numbered.where(F.col("id") < draws)
    p = F.split(F.trim("value"), r"\s+")
    width = F.lit(dim) if dim else F.size(p) - 2
    return numbered.select(
        F.slice(p, F.lit(3), width).cast("array<double>").alias("data"), "id", p[0].cast("double").alias("weight"), F.lit(True).alias("calculated")
    )


def binary_to_text(spark: SparkSession, source: str, target: str) -> None:
    write_samples(read_records(spark, source), target)


def text_to_binary(spark: SparkSession, source: str, target: str) -> None:
    write_records(read_samples(spark, source), target)


def run_to_text(spark: SparkSession, source: str, target: str) -> None:
    """Every record file of a run as text, a folder for each level and bin; one job, whatever the number of files.

    Files are named ``<level>.<bin>.<dump>.<node>.record``; others go to level and bin -1.
    """
    lines = to_lines(read_records(spark, source, placed=True), "level", "bin")
    lines.write.mode("errorifexists").partitionBy("level", "bin").text(target)
