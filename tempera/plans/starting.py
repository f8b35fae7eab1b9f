"""Where an optimisation or a run starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempera.functions.counter_rng import with_uniforms
from tempera.operators import prior
from tempera.sources.config import vector_section
from tempera.sources.text import read_posterior_draws

PRIOR_TRIES = 500


def from_text(spark: SparkSession, path: str) -> list[float]:
    """A row of numbers, such as the last estimate."""
    line = spark.read.text(path).where(F.length(F.trim("value")) > 0).first()["value"]
    return [float(v) for v in line.split()]


def from_sections(sections: DataFrame, name: str) -> list[float]:
    return [r["value"] for r in vector_section(sections, name).orderBy("pos").collect()]


def from_prior(spark: SparkSession, code: int, seed: int, tries: int = PRIOR_TRIES) -> list[float]:
    """First admissible of ``tries`` prior draws; none among them is an error."""
    draws = prior.draw_from_prior(spark.range(tries), "id", code, seed)
    best = prior.evaluate(draws, code).where("valid").orderBy("id").select("data").first()
    if best is None:
        raise ValueError(f"no admissible draw among {tries}")
    return list(best["data"])


def from_draws(spark: SparkSession, path: str, seed: int) -> list[float]:
    """A random row of a file of posterior draws."""
    draws = read_posterior_draws(spark, path).withColumn("_key", F.xxhash64("data").bitwiseAND(F.lit(0x7FFFFFFF)))
    return list(with_uniforms(draws, F.col("_key"), {"_u": 0}, seed).orderBy("_u", "_key").first()["data"])
