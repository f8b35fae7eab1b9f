"""Run the ladder on a density of your own.

    spark-submit --py-files tempera.zip,model.py run.py \\
        --target model:log_posterior --mode mode.txt --store s3a://bucket/run1 \\
        --nLevel 10 --TK 1000 --ndraws 50000 --nInitial 8 --chains 512

``log_posterior(x, params)`` takes points [n, d] and returns n log values.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tempera.operators.store import SampleStore
from tempera.plans.ladder import continue_ladder, run_ladder
from tempera.plans.settings import parse_settings
from tempera.plans.staging import release_staged
from tempera.plans.starting import from_text
from tempera.session import ship_package
from tempera.sources.results import run_summary, save_settings


def main(argv: list[str]) -> None:
    parser = argparse.ArgumentParser(add_help=False)
    parser.add_argument("--target", required=True)
    parser.add_argument("--mode", required=True)
    parser.add_argument("--store", required=True)
    own, rest = parser.parse_known_args(argv)
    settings = parse_settings(rest)
    spark = SparkSession.builder.appName(f"tempera-{settings.run_id}").getOrCreate()
    ship_package(spark)
    module, _, name = own.target.partition(":")
    density = getattr(importlib.import_module(module), name)
    mode = from_text(spark, own.mode)
    store = SampleStore(spark, f"{own.store.rstrip('/')}/{settings.run_id}")
    groups = min(settings.groups, settings.chains)
    chains = spark.range(settings.chains).select(F.col("id").alias("chain"), (F.col("id") % groups).alias("grp"))
    if settings.tuning_done:
        continue_ladder(chains, density, store, settings)
    else:
        climbs = None
        if settings.hill_climbs:
            # Starts spread around the mode; uniform ones are almost never feasible.
            jitter = [F.lit(float(m)) * (F.lit(1.0) + F.randn(settings.seed + i) * 0.1) for i, m in enumerate(mode)]
            climbs = spark.range(settings.hill_climbs).select("id", F.array(*jitter).alias("start"))
        run_ladder(chains, density, mode, store, settings, climb_starts=climbs)
    save_settings(spark, settings, f"{store.path}.tables/settings")
    run_summary(spark, settings).show(100, truncate=False)
    store.counts().orderBy("level", "bin").show(200)
    release_staged(spark)


if __name__ == "__main__":
    main(sys.argv[1:])
