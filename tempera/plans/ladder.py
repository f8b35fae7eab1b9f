"""The top-down run: hottest level first, each level jumping into the one above.

The driver only walks levels and groups (tens of each). Chains are rows of
``chains``; samples live in the store; between phases data are Parquet in the
shared folder, so a lost executor costs one task, not the run.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempera.operators.binning import equal_count_bounds
from tempera.operators.chains import JumpPool, LogDensity, Schedule, simulate
from tempera.operators.climb import WALL, hill_climb
from tempera.operators.energy import temperatures
from tempera.functions.counter_rng import MAX_SEED
from tempera.operators.starters import TooFewSamples, draw_pool, farthest_first
from tempera.operators.store import SampleStore
from tempera.operators.tuning import TuneSettings, one_pass_after, one_pass_before, sample_blocks, tuned_blocks
from tempera.plans.settings import RunSettings
from tempera.plans.staging import materialize
from tempera.sources.blocks import blocks_from_table, blocks_table


def pool_from_rows(picks: DataFrame, lower_bounds: list[float], temperature: float) -> JumpPool:
    """Pack drawn picks (bin, pick, data, weight) for the chains; bins x capacity rows by construction."""
    rows = picks.select("bin", "pick", "data", "weight").toPandas().sort_values(["bin", "pick"])
    sizes = rows.groupby("bin").size().reindex(range(len(lower_bounds)), fill_value=0).to_numpy()
    return JumpPool(
        temperature=temperature,
        lower=np.array(lower_bounds),
        start=np.concatenate([[0], np.cumsum(sizes)[:-1]]),
        size=sizes,
        x=np.stack(rows["data"].to_numpy()),
        w=rows["weight"].to_numpy(),
    )


def _numbered(draws: DataFrame, level: int, offset: int, chain_count: int) -> DataFrame:
    ident = F.lit(offset) + F.col("iter") * chain_count + F.col("chain")
    return draws.select(ident.alias("id"), "data", "weight", F.lit(level).alias("level"))


def seed_level(starts: DataFrame, density: LogDensity, store: SampleStore, level: int) -> int:
    """Hill-climb from every start and deposit the feasible ends one level above the ladder."""
    ends = hill_climb(starts, lambda x, p: np.minimum(-density(x, p), WALL))
    rows = materialize(ends, "hill-climb")
    store.deposit(
        rows.select("id", "data", (-F.col("objective")).alias("weight"), F.lit(level).alias("level"), F.lit(0).alias("bin"))
    )
    return rows.count()


def run_ladder(
    chains: DataFrame,
    density: LogDensity,
    mode: list[float],
    store: SampleStore,
    settings: RunSettings,
    climb_starts: DataFrame | None = None,
    scheme: list[list[int]] | None = None,
) -> DataFrame:
    """Simulate every level; returns the bins' bounds (level, bin, lo, hi, n).

    ``chains`` has chain (0-based, unique) and grp. Samples end up in ``store``.
    """
    spark, dim = chains.sparkSession, len(mode)
    ladder = temperatures(settings.levels, settings.t_low, settings.t_high)
    roster = materialize(chains.select("chain", "grp"), "chains")
    by_group = {r["grp"]: r["count"] for r in roster.groupBy("grp").count().collect()}
    groups, total = sorted(by_group), sum(by_group.values())
    tuning = TuneSettings(
        period=settings.period, max_period=settings.max_period, seed=settings.seed + 1000, p_no_jump=settings.p_no_jump
    )
    if climb_starts is not None:
        seed_level(climb_starts, density, store, settings.levels)

    pool, pooled_samples, out = None, None, []
    for level in range(settings.top, settings.level_low - 1, -1):
        t = ladder[level]
        starts = [list(mode)] * len(groups)
        above = level + 1
        has_above = (climb_starts is not None or above <= settings.top) and not store.is_empty(above)
        if has_above:
            upper = store.scan(above).select("id", "data", "weight")
            try:
                picked = farthest_first(upper, len(groups), settings.start_share)
                starts = [r["data"] for r in picked.orderBy("pick").collect()]
            except TooFewSamples:
                pass  # all groups start from the mode
        leads = spark.createDataFrame(
            [(g, level, t, [float(v) for v in s], g) for g, s in zip(groups, starts)],
            "chain long, level int, temperature double, start array<double>, grp long",
        )
        heads = leads.drop("chain")
        tasks = roster.join(F.broadcast(heads), "grp").select("chain", "level", "temperature", "start", "grp")

        if pooled_samples is None:
            blocks = one_pass_before(leads, groups, density, dim, tuning, pool, scheme)
        else:
            shared = pooled_samples.withColumn("_all", F.lit(0))
            common = sample_blocks(shared, "_all", dim, scheme)[0]
            blocks = tuned_blocks(leads, density, {g: common for g in groups}, tuning, pool)

        base = Schedule(
            draws=1, burn_in=settings.burn_in, thin=settings.thin,
            sweeps=max(1, settings.sweeps_per_draw // settings.thin),
            p_no_jump=settings.p_no_jump, seed=settings.seed + 10 * level,
        )
        smallest = min(by_group.values())
        first = replace(base, draws=math.ceil(settings.covariance_draws / smallest), seed=base.seed + 3)
        within = materialize(
            simulate(tasks, density, first, blocks).join(roster, "chain"), "covariance-group"
        )
        blocks = one_pass_after(leads, within, "grp", density, dim, tuning, pool, scheme)
        store.save_table(f"blocks-{level}", blocks_table(spark, blocks))
        store.save_table(f"starts-{level}", heads)

        main = replace(base, draws=math.ceil(settings.draws / total), seed=base.seed + 5)
        drawn = _numbered(simulate(tasks, density, main, blocks, pool), level, 0, total)
        if level == 0:
            store.deposit(drawn.withColumn("bin", F.lit(0)))
            continue
        drawn = materialize(drawn, "level")
        second = replace(base, draws=math.ceil(settings.covariance_draws / total), seed=base.seed + 7)
        pooled_samples = materialize(
            _numbered(simulate(tasks, density, second, blocks, pool), level, main.draws * total, total),
            "covariance-pooled",
        )
        samples = drawn.unionByName(pooled_samples)
        rows = equal_count_bounds(samples, settings.levels).orderBy("bin").drop("lo_id").collect()
        out += rows
        level_bounds = spark.createDataFrame(rows, binned_schema())
        store.save_table(f"bounds-{level}", level_bounds)
        store.deposit_by_energy(samples, level_bounds)
        picks = draw_pool(
            store.scan(level).select("bin", "id", "data", "weight"), settings.pool_capacity, settings.seed + level
        )
        pool = pool_from_rows(picks, [r["lo"] for r in rows], t)
        if settings.save_space and level + 2 <= settings.top:
            store.drop_level(level + 2)
    return spark.createDataFrame(out, binned_schema()) if out else spark.createDataFrame([], binned_schema())


def continue_ladder(chains: DataFrame, density: LogDensity, store: SampleStore, settings: RunSettings) -> None:
    """More draws for a run whose tuning is done: saved blocks, starts and bounds are used as they are."""
    ladder = temperatures(settings.levels, settings.t_low, settings.t_high)
    roster = materialize(chains.select("chain", "grp"), "chains")
    total = roster.count()
    pool = None
    for level in range(settings.top, settings.level_low - 1, -1):
        tasks = roster.join(F.broadcast(store.load_table(f"starts-{level}")), "grp").select(
            "chain", "level", "temperature", "start", "grp"
        )
        last = store.scan(level).agg(F.max("id")).first()[0]
        plan = Schedule(
            draws=math.ceil(settings.draws / total), burn_in=settings.burn_in, thin=settings.thin,
            sweeps=max(1, settings.sweeps_per_draw // settings.thin), p_no_jump=settings.p_no_jump,
            seed=(settings.seed + 10 * level + last) % MAX_SEED,  # another stream of random numbers
        )
        blocks = blocks_from_table(store.load_table(f"blocks-{level}"))
        draws = materialize(_numbered(simulate(tasks, density, plan, blocks, pool), level, last + 1, total), "more")
        if level == 0:
            store.deposit(draws.withColumn("bin", F.lit(0)))
            continue
        bounds = store.load_table(f"bounds-{level}")
        store.deposit_by_energy(draws, bounds)
        picks = draw_pool(
            store.scan(level).select("bin", "id", "data", "weight"), settings.pool_capacity, plan.seed
        )
        pool = pool_from_rows(picks, [r["lo"] for r in bounds.orderBy("bin").collect()], ladder[level])


def binned_schema() -> str:
    return "level int, bin int, lo double, hi double, n long"
