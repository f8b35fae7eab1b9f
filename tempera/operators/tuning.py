"""Proposal-scale tuning towards a target acceptance rate."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tempera.operators.chains import JumpPool, LogDensity, Schedule, _blocks_for, _Walkers, simulate
from tempera.operators.moments import covariance, covariance_factor, scale_blocks
from tempera.plans.sizing import spread

ONE_PASS_TARGET = 0.234
MULTI_PASS_TARGET = 0.25


@dataclass(frozen=True)
class TuneSettings:
    target: float = ONE_PASS_TARGET
    period: int = 20
    max_period: int = 320
    max_checks: int = 2_000  # an untunable chain stops here with its best scale so far
    seed: int = 101
    p_no_jump: float = 0.3
    swapped_weights: bool = False  # bracket end-points weighted the other way round


class _Bracket:
    """Per (chain, block) search for the scale whose acceptance rate is the target."""

    def __init__(self, shape: tuple[int, int], settings: TuneSettings):
        self.s = settings
        self.scale = np.ones(shape)
        self.best = np.ones(shape)
        self.rate = np.zeros(shape)
        self.low = np.full((2, *shape), -1.0)  # scale, rate of the last try below target
        self.high = np.full((2, *shape), -1.0)
        self.period = np.full(shape, settings.period)
        self.due = np.full(shape, settings.period)
        self.since = np.zeros(shape)
        self.accepted = np.zeros(shape)

    def check(self, draw: int, active: np.ndarray) -> None:
        s, log_target = self.s, math.log(self.s.target)
        due = (self.due <= draw) & active[:, None]
        rate = self.accepted / np.maximum(draw - self.since, 1)
        self.rate = np.where(due, rate, self.rate)
        below = due & (rate < s.target)
        above = due & ~below
        for side, hit in ((self.low, below), (self.high, above)):
            side[0] = np.where(hit, self.scale, side[0])
            side[1] = np.where(hit, rate, side[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            log_step = log_target / np.log(rate)
        up = np.where(rate > s.target**0.2, 5.0, log_step) * self.high[0]
        down = np.where(rate < s.target**5.0, 0.2, log_step) * self.low[0]
        width = self.high[1] - self.low[1]
        share = (s.target - self.low[1]) / np.where(width > 1e-6, width, 1.0)
        if s.swapped_weights:
            share = 1.0 - share
        inside = np.where(
            width > 1e-6,
            self.low[0] + share * (self.high[0] - self.low[0]),
            0.5 * (self.low[0] + self.high[0]),
        )
        bracketed = due & (self.low[1] >= 0) & (self.high[1] >= 0)
        only_high, only_low = due & (self.low[1] < 0), due & (self.high[1] < 0)
        self.best = np.where(only_high | only_low, self.scale, np.where(bracketed, inside, self.best))
        self.scale = np.where(
            bracketed, inside, np.where(only_high, up, np.where(only_low, down, self.scale))
        )
        self.period = np.where(bracketed, 2 * self.period, self.period)
        self.low[1][bracketed] = self.high[1][bracketed] = -1.0
        self.accepted = np.where(due, 0.0, self.accepted)
        self.since = np.where(due, draw, self.since)
        self.due = np.where(due, draw + self.period, self.due)


def tune_scales(
    tasks: DataFrame,
    density: LogDensity,
    blocks: list[np.ndarray] | dict[int, list[np.ndarray]],
    settings: TuneSettings = TuneSettings(),
    pool: JumpPool | None = None,
) -> DataFrame:
    """Tuned scale of every block for every task row: (chain, block, scale, rate)."""
    shared = tasks.sparkSession.sparkContext.broadcast(pool) if pool is not None else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above = shared.value if shared is not None else None
        for pdf in frames:
            if pdf.empty:
                continue
            walkers = _Walkers(pdf, density, _blocks_for(pdf, blocks), settings.seed)
            k = len(walkers.blocks)
            search = _Bracket((len(pdf), k), settings)
            active = np.ones(len(pdf), dtype=bool)
            for draw in range(1, settings.period * settings.max_checks + 1):
                if above is not None:
                    walkers.jump(above, settings.p_no_jump)
                search.accepted += walkers.sweep(search.scale) & active[:, None]
                if draw % settings.period == 0:
                    search.check(draw, active)
                    active &= (search.period <= settings.max_period).any(axis=1)
                    if not active.any():
                        break
            yield pd.DataFrame(
                {
                    "chain": np.repeat(walkers.keys, k),
                    "block": np.tile(np.arange(k), len(pdf)),
                    "scale": search.best.ravel(),
                    "rate": search.rate.ravel(),
                }
            )

    return spread(tasks, "chain").mapInPandas(run, "chain long, block int, scale double, rate double")


def unit_blocks(dim: int, scheme: list[list[int]] | None = None) -> list[np.ndarray]:
    """Unit-vector directions of each block of dimensions."""
    return [np.eye(dim)[:, dims] for dims in (scheme or [list(range(dim))])]


def single_block(columns: list[np.ndarray]) -> list[np.ndarray]:
    return [np.hstack(columns)]


def tuned_blocks(tasks: DataFrame, density, blocks: dict, settings, pool=None) -> dict[int, list[np.ndarray]]:
    """Blocks of each group multiplied by the scales its task row found (one row per group)."""
    out = {g: [b.copy() for b in bs] for g, bs in blocks.items()}
    for r in tune_scales(tasks, density, blocks, settings, pool).collect():
        out[r["chain"]][r["block"]] *= r["scale"]
    return out


def one_pass_before(tasks, groups: list[int], density, dim, settings=TuneSettings(), pool=None, scheme=None):
    return tuned_blocks(tasks, density, {g: unit_blocks(dim, scheme) for g in groups}, settings, pool)


def sample_blocks(samples: DataFrame, group: str, dim: int, scheme=None) -> dict[int, list[np.ndarray]]:
    """Proposal directions from the samples' covariance, one set per group."""
    cov = covariance(samples, group, dim)
    return scale_blocks(covariance_factor(cov).collect(), dim, scheme)


def one_pass_after(tasks, samples: DataFrame, group: str, density, dim, settings=TuneSettings(), pool=None, scheme=None):
    return tuned_blocks(tasks, density, sample_blocks(samples, group, dim, scheme), settings, pool)


def _columns(blocks: dict[int, list[np.ndarray]]) -> dict[int, list[np.ndarray]]:
    return {g: [b[:, [c]] for b in bs for c in range(b.shape[1])] for g, bs in blocks.items()}


def two_pass(tasks, directions: dict[int, list[np.ndarray]], density, settings: TuneSettings, pool=None):
    """First each direction on its own, then all of them as one block."""
    single = tuned_blocks(tasks, density, _columns(directions), settings, pool)
    return tuned_blocks(tasks, density, {g: single_block(b) for g, b in single.items()}, settings, pool)


def two_pass_before(tasks, groups, density, dim, settings, pool=None):
    return two_pass(tasks, {g: unit_blocks(dim) for g in groups}, density, settings, pool)


def two_pass_after(tasks, samples, group, density, dim, settings, pool=None):
    return two_pass(tasks, sample_blocks(samples, group, dim), density, settings, pool)


def four_pass(tasks, groups, density, dim, settings: TuneSettings, schedule: Schedule, samples=None, pool=None):
    """Two passes from unit directions (or given samples), a simulation, two passes from its covariance."""
    if samples is None:
        blocks = two_pass_before(tasks, groups, density, dim, settings, pool)
    else:
        blocks = two_pass_after(tasks, samples, "chain", density, dim, settings, pool)
    draws = simulate(tasks, density, schedule, blocks)
    return two_pass_after(tasks, draws, "chain", density, dim, settings, pool)
