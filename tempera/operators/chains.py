"""Markov chains run as DataFrame tasks.

One row of the task frame is one chain. Spark partitions the rows; inside a
task every Arrow batch of chains advances together as NumPy arrays, so a step
costs a few array operations however many chains there are, and draws leave
the task in bounded pieces. Random numbers come from the counter generator
keyed by chain, hence a re-run task repeats its draws exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tempera.functions import counter_rng
from tempera.plans.sizing import spread
from tempera.schema import CHAIN_DRAW, NEG_INF

# (points [n, d], per-chain parameter arrays) -> log posterior [n]
LogDensity = Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray]

_EMIT_ROWS = 50_000
#: Counters of acceptance and of jumps beside those of proposals.
ACCEPT, JUMP = counter_rng.purpose(1), counter_rng.purpose(2)


@dataclass(frozen=True)
class Schedule:
    draws: int
    burn_in: int = 0
    thin: int = 1  # calls per stored draw
    sweeps: int = 1  # block sweeps per call
    seed: int = 1
    p_no_jump: float = 0.3  # a jump is tried when the uniform exceeds this


@dataclass(frozen=True)
class JumpPool:
    """Samples of the level above, bin by bin, with the bins' lower bounds.

    Its size is (bins x capacity) rows by construction.
    """

    temperature: float
    lower: np.ndarray
    start: np.ndarray
    size: np.ndarray
    x: np.ndarray
    w: np.ndarray


class _Walkers:
    """State of one batch of chains."""

    def __init__(self, pdf: pd.DataFrame, density: LogDensity, blocks: list[np.ndarray], seed: int):
        self.keys = pdf["chain"].to_numpy(dtype=np.int64)
        self.temperature = pdf["temperature"].to_numpy(dtype=float)
        self.params = {
            c: np.stack(pdf[c].to_numpy()) if pdf[c].dtype == object else pdf[c].to_numpy()
            for c in pdf.columns
            if c not in ("chain", "level", "temperature", "start", "grp")
        }
        self.density, self.blocks, self.seed = density, blocks, seed
        self.normals_per_sweep = sum(b.shape[-1] for b in blocks)
        self.steps = self.calls = 0
        self.x = np.stack(pdf["start"].to_numpy()).astype(float)
        self.w = self.log_density(self.x)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(np.nan_to_num(self.density(x, self.params), nan=NEG_INF), NEG_INF)

    def sweep(self, scale: np.ndarray | None = None) -> np.ndarray:
        """Propose a normal move in each block in turn; returns acceptances [chains, blocks]."""
        accepted = np.zeros((len(self.keys), len(self.blocks)), dtype=bool)
        counter = self.steps * self.normals_per_sweep
        for i, block in enumerate(self.blocks):
            width = block.shape[-1]
            z = np.stack(
                [counter_rng.normal(self.keys, counter + c, self.seed) for c in range(width)], axis=1
            )
            counter += width
            move = np.matmul(block, z[..., None])[..., 0]
            y = self.x + (move if scale is None else move * scale[:, i : i + 1])
            w = self.log_density(y)
            u = counter_rng.uniform(self.keys, self.steps * len(self.blocks) + i + ACCEPT, self.seed)
            ok = (w - self.w) / self.temperature >= np.log(u)
            self.x[ok], self.w[ok], accepted[:, i] = y[ok], w[ok], ok
        self.steps += 1
        return accepted

    def jump(self, pool: JumpPool, p_no_jump: float) -> np.ndarray:
        """Swap in a sample of the level above from the same energy bin, where accepted."""
        u = [counter_rng.uniform(self.keys, 3 * self.calls + c + JUMP, self.seed) for c in range(3)]
        self.calls += 1
        b = np.maximum(np.searchsorted(pool.lower, -self.w, side="right") - 1, 0)
        pick = pool.start[b] + np.floor(u[1] * pool.size[b]).astype(np.int64)
        pick = np.minimum(pick, len(pool.w) - 1)
        gap = 1.0 / self.temperature - 1.0 / pool.temperature
        ok = (u[0] > p_no_jump) & (pool.size[b] > 0)
        ok &= np.log(u[2]) <= (pool.w[pick] - self.w) * gap
        self.x[ok], self.w[ok] = pool.x[pick][ok], pool.w[pick][ok]
        return ok

    def hybrid(self, pool: JumpPool | None, schedule: Schedule) -> tuple[np.ndarray, np.ndarray]:
        """One call: a cross-level jump or, where none happened, Metropolis sweeps."""
        jumped = (
            self.jump(pool, schedule.p_no_jump) if pool is not None else np.zeros(len(self.keys), dtype=bool)
        )
        keep_x, keep_w = self.x[jumped].copy(), self.w[jumped].copy()
        moved = np.zeros(len(self.keys), dtype=bool)
        for _ in range(schedule.sweeps):
            moved |= self.sweep().any(axis=1)
        self.x[jumped], self.w[jumped] = keep_x, keep_w
        return jumped, moved & ~jumped


def _blocks_for(pdf: pd.DataFrame, blocks) -> list[np.ndarray]:
    if not isinstance(blocks, dict):
        return blocks
    per_chain = [blocks[g] for g in pdf["grp" if "grp" in pdf.columns else "chain"]]
    return [np.stack([b[i] for b in per_chain]) for i in range(len(per_chain[0]))]


def _pack(pdf: pd.DataFrame, held: list[tuple]) -> pa.RecordBatch:
    """Held draws of one batch of chains as Arrow columns."""
    times, points, weights, ee, mh = zip(*held)
    n, dim = points[0].shape
    flat = pa.array(np.concatenate(points).ravel())
    ends = pa.array(np.arange(0, (len(held) * n + 1) * dim, dim, dtype=np.int32))
    columns = {
        "chain": np.tile(pdf["chain"].to_numpy(dtype=np.int64), len(held)),
        "level": np.tile(pdf["level"].to_numpy(dtype=np.int32), len(held)),
        "iter": np.repeat(np.array(times, dtype=np.int64), n),
        "data": pa.ListArray.from_arrays(ends, flat, type=pa.list_(pa.field("element", pa.float64(), nullable=False))),
        "weight": np.concatenate(weights),
        "ee_jumps": np.concatenate(ee),
        "mh_jumps": np.concatenate(mh),
    }
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def simulate(
    tasks: DataFrame,
    density: LogDensity,
    schedule: Schedule,
    blocks: list[np.ndarray] | dict[int, list[np.ndarray]],
    pool: JumpPool | None = None,
) -> DataFrame:
    """Draws of every chain: (chain, level, iter, data, weight, ee_jumps, mh_jumps).

    ``tasks`` has chain, level, temperature, start and any number of parameter
    columns handed to ``density``; with blocks per group also ``grp``. Jump
    counts refer to the calls made for that draw.
    """
    shared = tasks.sparkSession.sparkContext.broadcast(pool) if pool is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = shared.value if shared is not None else None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            pdf = batch.to_pandas()
            walkers = _Walkers(pdf, density, _blocks_for(pdf, blocks), schedule.seed)
            for _ in range(schedule.burn_in):
                walkers.sweep()
            held: list[tuple] = []
            for t in range(schedule.draws):
                ee = np.zeros(len(pdf), dtype=np.int64)
                mh = np.zeros(len(pdf), dtype=np.int64)
                for _ in range(schedule.thin):
                    jumped, moved = walkers.hybrid(above, schedule)
                    ee += jumped
                    mh += moved
                held.append((t, walkers.x.copy(), walkers.w.copy(), ee, mh))
                if len(held) * len(pdf) >= _EMIT_ROWS or t == schedule.draws - 1:
                    yield _pack(pdf, held)
                    held = []

    return spread(tasks, "chain").mapInArrow(run, CHAIN_DRAW)

