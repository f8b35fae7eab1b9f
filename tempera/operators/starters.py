"""Where chains start: best samples, random picks, far-apart sets, cluster centres."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempera.functions.counter_rng import with_uniforms
from tempera.functions.logmath import dot, squared_distance, vector_literal
from tempera.operators.ranking import global_rank, k_most_weight
from tempera.operators.selection import selected_rows
from tempera.plans.staging import materialize


class TooFewSamples(ValueError):
    pass


def _best_at(samples: DataFrame, ranks: list[int]) -> dict[int, tuple]:
    """(weight, id) of the samples at the given ranks, best first."""
    slim = samples.select((-F.col("weight")).alias("energy"), "id")
    rows = selected_rows(slim, [], "energy", "id", lambda n: ranks)
    return {rank: (-energy, ident) for rank, energy, ident, _ in rows}


def _not_after(cut: tuple) -> Column:
    """Rows ranked at or before the (weight, id) pair in best-first order."""
    weight, ident = cut
    return (F.col("weight") > weight) | ((F.col("weight") == weight) & (F.col("id") <= ident))


def best_sample(samples: DataFrame) -> DataFrame:
    return k_most_weight(samples, 1)


def kth_best_sample(samples: DataFrame, k: int) -> DataFrame:
    return k_most_weight(samples, k).orderBy(F.col("weight").asc(), F.col("id").desc()).limit(1)


def pick_from_k_best(samples: DataFrame, k: int, seed: int) -> DataFrame:
    """One uniform pick among the k best: the smallest of k independent uniforms wins."""
    best = with_uniforms(k_most_weight(samples, k), F.col("id"), {"_u": 0}, seed)
    return best.orderBy("_u", "id").limit(1).drop("_u")


def best_share(samples: DataFrame, k: int, share: float) -> tuple[DataFrame, int, int]:
    """Samples in the best ``share`` (at least k of them), with that count and the total."""
    n = samples.count()
    if n < k:
        raise TooFewSamples(f"{n} samples cannot give {k} starters")
    take = max(k, math.ceil(share * n))
    if take >= n:
        return samples, n, n
    return samples.where(_not_after(_best_at(samples, [take - 1])[take - 1])), take, n


class _Chosen:
    """Starters picked so far, as the sums that a candidate's distance to all of them needs.

    The summed squared distance of x to m points is m|x|^2 - 2 x.S + Q with S their sum and Q their summed squares, so
    a pick costs one product per candidate, whatever was picked before.
    """

    def __init__(self, first: dict):
        self.rows, self.total, self.squares, self.far = [], np.zeros(len(first["data"])), 0.0, 0.0
        self.add(first)

    def add(self, row: dict) -> None:
        x = np.asarray(row["data"], dtype=float)
        self.rows.append(row)
        self.total, self.squares = self.total + x, self.squares + float(x @ x)

    def distance(self) -> Column:
        m = float(len(self.rows))
        return m * F.col(_NORM) - 2.0 * dot(F.col("data"), vector_literal(self.total)) + F.lit(self.squares)

    def exact(self) -> Column:
        """The same, one chosen point after the other, for the few candidates that are level within rounding."""
        centres = F.array(*[vector_literal(r["data"]) for r in self.rows])
        return F.aggregate(centres, F.lit(0.0), lambda acc, c: acc + squared_distance(F.col("data"), c))

    def least_norm(self, far: float) -> float:
        """No candidate of smaller squared norm is ``far`` away: m r^2 + 2 r |S| + Q >= far bounds r from below."""
        m, s = len(self.rows), float(np.linalg.norm(self.total))
        gap = max(0.0, far - self.squares)
        r = (math.sqrt(s * s + m * gap) - s) / m
        return max(0.0, r * r * (1.0 - _SLACK) - _SLACK)

    def take_farthest(self, candidates: DataFrame, at_least: float = 0.0) -> None:
        """Add the candidate farthest from all chosen ones, smallest id among equals; one of them is ``at_least`` that far."""
        near = candidates.where(F.col(_NORM) >= self.least_norm(at_least))
        top = near.agg(F.max(self.distance())).first()[0]
        if top is None:
            return
        room = _SLACK * (1.0 + abs(top) + self.squares + len(self.rows) * float(np.abs(self.total).max(initial=0.0)))
        level = near.where(F.col(_NORM) >= self.least_norm(top - room)).where(self.distance() >= top - room)
        best = level.agg(F.max_by(F.struct("id", "weight", "data"), F.struct(F.round(self.exact(), 9), -F.col("id")))).first()[0]
        self.far = top - room
        self.add(best)


_NORM = "_norm"
_SLACK = 1e-9


def _pool(samples: DataFrame) -> DataFrame:
    """Candidates with their squared norm, largest first, so that files and row groups of small ones are passed over."""
    slim = samples.select("id", "weight", "data", dot(F.col("data"), F.col("data")).alias(_NORM))
    return materialize(slim.orderBy(F.desc(_NORM)), "starter-pool")


def farthest_first(samples: DataFrame, k: int, share: float = 0.20) -> DataFrame:
    """Best sample, then k-1 times the sample farthest from those already chosen."""
    pool, take, _ = best_share(samples, k, share)
    if take == k:
        return _as_frame(samples, k_most_weight(samples, k).select("id", "weight", "data").collect())
    # Every pick reads the pool once more, so it is cut out of the samples only once.
    pool = _pool(pool)
    chosen = _Chosen(k_most_weight(pool, 1).select("id", "weight", "data").first().asDict())
    while len(chosen.rows) < k:
        # Distances only grow, so the last pick's is still reached.
        chosen.take_farthest(pool, chosen.far)
    return _as_frame(samples, chosen.rows)


def farthest_in_bands(samples: DataFrame, k: int, share: float = 0.20) -> DataFrame:
    """As ``farthest_first``, but pick i may only come from the i-th rank band of the pool."""
    pool, take, _ = best_share(samples, k, share)
    if take == k:
        return _as_frame(samples, k_most_weight(samples, k).select("id", "weight", "data").collect())
    pool = _pool(pool)
    ends = [take * i // k for i in range(1, k)]
    edges = _best_at(pool, [0] + [max(e - 1, 0) for e in ends])
    chosen = _Chosen(k_most_weight(pool, 1).select("id", "weight", "data").first().asDict())
    begin = 1
    for end in ends:
        if end > begin:
            chosen.take_farthest(pool.where(_not_after(edges[end - 1]) & ~_not_after(edges[begin - 1])))
        begin = end
    return _as_frame(samples, chosen.rows)


def _as_frame(samples: DataFrame, rows: list) -> DataFrame:
    ranked = [(i, r["id"], r["weight"], list(r["data"])) for i, r in enumerate(rows)]
    return samples.sparkSession.createDataFrame(ranked, "pick int, id long, weight double, data array<double>")


#: Vectors of one run that a task may hold while it goes on alone; the others are scanned where they lie. Changes no result.
ACTIVE = 100_000
#: Steps of the gap scale: a quarter of a power of two each, cut off at 2^-40 and 2^40.
_GAPS, _LAST_GAP = 4, 160


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the nearest centre (the first among equals) and how much farther the second nearest is.

    Distances come from one matrix product; rows whose two nearest are level within its rounding are measured again,
    coordinate by coordinate, so the answer doesn't depend on the rows beside it.
    """
    if len(c) == 1:
        return np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    norms, own = np.einsum("nd,nd->n", x, x), np.einsum("kd,kd->k", c, c)
    far = x @ (-2.0 * c.T)
    far += own
    far += norms[:, None]
    two = np.partition(far, 1, axis=1)[:, :2]
    level = np.flatnonzero(two[:, 1] - two[:, 0] <= 1e-11 * (norms + own.max()))
    if len(level):
        far[level] = np.stack([((x[level] - row) ** 2).sum(axis=1) for row in c], axis=1)
        two[level] = np.partition(far[level], 1, axis=1)[:, :2]
    two = np.sqrt(np.maximum(two, 0.0))
    return far.argmin(axis=1), two[:, 1] - two[:, 0]


def _gap_steps(gap: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(_GAPS * np.log2(gap)), -_LAST_GAP, _LAST_GAP).astype(np.int64)


def _rows_of(batch: pa.RecordBatch | pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    data = batch["data"].combine_chunks() if isinstance(batch, pa.Table) else batch["data"]
    return np.asarray(data.flatten()).reshape(-1, dims), np.asarray(batch["who"])


class _Sums:
    """Number, summed hash and sum of the samples of each centre."""

    def __init__(self, k: int, dims: int, n=None, who=None, sums=None):
        self.n = np.zeros(k, np.int64) if n is None else n
        self.who = np.zeros(k, np.int64) if who is None else who
        self.sums = np.zeros((k, dims)) if sums is None else sums

    def add(self, x: np.ndarray, who: np.ndarray, near: np.ndarray, times: int = 1) -> _Sums:
        at = near == np.arange(len(self.n))[:, None]
        self.n += times * at.sum(axis=1)
        self.who += times * (at @ who)
        self.sums += times * (at.astype(float) @ x)
        return self

    def copy(self) -> _Sums:
        return _Sums(*self.sums.shape, self.n.copy(), self.who.copy(), self.sums.copy())

    def members(self) -> list[tuple[int, int]]:
        return list(zip(self.n.tolist(), self.who.tolist()))

    def means(self, centres: np.ndarray) -> np.ndarray:
        """Centres moved to the means of their samples; one without samples stays."""
        return np.where(self.n[:, None] > 0, self.sums / np.maximum(self.n, 1)[:, None], centres)


def _lloyd_step(vectors: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[_Sums, np.ndarray]]:
    """One scan for all runs: per run the samples nearest to each centre, and how many there are of every gap step.

    A task hands on as many numbers whatever its rows; equal distances go to the first centre.
    """
    width = 2 * _LAST_GAP + 1

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {r: (_Sums(*c.shape), np.zeros(width, np.int64)) for r, c in centres.items()}
        for batch in batches:
            x, who = _rows_of(batch, next(iter(centres.values())).shape[1])
            for r, c in centres.items() if len(x) else ():
                near, gap = _nearest(x, c)
                found[r][0].add(x, who, near)
                found[r][1][:] += np.bincount(_gap_steps(gap) + _LAST_GAP, minlength=width)
        for r, (sums, steps) in found.items():
            whole, part = np.concatenate([sums.n, sums.who, steps]), sums.sums.ravel()
            at = np.r_[np.flatnonzero(whole), np.arange(len(part)) + len(whole)]
            whole, part = (np.concatenate(v)[at] for v in ((whole, np.zeros(len(part), np.int64)), (np.zeros(len(whole)), part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), r), pa.int32()), pa.array(at, pa.int32()), pa.array(whole), pa.array(part)], names=["run", "at", "whole", "part"]
            )

    rows = vectors.mapInArrow(nearest, "run int, at int, whole long, part double").groupBy("run", "at")
    rows = rows.agg(F.sum("whole").alias("whole"), F.sum("part").alias("part")).toArrow()
    run, at, whole, part = (np.asarray(rows[c]) for c in ("run", "at", "whole", "part"))
    out = {}
    for r, c in centres.items():
        k, mine = len(c), run == r
        ints, sums = np.zeros(2 * k + width, np.int64), np.zeros(c.size)
        head = mine & (at < len(ints))
        ints[at[head]], sums[at[mine & ~head] - len(ints)] = whole[head], part[mine & ~head]
        out[r] = _Sums(*c.shape, ints[:k], ints[k : 2 * k], sums.reshape(c.shape)), ints[2 * k :]
    return out


def _moved(now: np.ndarray, then: np.ndarray) -> float:
    """How much nearer a centre can have come to any sample than another one, at most."""
    return float(np.sort(np.sqrt(((now - then) ** 2).sum(axis=1)))[-2:].sum())


class _Alone(NamedTuple):
    """What a task needs to take further steps of a run with the few samples that may change their centre.

    ``found`` are the samples of each centre at ``measured``; while the centres have moved by less than ``room`` from there,
    samples of gap step ``cut`` and more keep their centre.
    """

    measured: np.ndarray
    cut: int
    room: float
    found: _Sums
    centres: np.ndarray


def _few_active(steps: np.ndarray, measured: np.ndarray, found: _Sums, centres: np.ndarray) -> _Alone | None:
    """Steps that a task can take alone: at most ``ACTIVE`` samples, and room for more than two steps like the last."""
    cut = int(np.searchsorted(np.cumsum(steps), ACTIVE, side="right")) - _LAST_GAP
    # One gap step less than the cut leaves room for rounding; the first gap step has no lower end.
    room = math.inf if cut > _LAST_GAP else 2.0 ** ((cut - 1) / _GAPS) if cut > -_LAST_GAP else 0.0
    return _Alone(measured, cut, room, found, centres) if 3.0 * _moved(centres, measured) <= room else None


def _steps_alone(vectors: DataFrame, runs: dict[int, _Alone]) -> dict[int, tuple[np.ndarray, list]]:
    """Further steps of each run, in one task a run: its centres and who was nearest to them one step before.

    They are those of full scans: a task stops before a sample that it doesn't hold could change its centre.
    """
    dims = next(iter(runs.values())).centres.shape[1]

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _rows_of(batch, dims)
            for run, a in runs.items() if len(x) else ():
                mine = batch.take(pa.array(np.flatnonzero(_gap_steps(_nearest(x, a.measured)[1]) < a.cut)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(mine.num_rows, run), pa.int32()), mine["data"], mine["who"]], names=["run", "data", "who"]
                )

    def go_on(key: tuple, rows: pa.Table) -> pa.Table:
        a = runs[key[0].as_py()]
        (x, who), centres, held = _rows_of(rows, dims), a.centres, a.found.members()
        measured, near, gap = a.measured, *_nearest(x, a.measured)
        settled = a.found.copy().add(x, who, near, -1)
        m = len(x)
        while _moved(centres, a.measured) < a.room:
            if 4 * m >= len(x):
                measured, (near, gap) = centres, _nearest(x, centres)
                order = np.argsort(gap, kind="stable")
                x, who, near, gap = x[order], who[order], near[order], gap[order]
                found = settled.copy().add(x, who, near)
            # Those closest to changing their centre stand first; a fifth more than the centres moved leaves room for rounding.
            m = int(np.searchsorted(gap, 1.2 * _moved(centres, measured), side="right"))
            first = x[:m], who[:m]
            now = found.copy().add(*first, near[:m], -1).add(*first, _nearest(x[:m], centres)[0])
            if now.members() == held:
                break
            held, centres = now.members(), now.means(centres)
        n, ids = zip(*held)
        columns = key[0].as_py(), centres.ravel().tolist(), list(n), list(ids)
        kinds = pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64())
        return pa.table([pa.array([v], t) for v, t in zip(columns, kinds)], names=["run", "centres", "n", "who"])

    rows = vectors.select("data", "who").mapInArrow(active, "run int, data array<double>, who long").repartition(4 * len(runs), "run")
    found = rows.groupBy("run").applyInArrow(go_on, "run int, centres array<double>, n array<long>, who array<long>").collect()
    return {r["run"]: (np.array(r["centres"]).reshape(-1, dims), list(zip(r["n"], r["who"]))) for r in found}


def _costs(vectors: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, float]:
    """Summed squared distance of all samples to their nearest centre, per run."""
    dims = len(next(iter(centres.values()))[0])

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _rows_of(batch, dims)
            sums = [float(((x - c[_nearest(x, c)[0]]) ** 2).sum()) if len(x) else 0.0 for c in centres.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(centres), pa.int32()), pa.array(sums)], names=["run", "cost"])

    found = vectors.mapInArrow(cost, "run int, cost double").groupBy("run").agg(F.sum("cost").alias("cost"))
    return {r["run"]: r["cost"] for r in found.collect()}


def kmeans_centres(samples: DataFrame, k: int, seed: int, restarts: int = 5) -> DataFrame:
    """Cluster centres of the cheapest of several runs (the first among equals), in order of their coordinates.

    A run starts from the ``k`` samples with the smallest uniforms of (id, run), so any engine with the generator finds
    the same; its centres move to the means of the samples nearest to them until no sample changes its centre. A centre
    without samples stays where it is. Fewer than ``k`` samples give as many centres; none give none.

    A scan of all samples tells how far each is from changing its centre. As soon as few enough of them can within several
    steps, one task a run takes those steps with these samples and the sums of all others; a run ends on a full scan.
    """
    spark = samples.sparkSession
    who = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("who")
    # Every step scans the samples, so they are dealt evenly once.
    vectors = materialize(samples.select("id", "data", who).repartition(spark.sparkContext.defaultParallelism), "kmeans-vectors")
    drawn = with_uniforms(vectors, F.col("id"), {f"_u{r}": r for r in range(restarts)}, seed)
    first = [drawn.orderBy(f"_u{r}", "id").limit(k).select("data").collect() for r in range(restarts)]
    centres = {r: np.array([x["data"] for x in rows]) for r, rows in enumerate(first) if rows}
    held: dict[int, list] = {}
    going = set(centres)
    while going:
        alone = {}
        for r, (now, steps) in _lloyd_step(vectors, {r: centres[r] for r in sorted(going)}).items():
            if now.members() == held.get(r):
                going.remove(r)
                continue
            held[r], measured = now.members(), centres[r]
            centres[r] = now.means(measured)
            few = _few_active(steps, measured, now, centres[r])
            if few is not None:
                alone[r] = few
        if alone:
            for r, (moved, members) in _steps_alone(vectors, alone).items():
                centres[r], held[r] = moved, members
    costs = _costs(vectors, centres) if centres else {}
    best = min(sorted(costs), key=lambda r: round(costs[r], 9), default=None)
    rows = [] if best is None else sorted(centres[best].tolist())
    return spark.createDataFrame(list(enumerate(rows)), "pick int, data array<double>")


def _bin_key(by: list[str]) -> Column:
    """A key of its own for every bin, or for every (level, bin)."""
    key = F.col(by[-1]).cast("long")
    return key if len(by) == 1 else F.shiftleft(F.col(by[0]).cast("long"), 32).bitwiseOR(key)


def draw_pool(samples: DataFrame, capacity: int, seed: int, by: str | list[str] = "bin") -> DataFrame:
    """``capacity`` uniform picks with replacement from every bin, or from every (level, bin).

    Picks are row numbers, so the large side is only probed on (bin, row);
    there are (bins x capacity) of them.
    """
    by = [by] if isinstance(by, str) else by
    ranked = global_rank(samples.select(*by, "id"), by, ["id"], label="pool")
    sizes = ranked.groupBy(*by).agg(F.max("n").alias("_n"))
    picks = sizes.withColumn("pick", F.explode(F.sequence(F.lit(0), F.lit(capacity - 1))))
    picks = with_uniforms(picks, _bin_key(by), {"_u": F.col("pick")}, seed)
    picks = picks.select(*by, F.floor(F.col("_u") * F.col("_n")).alias("rn"), "pick")
    chosen = ranked.join(picks, [*by, "rn"]).select(*by, "id", "pick")
    # Only now the wide rows: each is read once and kept if one of the few picks names it.
    return samples.join(chosen, [*by, "id"]).select("pick", *samples.columns)


def start_from_pool(samples: DataFrame, pool: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """A bin chosen by a random rank among the best ``pool`` rows, then a uniform row of that bin; one row per ``by``.

    Bins are ordered by energy; ``samples`` carries a ``bin`` column. ``by`` names at most the level.
    """
    by = by or []
    counts = samples.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*by).orderBy("bin") if by else Window.orderBy("bin")
    counts = counts.withColumns({"_end": F.sum("_c").over(order), "_total": F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    drawn = with_uniforms(counts, F.col(by[0]) if by else F.lit(0), {"_a": 0, "_b": 1}, seed)
    rank = F.floor(F.col("_a") * F.least(F.lit(pool), F.col("_total")))
    bins = drawn.where((rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end")))
    bins = bins.select(*by, "bin", F.floor(F.col("_b") * F.col("_c")).alias("rn"))
    inside = samples.join(bins.drop("rn"), [*by, "bin"], "left_semi")
    ranked = global_rank(inside.select(*by, "bin", "id"), [*by, "bin"], ["id"], label="pool-start")
    return samples.join(ranked.join(bins, [*by, "bin", "rn"]).select(*by, "bin", "id"), [*by, "bin", "id"], "left_semi")
