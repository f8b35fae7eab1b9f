"""Energy bins: three ways to place them and the lookup."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempera.operators.energy import geometric_points
from tempera.operators.ranking import global_rank
from tempera.operators.selection import selected_rows
from tempera.plans.staging import materialize


def bin_index(energy: Column, lower_bounds: Column) -> Column:
    """Last bin whose lower bound does not exceed the energy; bin 0 below or without bounds."""
    at_or_below = F.size(F.filter(lower_bounds, lambda b: b <= energy))
    return F.when(lower_bounds.isNull(), F.lit(0)).otherwise(
        F.greatest(at_or_below - 1, F.lit(0))
    ).cast("int")


def attach_bounds(df: DataFrame, bounds: DataFrame, level: Column | None = None) -> DataFrame:
    """Add ``lower_bounds`` of each row's level (or of another level given as a Column)."""
    packed = bounds.groupBy(F.col("level").alias("_level")).agg(
        F.sort_array(F.collect_list("lo")).alias("lower_bounds")
    )
    wanted = F.col("level") if level is None else level
    return df.join(materialize(packed, "bounds"), wanted == F.col("_level"), "left").drop("_level")


def assign_bins(df: DataFrame, bounds: DataFrame) -> DataFrame:
    return (
        attach_bounds(df, bounds)
        .withColumn("bin", bin_index(-F.col("weight"), F.col("lower_bounds")))
        .drop("lower_bounds")
    )


def _equal_chunks(n: int, bins: int) -> list[tuple[int, int]]:
    """First and last rank of every chunk of ceil(n / bins); a lone leftover joins the chunk before it."""
    size = -(-n // bins)
    starts = list(range(0, n, size))
    if len(starts) > 1 and starts[-1] == n - 1:
        starts.pop()
    return list(zip(starts, [s - 1 for s in starts[1:]] + [n - 1]))


def equal_count_bounds(df: DataFrame, bins: int) -> DataFrame:
    """Bounds of equal-count bins: (level, bin, lo, lo_id, hi, n), by rank selection, without a sort."""
    slim = df.select("level", (-F.col("weight")).alias("energy"), "id")
    edges = selected_rows(slim, ["level"], "energy", "id", lambda n: [r for c in _equal_chunks(n, bins) for r in c])
    if edges is None:  # very many levels: from exact ranks
        ranked = equal_count_ranked(df, bins).groupBy("level", "bin").agg(
            F.min(F.struct("energy", "id")).alias("first"), F.max("energy").alias("hi"), F.count(F.lit(1)).alias("n")
        )
        return ranked.select(
            "level", "bin", F.col("first.energy").alias("lo"), F.col("first.id").cast("long").alias("lo_id"), "hi", "n"
        )
    at = {(level, rank): (energy, ident) for level, rank, energy, ident, _ in edges}
    rows = []
    for level, n in {(e[0], e[-1]) for e in edges}:
        for b, (first, last) in enumerate(_equal_chunks(n, bins)):
            rows.append((level, b, *at[level, first], at[level, last][0], last - first + 1))
    return df.sparkSession.createDataFrame(sorted(rows), "level int, bin int, lo double, lo_id long, hi double, n long")


def assign_equal_count(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Bin of every sample by its (energy, id) against the bins' first samples."""
    packed = bounds.groupBy(F.col("level").alias("_level")).agg(
        F.collect_list(F.struct("lo", "lo_id")).alias("_firsts")
    )
    joined = df.join(materialize(packed, "bounds"), F.col("level") == F.col("_level"))
    here = F.struct((-F.col("weight")).alias("lo"), F.col("id").cast("long").alias("lo_id"))
    reached = F.size(F.filter("_firsts", lambda b: b <= here))
    return joined.withColumn("bin", (reached - 1).cast("int")).drop("_level", "_firsts")


def equal_count_bins(df: DataFrame, bins: int) -> DataFrame:
    return assign_equal_count(df, equal_count_bounds(df, bins))


def equal_count_ranked(df: DataFrame, bins: int) -> DataFrame:
    """Every (level, id) with its energy rank ``rn``, level size ``n``, chunk size and bin.

    Chunks hold ceil(n / bins) samples in energy order; a single leftover
    sample joins the chunk before it.
    """
    slim = df.select("level", (-F.col("weight")).alias("energy"), "id")
    ranked = global_rank(slim, ["level"], ["energy", "id"], label="equal-count")
    n, chunk, last = F.col("n"), F.col("chunk"), F.col("n") - 1
    full = F.floor(last / chunk)
    n_bins = F.when((last % chunk == 0) & (last >= chunk), full).otherwise(F.ceil(n / chunk))
    return ranked.withColumn("chunk", F.ceil(n / F.lit(bins))).withColumn(
        "bin", F.least(F.floor(F.col("rn") / chunk), n_bins - 1).cast("int")
    )


def bin_bounds(binned: DataFrame) -> DataFrame:
    return binned.groupBy("level", "bin").agg(
        F.min("energy").alias("lo"), F.max("energy").alias("hi"), F.count(F.lit(1)).alias("n")
    )


def geometric_bounds(df: DataFrame, bins: int) -> DataFrame:
    """Lower bounds between each level's extreme energies, spacing growing geometrically."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for level, low, high in zip(pdf["level"], pdf["low"], pdf["high"]):
                points = geometric_points(bins, low, high)
                out += [(level, j, p) for j, p in enumerate(points)]
            yield pd.DataFrame(out, columns=["level", "bin", "lo"])

    extremes = df.groupBy("level").agg(
        F.min(-F.col("weight")).alias("low"), F.max(-F.col("weight")).alias("high")
    )
    return extremes.mapInPandas(place, "level int, bin int, lo double")


def width_for_acceptance(t_here: float, t_above: float, accept: float) -> float:
    """Widest bin that keeps the worst-case jump acceptance at or above ``accept``."""
    return -math.log(accept) / (1.0 / t_here - 1.0 / t_above)


def width_rule_bins(df: DataFrame, ladder: list[float], accept: float) -> DataFrame:
    """Bin every sample of levels >= 1 by the constant-width rule of its own level."""
    widths = F.array(
        *[F.lit(None).cast("double")]
        + [F.lit(width_for_acceptance(a, b, accept)) for a, b in zip(ladder[:-1], ladder[1:])]
    )
    lows = df.groupBy(F.col("level").alias("_level")).agg(F.min(-F.col("weight")).alias("low"))
    joined = df.where(F.col("level") >= 1).join(
        materialize(lows, "lows"), F.col("level") == F.col("_level")
    )
    width = F.element_at(widths, F.col("level") + 1)
    return joined.withColumn("energy", -F.col("weight")).withColumn(
        "bin", F.floor((F.col("energy") - F.col("low")) / width).cast("int")
    ).drop("_level")


def widest_energy(low: np.ndarray, width: float) -> np.ndarray:
    """For each lower end the largest double ``x`` with ``x - low <= width`` in double arithmetic.

    Doubles are bisected in their own order, as whole numbers, so the answer agrees with the comparison bit for bit.
    """
    low = np.asarray(low, dtype=np.float64)

    def number(x: np.ndarray) -> np.ndarray:
        bits = np.asarray(x, dtype=np.float64).view(np.int64)
        return bits ^ ((bits >> 63) & np.int64(2**63 - 1))

    def double(n: np.ndarray) -> np.ndarray:
        return (n ^ ((n >> 63) & np.int64(2**63 - 1))).view(np.float64)

    fits, fails = np.full(low.shape, -np.inf), np.full(low.shape, np.inf)
    a, b = number(fits), number(fails)
    with np.errstate(invalid="ignore"):
        for _ in range(64):
            middle = (a >> 1) + (b >> 1) + (a & b & 1)
            narrow = double(middle) - low <= width
            a, b = np.where(narrow, middle, a), np.where(narrow, b, middle)
        return np.where(fails - low <= width, fails, double(a))


def next_starts(ranked: DataFrame, min_bins: int, max_width: float) -> DataFrame:
    """(level, at, to, lo, n): where the bin that starts at rank ``at`` hands over to the next one; ``to >= n`` ends a level.

    Bins have ceil(n / min_bins) samples, halved until their energies are at most ``max_width`` apart. How far a rank
    reaches is its place in one more sort, of all energies together with the widest energy of every rank.
    """

    @F.pandas_udf("double")
    def widest(low: pd.Series) -> pd.Series:
        return pd.Series(widest_energy(low.to_numpy(), max_width))

    ends = ranked.select("level", F.col("energy").alias("value"), F.lit(0).alias("probe"), "rn", "energy", F.col("n").alias("size"))
    probes = ranked.select("level", widest("energy").alias("value"), F.lit(1).alias("probe"), "rn", "energy", F.col("n").alias("size"))
    met = global_rank(ends.unionByName(probes), ["level"], ["value", "probe", "rn"], "_place", "_both", "reach").where("probe = 1")
    # Before a probe stand the probes of lower ranks and all energies within its reach.
    room = F.col("_place") - 2 * F.col("rn") - 1
    full = F.ceil(F.col("size") / F.lit(min_bins))
    first = F.when(F.col("rn") + full < F.col("size"), full).otherwise(F.col("size") - F.col("rn") - 1)
    met = met.select("level", "rn", "energy", "size", first.cast("long").alias("first"), room.cast("long").alias("room"))
    halved = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda j: F.call_function("shiftright", F.col("first"), j))
    step = F.get(F.filter(halved, lambda s: (s <= 1) | (s <= F.col("room"))), F.lit(0))
    met = met.withColumn("step", step)
    whole = F.when(F.col("rn") + F.col("step") == F.col("size") - 1, F.col("step") + 1).otherwise(F.col("step"))
    return met.select(
        "level", F.col("rn").alias("at"), (F.col("rn") + F.greatest(whole, F.lit(1))).alias("to"), F.col("energy").alias("lo"), F.col("size").alias("n")
    )


def follow(hops: DataFrame) -> DataFrame:
    """(level, at): every start met on the way from rank 0, by pointer doubling.

    Round k has pointers that skip 2**k bins, kept only for starts that pointers of the round before lead to; it
    ends when none is left from rank 0. Then starts are filled in from the longest skip down. Rounds grow with the
    logarithm of the bins; a start is a row, never a value on the driver.
    """
    here = materialize(hops.where("to < n").select("level", "at", "to"), "hops-0")
    rounds = [here]
    while not here.where("at = 0").isEmpty():
        landed = here.select("level", F.col("to").alias("at")).distinct()
        kept = here.join(landed.union(here.where("at = 0").select("level", "at")).distinct(), ["level", "at"], "left_semi")
        onward = here.select("level", F.col("at").alias("to"), F.col("to").alias("_end"))
        here = materialize(kept.join(onward, ["level", "to"]).select("level", "at", F.col("_end").alias("to")), f"hops-{len(rounds)}")
        rounds.append(here)
    starts = hops.where("at = 0").select("level", "at")
    for skip in reversed(rounds[:-1]):
        met = starts.join(skip, ["level", "at"], "left")
        starts = met.select("level", F.explode(F.array("at", "to")).alias("at")).where("at is not null")
    return starts


def adaptive_bounds(df: DataFrame, min_bins: int, max_width: float) -> DataFrame:
    """(level, bin, lo, n): bins of at most ceil(n / min_bins) samples, each halved until narrow enough.

    Where a bin ends depends only on where it starts, so every rank gets its pointer at once and the chain from rank 0 is
    followed by doubling. A level without samples has no bins; equal energies are ordered by id.
    """
    slim = df.select("level", (-F.col("weight")).alias("energy"), "id")
    ranked = global_rank(slim, ["level"], ["energy", "id"], label="adaptive").select("level", "rn", "energy", "n")
    hops = materialize(next_starts(ranked, min_bins, max_width), "next-starts")
    starts = materialize(follow(hops).join(hops, ["level", "at"]), "starts")
    numbered = global_rank(starts, ["level"], ["at"], "bin", "_bins", "bins")
    return numbered.select("level", F.col("bin").cast("int").alias("bin"), "lo", (F.least("to", "n") - F.col("at")).alias("n"))
