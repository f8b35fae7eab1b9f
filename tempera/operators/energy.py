"""Temperature ladder and the tempered acceptance rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempera.functions.counter_rng import with_uniforms
from tempera.plans.staging import materialize


def geometric_points(n: int, start: float, end: float) -> list[float]:
    """``n`` points whose increments are g, g**2, ...; point n-2 is ``end``, one more lies beyond.

    g is the positive root of g + ... + g**(n-2) = end - start.
    """
    if n < 2:
        raise ValueError("need at least two points")
    if n == 2:
        return [start, start]
    span = end - start
    if span <= 0.0:
        raise ValueError("end must exceed start")

    def reach(g: float) -> float:
        return sum(g**i for i in range(1, n - 1))

    low, high = 0.0, span ** (1.0 / (n - 2)) * (1.0 + 1e-12)
    for _ in range(2000):
        mid = 0.5 * (low + high)
        if mid in (low, high):
            break
        low, high = (mid, high) if reach(mid) < span else (low, mid)
    g = 0.5 * (low + high)
    points = [start]
    for i in range(1, n - 2):
        points.append(points[-1] + g**i)
    return [*points, end, end + g ** (n - 1)]


def temperatures(levels: int = 10, lowest: float = 1.0, highest: float = 1000.0) -> list[float]:
    """Ladder of ``levels`` temperatures plus the extra hotter one used for seeding."""
    return geometric_points(levels + 1, lowest, highest)


def tempered(weight: Column, temperature: Column | float) -> Column:
    return weight / temperature


def log_ratio(energy_x: Column, energy_y: Column, temperature: Column | float) -> Column:
    """ln p_T(x) - ln p_T(y) at one temperature."""
    return (energy_y - energy_x) / temperature


def jump_log_ratio(w_x: Column, w_y: Column, t_here: Column, t_above: Column) -> Column:
    return log_ratio(-w_y, -w_x, t_here) + log_ratio(-w_x, -w_y, t_above)


def mh_accept(log_ratio_new: Column, log_ratio_old: Column, u: Column) -> Column:
    """Accept on (log kernel - log proposal) of the new and the old point; ties accept."""
    return log_ratio_new - log_ratio_old >= F.log(u)


def propose_jumps(
    binned: DataFrame, bounds: DataFrame, ladder: list[float], p_no_jump: float, seed: int
) -> DataFrame:
    """One cross-level jump attempt for every stored sample at once.

    ``binned`` carries (level, id, energy, rn, chunk, bin) from equal-count
    binning. A sample looks up its bin among the bounds of the level above,
    draws a uniform row of that bin and accepts by the tempered ratio. Rows of
    the level above are unique on (level, rn), so the join cannot skew.
    """
    from tempera.operators.binning import attach_bounds, bin_index
    temps = F.array(*[F.lit(float(t)) for t in ladder])
    bounds = materialize(bounds, "jump-bounds")  # read three times; its size tells the planner how to join
    x = attach_bounds(
        binned.select("level", "id", "energy"),
        bounds.select("level", "bin", "lo"),
        F.col("level") + 1,
    ).where(F.col("lower_bounds").isNotNull())
    x = x.withColumn("bin", bin_index(F.col("energy"), F.col("lower_bounds"))).drop("lower_bounds")
    # Chunks are contiguous in rank, so a bin starts where the smaller bins end.
    sizes = bounds.select(
        F.col("level").alias("_level"), F.col("bin").alias("_bin"), F.col("n").alias("_n"),
        (F.col("bin").cast("long") * F.col("chunk")).alias("_start"),
    )
    x = x.join(sizes, (x["level"] + 1 == F.col("_level")) & (x["bin"] == F.col("_bin")))
    x = with_uniforms(x, F.col("id"), {"_gate": 0, "_which": 1, "_luck": 2}, seed)
    x = x.withColumn("attempt", F.col("_gate") > p_no_jump).withColumn(
        "pick", F.col("_start") + F.floor(F.col("_which") * F.col("_n"))
    )
    y = binned.select(
        F.col("level").alias("level_above"), F.col("rn").alias("pick"), F.col("energy").alias("energy_y"),
        F.col("id").alias("id_y"),
    )
    pairs = x.withColumn("level_above", F.col("level") + 1).join(y, ["level_above", "pick"])
    ratio = jump_log_ratio(
        -F.col("energy"),
        -F.col("energy_y"),
        F.element_at(temps, F.col("level") + 1),
        F.element_at(temps, F.col("level") + 2),
    )
    accept = F.log("_luck") <= ratio
    return pairs.select(
        "level", "id", "bin", "energy", "id_y", "energy_y", "attempt",
        (F.col("attempt") & accept).alias("accepted"),
    )
