"""Order statistics: top-K, extrema and exact ranks without one-task groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempera.plans.staging import materialize

POSITION, PIECE = "_position", "_piece"
_OFFSET_BITS = 33  # monotonically_increasing_id: partition number above, row offset below


def _key(order: Column | str) -> Column:
    return F.col(order) if isinstance(order, str) else order


def top_k(df: DataFrame, k: int, by: list[str], order: list) -> DataFrame:
    """First ``k`` rows of each group; every map task forwards at most ``k`` rows per group."""
    w = Window.partitionBy(*by).orderBy(*[_key(o) for o in order])
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def k_most_weight(df: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    order = [F.col("weight").desc(), F.col("id").asc()]
    return top_k(df, k, by, order) if by else df.orderBy(*order).limit(k)


def k_least_weight(df: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    order = [F.col("weight").asc(), F.col("id").asc()]
    return top_k(df, k, by, order) if by else df.orderBy(*order).limit(k)


def most_weight(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Heaviest sample per group, smallest id among equals, in one partial aggregation."""
    best = F.max_by(F.struct("id", "weight", *columns), F.struct("weight", -F.col("id")))
    return df.groupBy(*by).agg(best.alias("best")).select(*by, "best.*")


def least_weight(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    best = F.min_by(F.struct("id", "weight", *columns), F.struct("weight", "id"))
    return df.groupBy(*by).agg(best.alias("best")).select(*by, "best.*")


def sorted_pieces(df: DataFrame, by: list[str], order: list, label: str) -> DataFrame:
    """Rows range-sorted over ``by`` and ``order`` and written once, with their position and piece.

    Pieces are the sort's balanced partitions, numbered in order. ``order``
    must end in a unique key, so neither a huge group nor a huge run of equal
    values has to fit one piece.
    """
    spread = df.orderBy(*by, *[_key(o) for o in order]).withColumn(POSITION, F.monotonically_increasing_id())
    return materialize(spread, label).withColumn(PIECE, F.shiftright(POSITION, _OFFSET_BITS))


def global_rank(
    df: DataFrame, by: list[str], order: list, out: str = "rn", total: str = "n", label: str = "rank"
) -> DataFrame:
    """Exact 0-based rank ``out`` and group size ``total`` for every row.

    The sorted rows are written once with their position; the only other
    exchange is over one small row per (group, piece).
    """
    pos, part = POSITION, PIECE
    placed = sorted_pieces(df, by, order, label)
    fragments = placed.groupBy(*by, part).agg(
        F.min(pos).alias("_first"), F.count(F.lit(1)).alias("_size")
    )
    group = Window.partitionBy(*by)
    before = group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    fragments = fragments.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col(part).alias("_fragment"),
        (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_size").over(group).alias(total),
    )
    fragments = materialize(fragments, f"{label}-fragments")  # written, so the planner knows its bytes before it joins
    same = placed[part] == fragments["_fragment"]
    for c in by:
        same = same & placed[c].eqNullSafe(fragments[f"_by_{c}"])
    return placed.join(fragments, same).select(
        *df.columns, (F.col(pos) + F.col("_shift")).alias(out), F.col(total)
    )
