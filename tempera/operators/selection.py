"""Rows at given ranks without sorting the data.

A target rank lies in some value interval. Each round splits the interval at
approximate percentiles, counts the cells exactly (both are partial
aggregations), and keeps only the cell holding the target. When the cell is
small it is ranked directly; when it is one repeated value the search goes on
over the tie-breaking column. So neither a huge group nor a huge run of equal
values ever meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempera.operators.ranking import global_rank

SMALL = 100_000  # rows ranked inside one task
MAX_GROUPS = 10_000
_GRID = 64


@dataclass(frozen=True)
class _Target:
    group: tuple
    rank: int  # asked for, within the group
    left: int  # rank still to find inside the interval
    size: int  # rows inside the interval
    low: object = None
    high: object = None
    value: object = None  # set once the value itself is known


def select_ranks(
    df: DataFrame, by: list[str], value: str, tie: str, wanted: Callable[[int], list[int]], small: int = SMALL
) -> DataFrame:
    """Rows (by..., rank, value, tie, n) at the 0-based ranks ``wanted(n)`` of each group.

    Order is ascending in ``value`` then in the unique ``tie``. Groups and
    ranks must be few; with very many groups exact ranks are used instead.
    """
    slim = df.select(*by, value, tie)
    rows = selected_rows(slim, by, value, tie, wanted, small)
    if rows is None:
        return _by_full_rank(slim, by, value, tie, wanted)
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    fields = [(c, kinds[c]) for c in by] + [("rank", "long"), (value, kinds[value]), (tie, kinds[tie]), ("n", "long")]
    return df.sparkSession.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in fields))


def selected_rows(
    df: DataFrame, by: list[str], value: str, tie: str, wanted: Callable[[int], list[int]], small: int = SMALL
) -> list[tuple] | None:
    """The same rows on the driver (a few per group), or None when there are too many groups."""
    slim = df.select(*by, value, tie)
    sizes = slim.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).take(MAX_GROUPS + 1)
    if len(sizes) > MAX_GROUPS:
        return None
    n_of = {tuple(r[c] for c in by): r["n"] for r in sizes}
    targets = [
        _Target(group, int(rank), int(rank), n)
        for group, n in n_of.items()
        for rank in sorted(set(wanted(n)))
        if 0 <= rank < n
    ]
    targets = _narrow(slim, by, value, targets, small)
    stuck = [t for t in targets if t.value is not None and t.size > small]
    found = _finish(slim, by, value, tie, [t for t in targets if t not in stuck], on_tie=False)
    if stuck:
        ties = _narrow(slim, by, tie, [replace(t, low=None, high=None) for t in stuck], small, value)
        found += _finish(slim, by, value, tie, ties, on_tie=True)
    return [(*t.group, t.rank, v, i, n_of[t.group]) for t, v, i in found]


def _by_full_rank(slim, by, value, tie, wanted) -> DataFrame:
    def ranks(n: pd.Series) -> pd.Series:
        return n.map(lambda x: [int(r) for r in wanted(int(x))])

    pick = F.pandas_udf(ranks, "array<long>")
    ranked = global_rank(slim, by, [value, tie])
    asked = ranked.where("rn = 0").select(*by, F.explode(pick("n")).alias("rn"))
    return ranked.join(asked, [*by, "rn"]).select(*by, F.col("rn").alias("rank"), value, tie, "n")


def _regions(slim: DataFrame, by: list[str], targets: list[_Target], column: str, fixed: str | None):
    """Rows inside the distinct intervals that hold targets, labelled ``_rid``, and the labels.

    The intervals ride along as one small array per group (a constant for the
    whole frame), so the data are filtered where they are read.
    """
    spark = slim.sparkSession
    labels = {k: i for i, k in enumerate({(t.group, t.low, t.high, t.value): None for t in targets})}
    kind = slim.schema[column].dataType.simpleString()
    value_kind = slim.schema[fixed or column].dataType.simpleString()
    region = f"struct<rid:int,lo:{kind},hi:{kind},v:{value_kind}>"
    packed: dict[tuple, list] = {}
    for (group, lo, hi, v), i in labels.items():
        packed.setdefault(group, []).append((i, lo, hi, v))
    x = F.col(column)

    def holds(r):
        ok = r["lo"].isNull() | ((x >= r["lo"]) & (x <= r["hi"]))
        return ok & (F.col(fixed) == r["v"]) if fixed else ok

    if by:
        keys = ", ".join(f"`_g_{c}` {slim.schema[c].dataType.simpleString()}" for c in by)
        rows = [(*g, regions) for g, regions in packed.items()]
        table = F.broadcast(spark.createDataFrame(rows, f"{keys}, _regions array<{region}>"))
        same = F.lit(True)
        for c in by:
            same = same & slim[c].eqNullSafe(F.col(f"_g_{c}"))
        tagged = slim.join(table, same)
    else:
        bounded = [t for t in targets if t.low is not None]
        if len(bounded) == len(targets):
            slim = slim.where((x >= min(t.low for t in bounded)) & (x <= max(t.high for t in bounded)))
        if fixed:
            slim = slim.where(F.col(fixed).isin(sorted({t.value for t in targets})))
        literal = F.array(
            *[F.struct(*[F.lit(f).alias(n) for f, n in zip(r, ("rid", "lo", "hi", "v"))]) for r in packed[()]]
        )
        tagged = slim.withColumn("_regions", literal.cast(f"array<{region}>"))
    inside = tagged.withColumn("_rid", F.explode(F.transform(F.filter("_regions", holds), lambda r: r["rid"])))
    return inside.select("_rid", *[c for c in slim.columns if c not in by]), labels


def _narrow(slim, by, column, targets, small, fixed=None) -> list[_Target]:
    """Shrink every target's interval until it is small or a single value."""

    def open_(t: _Target) -> bool:
        return t.size > small and (t.low is None or t.low != t.high)

    while any(open_(t) for t in targets):
        live = [t for t in targets if open_(t)]
        rows, rid = _regions(slim, by, live, column, fixed)
        grid = [i / _GRID for i in range(1, _GRID)]
        cuts = rows.groupBy("_rid").agg(
            F.percentile_approx(column, grid, 2_000).alias("c"), F.max(column).alias("m")
        )
        splits = {r["_rid"]: sorted({*r["c"], r["m"]}) for r in cuts.collect()}
        spark = slim.sparkSession
        kind = slim.schema[column].dataType.simpleString()
        table = F.broadcast(spark.createDataFrame(list(splits.items()), f"_rid int, _splits array<{kind}>"))
        # Even cells are gaps between splits, odd cells a split itself, so frequent values stand alone.
        below = F.size(F.filter("_splits", lambda s: s < F.col(column)))
        cell = 2 * below + F.array_contains("_splits", F.col(column)).cast("int")
        cells: dict[int, list] = {}
        counted = rows.join(table, "_rid").groupBy("_rid", cell.alias("cell")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")
        )
        for r in counted.orderBy("_rid", "cell").collect():
            cells.setdefault(r["_rid"], []).append(r)
        moved = []
        for t in targets:
            if open_(t):
                left = t.left
                for c in cells[rid[t.group, t.low, t.high, t.value]]:
                    if left < c["n"]:
                        t = replace(t, left=left, size=c["n"], low=c["lo"], high=c["hi"])
                        break
                    left -= c["n"]
            moved.append(t)
        targets = moved
    if fixed is None:
        targets = [replace(t, value=t.low) if t.size > small else t for t in targets]
    return targets


def _finish(slim, by, value, tie, targets, on_tie: bool) -> list[tuple]:
    """Rank the small intervals directly and read off the targets."""
    if not targets:
        return []
    column, fixed = (tie, value) if on_tie else (value, None)
    rows, rid = _regions(slim, by, targets, column, fixed)
    spark = slim.sparkSession
    asked = {(rid[t.group, t.low, t.high, t.value], t.left): [] for t in targets}
    for t in targets:
        asked[rid[t.group, t.low, t.high, t.value], t.left].append(t)
    w = Window.partitionBy("_rid").orderBy(value, tie)
    placed = rows.select("_rid", value, tie, (F.row_number().over(w) - 1).cast("long").alias("_rn"))
    probe = F.broadcast(spark.createDataFrame(list(asked), "_rid int, _rn long"))
    return [
        (t, r[value], r[tie]) for r in placed.join(probe, ["_rid", "_rn"]).collect() for t in asked[r["_rid"], r["_rn"]]
    ]


def kth_largest(df: DataFrame, value: str, tie: str, k: int) -> float:
    """k-th largest (1-based), or the smallest when there are fewer than k rows."""
    if k <= 10_000:
        best = df.select(value).orderBy(F.col(value).desc()).limit(k)
        return best.agg(F.min(value).alias("v")).first()["v"]
    negated = df.select((-F.col(value)).alias("v"), tie)
    ((_, v, _, _),) = selected_rows(negated, [], "v", tie, lambda n: [min(k, n) - 1])
    return -v


def exact_percentiles(df: DataFrame, by: list[str], value: str, tie: str, levels: list[float]) -> DataFrame:
    """Linearly interpolated percentiles from the exact values around each position."""
    def around(n: int) -> list[int]:
        return [f(p * (n - 1)) for p in levels for f in (math.floor, math.ceil)]

    ends = select_ranks(df, by, value, tie, around)
    points = F.array(*[F.lit(float(p)) for p in levels])
    near = ends.select(*by, value, "rank", F.explode(points).alias("p"), "n").withColumn(
        "h", F.col("p") * (F.col("n") - 1)
    )
    lower = F.max(F.when(F.col("rank") == F.floor("h"), F.col(value)))
    upper = F.max(F.when(F.col("rank") == F.ceil("h"), F.col(value)))
    out = near.groupBy(*by, "p").agg(
        lower.alias("_lo"), upper.alias("_hi"), F.max(F.col("h") - F.floor("h")).alias("_w")
    )
    return out.select(*by, "p", (F.col("_lo") + F.col("_w") * (F.col("_hi") - F.col("_lo"))).alias("value"))
