"""Operators along stored chains that may each be arbitrarily long.

Chains are laid out by one range sort over (chain, order), so a chain holding most of the data spans many balanced
pieces. The task that sorts a piece also scans it: state is carried from one Arrow batch to the next and starts
anew with every chain. Only the first chain of a piece can have begun in an earlier one, so what pieces hand on to each other
is one row per piece, and no wide row moves a second time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tempera.operators.ranking import PIECE, POSITION
from tempera.plans.staging import materialize

_OFFSET_BITS = 33  # of POSITION: piece above, row below
NTH, STATE = "_nth", "_state"


def new_chain(chain: pa.Array, before: pa.Array | None) -> np.ndarray:
    """Where a row's chain is not that of the row before; nulls are one chain."""
    previous = pa.concat_arrays([before if before is not None else pa.nulls(1, chain.type), chain[:-1]])
    unlike = pc.fill_null(pc.not_equal(chain, previous), False).to_numpy(zero_copy_only=False)
    out = unlike | (pc.is_null(chain).to_numpy(zero_copy_only=False) != pc.is_null(previous).to_numpy(zero_copy_only=False))
    if before is None and len(out):
        out[0] = True
    return out


def distance(new: np.ndarray, open_rows: int) -> np.ndarray:
    """Rows since the start of each row's chain, ``open_rows`` of which came before this batch if it does not start here."""
    at = np.arange(len(new))
    start = np.maximum.accumulate(np.where(new, at, -1)) if len(new) else at
    return np.where(start >= 0, at - start, open_rows + at)


def running_best(value: np.ndarray, since: np.ndarray) -> np.ndarray:
    """Largest value so far inside each chain, by doubling steps that never reach behind its start; NaN is largest."""
    best, shift = value.copy(), 1
    while shift < len(best) and (since >= shift).any():
        best[shift:] = np.where(since[shift:] >= shift, np.maximum(best[shift:], best[:-shift]), best[shift:])
        shift *= 2
    return best


def _scanned(df: DataFrame, chain: str, order: list[str], label: str, value: str | None = None) -> DataFrame:
    """Rows in chain order, written once, with PIECE, NTH (row of the chain in this piece, from 0) and, for a ``value``,
    STATE: its largest so far in chain and piece, null before the first."""
    spread = df.orderBy(chain, *order).withColumn(POSITION, F.monotonically_increasing_id())
    spread = spread.withColumn("_value", F.col(value).cast("double") if value else F.lit(None).cast("double"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, rows, best = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = new_chain(batch[chain], before)
            since = distance(new, rows)
            raw = batch["_value"]
            known = ~pc.is_null(raw).to_numpy(zero_copy_only=False)
            values = np.where(known, raw.fill_null(0.0).to_numpy(zero_copy_only=False), -np.inf)
            within = np.minimum(since, np.arange(len(since)))
            local, seen = running_best(values, within), running_best(known.astype(np.float64), within) > 0
            if best is not None and not new[0]:
                going_on = since > np.arange(len(since))
                local[going_on], seen = np.maximum(local[going_on], best), seen | going_on
            before, rows = batch[chain].slice(batch.num_rows - 1, 1), int(since[-1]) + 1
            best = local[-1] if seen[-1] else None
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "_value"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(since, pa.int64()), pa.array(local, pa.float64(), mask=~seen)],
                names=[*(n for n in batch.schema.names if n != "_value"), NTH, STATE],
            )

    added = [StructField(NTH, LongType()), StructField(STATE, DoubleType())]
    schema = StructType([f for f in spread.schema if f.name != "_value"] + added)
    return materialize(spread.mapInArrow(scan, schema), label).withColumn(PIECE, F.shiftright(POSITION, _OFFSET_BITS))


def _with_carried(rows: DataFrame, chain: str, handed: Column, fold: Callable[[Column], Column]) -> DataFrame:
    """Add ``_before``: what earlier pieces hand on to the chain that a piece begins with; null for all other rows.

    ``handed`` is what a piece's last row hands on, ``fold`` the aggregate over the pieces in which that chain was last.
    """
    first, last = F.min_by(chain, POSITION), F.max_by(F.struct(F.col(chain).alias("chain"), handed.alias("own")), POSITION)
    ends = rows.groupBy(F.col(PIECE).alias("_at")).agg(F.struct(first.alias("chain")).alias("_first"), last.alias("_last"))
    along = Window.partitionBy("_last.chain").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_all", fold(F.col("_last.own")).over(along))
    previous = F.lag(F.struct("_last.chain", "_all")).over(Window.orderBy("_at"))  # one row a piece
    ends = ends.withColumn("_previous", previous)
    carried = ends.where(F.col("_previous").isNotNull() & F.col("_first.chain").eqNullSafe(F.col("_previous.chain")))
    carried = materialize(carried.select("_at", F.col("_first.chain").alias("_chain"), F.col("_previous._all").alias("_before")), "carried")
    same = (rows[PIECE] == carried["_at"]) & rows[chain].eqNullSafe(carried["_chain"])
    return rows.join(F.broadcast(carried), same, "left").drop("_chain", "_at")


def thin(df: DataFrame, chain: str, order: list[str], burn_in: int, every: int) -> DataFrame:
    """Stored draws after burn-in: the last of each run of ``every`` draws."""
    rows = _with_carried(_scanned(df, chain, order, "thin"), chain, F.col(NTH) + 1, F.sum)
    placed = rows.withColumn("_k", F.col(NTH) + F.coalesce("_before", F.lit(0)) - burn_in)
    kept = placed.where((F.col("_k") >= 0) & (F.col("_k") % every == every - 1))
    return kept.select(*df.columns, F.floor(F.col("_k") / every).alias("draw"))


def running_max(df: DataFrame, chain: str, order: list[str], value: str) -> DataFrame:
    """Best value each chain has seen so far; nulls are passed over."""
    rows = _with_carried(_scanned(df, chain, order, "running-max", value), chain, F.col(STATE), F.max)
    return rows.select(*df.columns, F.greatest(STATE, "_before").alias("running"))


def acceptance(df: DataFrame, chain: str, order: list[str], value: str) -> DataFrame:
    """Share of steps at which the stored value changed, per chain.

    A task counts the steps inside its piece while it scans; a chain that goes on in the next piece adds the one step between.
    """
    fields = df.select(chain, value).schema
    kind = [StructField(chain, fields[chain].dataType), StructField("_at", LongType())]
    ends = [StructField(n, fields[value].dataType) for n in ("_first", "_last")]
    schema = StructType([*kind, *ends, *(StructField(n, LongType()) for n in ("_moved", "_known", "_n"))])
    spread = df.orderBy(chain, *order).select(chain, value, F.monotonically_increasing_id().alias(POSITION))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new, values = new_chain(batch[chain], before), batch[value]
            previous = pa.concat_arrays([last if last is not None else pa.nulls(1, values.type), values[:-1]])
            step = ~new & ~pc.is_null(previous).to_numpy(zero_copy_only=False)
            known = step & ~pc.is_null(values).to_numpy(zero_copy_only=False)
            moved = known & pc.fill_null(pc.not_equal(values, previous), False).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(new)
            starts = np.unique(np.r_[0, cut])
            ends = np.r_[starts[1:], len(new)]
            total = lambda flags: np.add.reduceat(flags.astype(np.int64), starts)
            position = batch[POSITION].take(pa.array(starts))
            first = values.take(pa.array(starts))
            yield pa.RecordBatch.from_arrays(
                [batch[chain].take(pa.array(starts)), position, first, values.take(pa.array(ends - 1)), *(pa.array(total(x)) for x in (moved, known, step))],
                schema=pa.schema([(f.name, t) for f, t in zip(schema, (batch[chain].type, pa.int64(), values.type, values.type, *[pa.int64()] * 3))]),
            )
            before, last = batch[chain].slice(batch.num_rows - 1, 1), values.slice(batch.num_rows - 1, 1)

    # One row per chain and batch; a step from one batch to the next was counted by the later one, between pieces by neither.
    runs = materialize(spread.mapInArrow(count, schema), "acceptance").withColumn(PIECE, F.shiftright("_at", _OFFSET_BITS))
    pieces = runs.groupBy(chain, PIECE).agg(
        F.min_by(F.struct("_first"), "_at").alias("_first"), F.max_by(F.struct("_last"), "_at").alias("_last"),
        *(F.sum(n).alias(n) for n in ("_moved", "_known", "_n")),
    )
    previous = F.lag("_last").over(Window.partitionBy(chain).orderBy(PIECE))["_last"]
    between = pieces.withColumn("_previous", previous).withColumn("_own", F.col("_first._first"))
    met = F.col("_previous").isNotNull()
    both = met & F.col("_own").isNotNull()
    total = between.groupBy(chain).agg(
        F.sum(F.col("_moved") + F.when(both & (F.col("_own") != F.col("_previous")), 1).otherwise(0)).alias("_moved"),
        F.sum(F.col("_known") + both.cast("long")).alias("_known"), F.sum(F.col("_n") + met.cast("long")).alias("n"),
    )
    rate = F.try_divide(F.col("_moved").cast("double"), F.col("_known").cast("double"))
    return total.where("n > 0").select(chain, rate.alias("rate"), "n")
