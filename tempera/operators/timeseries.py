"""Quarterly panels, per-period likelihoods and regime aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempera.plans.sizing import spread
from tempera.schema import NEG_INF

MISSING_BELOW = -1.0e299


def quarter_of(ts: Column) -> Column:
    """Fractional-year date: year + (quarter - 1) / 4."""
    return F.year(ts) + (F.quarter(ts) - 1) / F.lit(4.0)


def quarter_number(dt: Column) -> Column:
    return F.round(dt * 4).cast("long")


def quarter_calendar(df: DataFrame, ts: str) -> DataFrame:
    """Every quarter from the first to the last date in ``df``, with its row position."""
    ends = df.agg(
        F.min(quarter_number(quarter_of(F.col(ts)))).alias("a"), F.max(quarter_number(quarter_of(F.col(ts)))).alias("b")
    )
    return ends.select(F.posexplode(F.sequence("a", "b")).alias("pos", "q")).select(
        F.col("pos").cast("long").alias("pos"), (F.col("q") / F.lit(4.0)).alias("dt")
    )


def calendar_between(spark: SparkSession, begin: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    first, last = (y * 4 + q - 1 for y, q in (begin, end))
    return spark.range(first, last + 1).select(
        (F.col("id") - first).alias("pos"), (F.col("id") / F.lit(4.0)).alias("dt")
    )


def sample_window(panel: DataFrame, begin: float, end: float, columns: list[str]) -> DataFrame:
    """Rows inside the window and the chosen series, guarding against missing values."""
    inside = panel.where(F.col("dt").between(begin, end)).select("dt", *columns)
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.col(c) < MISSING_BELOW, F.lit(True))
    guard = F.when(bad, F.raise_error(F.lit("missing value inside the sample window")).cast("double"))
    return inside.select("dt", *[F.coalesce(guard, F.col(c)).alias(c) for c in columns])


def to_long(panel: DataFrame, columns: list[str]) -> DataFrame:
    return panel.unpivot(["dt"], columns, "var", "value")


def to_wide(long: DataFrame, columns: list[str]) -> DataFrame:
    return long.groupBy("dt").pivot("var", columns).agg(F.first("value"))


def log_difference(panel: DataFrame, by: list[str], value: str) -> DataFrame:
    """First difference of logs along each (calendar-length) series."""
    w = Window.partitionBy(*by).orderBy("dt")
    return panel.withColumn("dlog", F.log(value) - F.lag(F.log(value)).over(w)).where(F.col("dlog").isNotNull())


@dataclass(frozen=True)
class StateSpace:
    """z' = F z + v, y = a + H z + e, v ~ N(0, V), e ~ N(0, R); z0, P0 start the filter.

    Every array may carry a leading axis, one model per row.
    """

    transition: np.ndarray
    state_noise: np.ndarray
    measure: np.ndarray
    measure_noise: np.ndarray
    intercept: np.ndarray
    z0: np.ndarray
    p0: np.ndarray

    def __post_init__(self):
        nz, ny = self.transition.shape[-1], self.measure.shape[-2]
        wanted = {
            "transition": (nz, nz), "state_noise": (nz, nz), "p0": (nz, nz), "measure": (ny, nz), "measure_noise": (ny, ny),
        }
        for name, shape in wanted.items():
            if getattr(self, name).shape[-2:] != shape:
                raise ValueError(f"{name} has shape {getattr(self, name).shape}, expected {shape}")
        if self.intercept.shape[-1] != ny or self.z0.shape[-1] != nz:
            raise ValueError("intercept or z0 has the wrong length")

    @classmethod
    def local_level(cls, level_var: float, noise_var: float, p0: float) -> StateSpace:
        one = np.ones((1, 1))
        return cls(one, level_var * one, one, noise_var * one, np.zeros(1), np.zeros(1), p0 * one)

    def with_lags(self, states: list[int]) -> StateSpace:
        """Append one-period lags of the listed states to the state vector."""
        n, k = self.transition.shape[0], len(states)
        grow = np.zeros((n + k, n + k))
        f, v, p = grow.copy(), grow.copy(), np.eye(n + k) * float(np.max(np.abs(self.p0)))
        f[:n, :n], v[:n, :n], p[:n, :n] = self.transition, self.state_noise, self.p0
        f[n + np.arange(k), states] = 1.0
        h = np.hstack([self.measure, np.zeros((self.measure.shape[0], k))])
        return StateSpace(f, v, h, self.measure_noise, self.intercept, np.append(self.z0, np.zeros(k)), p)


def state_noise(rows: DataFrame, states: int, shocks: int, total: int | None = None) -> DataFrame:
    """Add ``noise``: the state noise covariance (impact diag(sigma)) (impact diag(sigma))' of every parameter row, row-major.

    ``impact`` is states x shocks, row-major, and ``sigma`` holds the shock sizes of the row's regime; both change from row
    to row, and a batch is multiplied at once. ``total`` states beyond those that shocks reach, such as appended lags, have none. A row
    whose arrays are null, of another length or hold a null has a null covariance.
    """
    total = states if total is None else total
    if total < states:
        raise ValueError(f"{total} states cannot hold {states}")
    sound = (F.size("impact") == states * shocks) & (F.size("sigma") == shocks)
    sound = sound & F.forall("impact", lambda x: x.isNotNull()) & F.forall("sigma", lambda x: x.isNotNull())
    narrow = rows.withColumn("_sound", F.coalesce(sound, F.lit(False)))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    narrow = narrow.withColumns({
        "_impact": F.when(F.col("_sound"), F.col("impact").cast("array<double>")).otherwise(zeros(states * shocks)),
        "_sigma": F.when(F.col("_sound"), F.col("sigma").cast("array<double>")).otherwise(zeros(shocks)),
    })

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            impact = batch["_impact"].flatten().to_numpy().reshape(n, states, shocks)
            scaled = impact * batch["_sigma"].flatten().to_numpy().reshape(n, 1, shocks)
            noise = np.zeros((n, total, total))
            noise[:, :states, :states] = scaled @ _t(scaled)
            known = batch["_sound"].to_numpy(zero_copy_only=False)
            flat = pa.array(noise[known].ravel())
            ends = np.concatenate([[0], np.cumsum(known) * total * total]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(~known))
            kept = [i for i, name in enumerate(batch.schema.names) if name not in ("_impact", "_sigma", "_sound")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), lists], names=[*(batch.schema.names[i] for i in kept), "noise"])

    return narrow.mapInArrow(multiply, rows.select("*", F.lit(None).cast("array<double>").alias("noise")).schema)


def _t(m: np.ndarray) -> np.ndarray:
    return np.swapaxes(m, -1, -2)


def gains(model: StateSpace, periods: int) -> list[tuple]:
    """(gain, inverse forecast variance, log determinant) per period; they do not depend on data."""
    p, out = model.p0, []
    for _ in range(periods):
        d = model.measure @ p @ _t(model.measure) + model.measure_noise
        inverse = np.linalg.inv(d)
        k = model.transition @ p @ _t(model.measure) @ inverse
        out.append((k, inverse, np.linalg.slogdet(d)[1]))
        m = model.transition - k @ model.measure
        p = model.transition @ p @ _t(m) + model.state_noise
        p = 0.5 * (p + _t(p))
    return out


def _apply(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """matrix @ vector for rows of vectors, with one matrix or one per row."""
    return np.matmul(matrix, vectors[..., None])[..., 0]


def filter_rows(model: StateSpace, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forecast errors [n, T, ny] and log likelihoods [n, T] of n rows of observations [n, T, ny]."""
    n, periods, ny = y.shape
    z = np.broadcast_to(model.z0, (n, model.z0.shape[-1]))
    errors, loglik = np.empty((n, periods, ny)), np.empty((n, periods))
    for t, (k, inverse, log_det) in enumerate(gains(model, periods)):
        e = y[:, t] - model.intercept - _apply(model.measure, z)
        quad = np.sum(e * _apply(inverse, e), axis=1)
        z = _apply(model.transition, z) + _apply(k, e)
        errors[:, t] = e
        loglik[:, t] = -0.5 * (ny * math.log(2.0 * math.pi) + log_det + quad)
    return errors, loglik


def period_log_likelihood(series: DataFrame, model: StateSpace, periods: int) -> DataFrame:
    """Kalman forecast errors and conditional log likelihoods, one row per (series, period).

    ``series`` holds one row per series: ``series`` (bigint) and ``y``, its
    periods x ny observations flattened in time order. Series filter together,
    an Arrow batch at a time, sharing the gain recursion.
    """
    ny = model.measure.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            y = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=float)
            y = y.reshape(n, periods, ny)
            errors, loglik = filter_rows(model, y)
            ends = pa.array(np.arange(0, (n * periods + 1) * ny, ny, dtype=np.int32))
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(keys, periods)),
                    pa.array(np.tile(np.arange(periods, dtype=np.int32), n)),
                    pa.array(loglik.ravel()),
                    pa.ListArray.from_arrays(ends, pa.array(errors.ravel())),
                ],
                names=["series", "t", "loglik", "error"],
            )

    schema = "series long, t int, loglik double, error array<double>"
    return spread(series.select("series", "y"), "series").mapInArrow(run, schema)


def log_likelihood(by_period: DataFrame, lags: int = 0) -> DataFrame:
    """Total over the periods after the first ``lags``."""
    return by_period.where(F.col("t") >= lags).groupBy("series").agg(F.sum("loglik").alias("loglik"))


def parameter_log_likelihood(
    params: DataFrame, build: Callable[[np.ndarray], StateSpace], panel: np.ndarray, lags: int = 0
) -> DataFrame:
    """Log likelihood of one panel at every parameter row: (id, loglik).

    ``params`` has id, data and valid; ``build`` turns parameter rows [n, d]
    into one model per row. Invalid rows cost nothing: they are impossible.
    The panel (periods x ny) is as long as the calendar, so it travels with
    the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ok = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=float)
            x = x.reshape(batch.num_rows, -1)[ok]
            out = np.full(batch.num_rows, NEG_INF)
            if ok.any():
                _, loglik = filter_rows(build(x), np.broadcast_to(panel, (len(x), *panel.shape)))
                out[ok] = np.nan_to_num(loglik[:, lags:].sum(axis=1), nan=NEG_INF, neginf=NEG_INF)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["id", "loglik"])

    slim = params.select(F.col("id").cast("long"), "data", F.coalesce("valid", F.lit(False)).alias("valid"))
    return spread(slim, "id").mapInArrow(run, "id long, loglik double")


def as_series(df: DataFrame, key: str, quarter: str, value: str, first: int, periods: int) -> DataFrame:
    """One row per key: (series, y), y running over the whole calendar with zeros where nothing happened."""
    entries = F.map_from_entries(F.collect_list(F.struct(F.col(quarter), F.col(value))))
    filled = F.transform(
        F.sequence(F.lit(first), F.lit(first + periods - 1)),
        lambda q: F.coalesce(F.element_at(F.col("_m"), q.cast("long")), F.lit(0.0)),
    )
    return df.groupBy(F.col(key).cast("long").alias("series")).agg(entries.alias("_m")).select("series", filled.alias("y"))


def base_regime_probability(probabilities: DataFrame, keys: list[str], base: list[str], p: str) -> DataFrame:
    """Marginal of a base regime variable: grand-regime probabilities summed."""
    return probabilities.groupBy(*keys, *base).agg(F.sum(p).alias("probability"))


def weighted_error(errors: DataFrame, keys: list[str], p: str, e: str) -> DataFrame:
    return errors.groupBy(*keys).agg(F.sum(F.col(p) * F.col(e)).alias("error"))
