"""Arithmetic on log values and log densities, as Column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tempera.schema import NEG_INF

HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)


def add_logs(y: Column, z: Column) -> Column:
    """ln(e**y + e**z) without overflow."""
    return F.greatest(y, z) + F.log1p(F.exp(-F.abs(y - z)))


def add_scaled_logs(a: Column, y: Column, b: Column, z: Column) -> Column:
    """ln(a e**y + b e**z) for a, b > 0."""
    top = F.greatest(y, z)
    return top + F.log(a * F.exp(y - top) + b * F.exp(z - top))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v
    )


def quadratic_form(x: Column, mu, precision) -> Column:
    """(x - mu)' A (x - mu) for a small constant matrix (or its diagonal)."""
    mu = np.asarray(mu, dtype=float)
    precision = np.asarray(precision, dtype=float)
    e = F.zip_with(x, vector_literal(mu), lambda v, m: v - m)
    if precision.ndim == 1:
        weighted = F.zip_with(e, vector_literal(precision), lambda v, p: v * v * p)
        return F.aggregate(weighted, F.lit(0.0), lambda acc, v: acc + v)
    rows = F.array(*[vector_literal(r) for r in precision])
    return dot(e, F.transform(rows, lambda r: dot(r, e)))


def vector_literal(v) -> Column:
    return F.array(*[F.lit(float(t)) for t in np.asarray(v).ravel()])


def half_log_det(precision) -> float:
    precision = np.asarray(precision, dtype=float)
    if precision.ndim == 1:
        return 0.5 * float(np.sum(np.log(np.abs(precision))))
    return 0.5 * float(np.linalg.slogdet(precision)[1])


def log_normal_kernel(x: Column, mu, precision) -> Column:
    return F.lit(-0.5) * quadratic_form(x, mu, precision)


def log_normal_density(x: Column, mu, precision) -> Column:
    constant = -HALF_LOG_2PI * len(np.atleast_1d(mu)) + half_log_det(precision)
    return F.lit(constant) + log_normal_kernel(x, mu, precision)


def chi2_cdf(x: float, dof: int) -> float:
    """Regularised lower incomplete gamma P(dof/2, x/2) by its power series."""
    a, z = dof / 2.0, x / 2.0
    if z <= 0.0:
        return 0.0
    term = total = 1.0 / a
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= z / (a + n)
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def truncated_normal_constant(precision, truncation: float) -> float:
    n = np.asarray(precision).shape[0]
    return -HALF_LOG_2PI * n + half_log_det(precision) - math.log(chi2_cdf(truncation, n))


def log_truncated_normal(x: Column, mu, precision, truncation: float) -> Column:
    """Normal restricted to the ellipsoid {v <= truncation}; outside it is impossible."""
    v = quadratic_form(x, mu, precision)
    constant = truncated_normal_constant(precision, truncation)
    return F.when(v > truncation, F.lit(NEG_INF)).otherwise(F.lit(constant) - 0.5 * v)


def log_normal_mixture(x: Column, log_weights, mus, precisions) -> Column:
    """ln of a mixture of normal kernels, each scaled by the root of its precision determinant."""
    terms = [
        F.lit(float(lw) + half_log_det(p)) + log_normal_kernel(x, m, p)
        for lw, m, p in zip(log_weights, mus, precisions)
    ]
    if len(terms) == 1:
        return terms[0]
    parts = F.array(*terms)
    top = F.array_max(parts)
    total = F.aggregate(F.transform(parts, lambda t: F.exp(t - top)), F.lit(0.0), lambda acc, v: acc + v)
    return top + F.log(total)


def splice(target: Column, target_from: int, source: Column, source_from: int, length: int) -> Column:
    """Copy ``length`` elements of ``source`` over those of ``target`` (0-based offsets)."""
    size = F.size(target)
    head = F.slice(target, 1, target_from) if target_from else F.array().cast("array<double>")
    tail_from = target_from + length
    tail = F.when(
        size > tail_from, F.slice(target, F.lit(tail_from + 1), F.greatest(size - tail_from, F.lit(0)))
    ).otherwise(F.array().cast("array<double>"))
    return F.concat(head, F.slice(source, source_from + 1, length), tail)
