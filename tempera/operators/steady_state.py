"""Steady-state values as a graph of named formulas.

A formula names what it needs by its arguments. A variant says which quantities are given; the rest follow in the
order of a topological sort, which also finds quantities that nothing gives and formulas that need each other.
``with_steady_state`` adds one projection per depth of the graph, so that a value used often is computed once.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Formula = Callable[..., Column]


def _capital_yield(land_e, ky, theta, delta, lambda_K):
    return land_e * (1.0 - theta) + ky * (1.0 - delta - theta) / lambda_K


def _discount_factor(land_e, ky, alpha, lambda_star, lambda_K, theta, R, capital_yield):
    secured = lambda_star * theta / R
    return (land_e * (1.0 - secured) + ky * (1.0 - secured / lambda_K)) / (alpha + capital_yield)


def _capital_share(land_e, ky, beta, lambda_a, theta, delta, lambda_K):
    pledge = beta * lambda_a * theta
    return ((1.0 - beta - pledge) * land_e + (1.0 - (pledge + beta * (1.0 - delta)) / lambda_K) * ky) / beta


def _housing_weight(land_h, C_h, lambda_star, gamma_h, R):
    return (land_h / C_h) * lambda_star * (1.0 - lambda_star / R) * (1.0 - gamma_h / R) / (lambda_star - gamma_h)


# ---- Fixed values: the model's steady-state identities, shared by all variants -----------------------
SHARED: dict[str, Formula] = {
    "lambda_K": lambda lambda_q, lambda_star: lambda_q * lambda_star,
    "assets": lambda lambda_star, lambda_q, land_e, ky: lambda_star * land_e + ky / lambda_q,
    "delta": lambda ik, lambda_K: 1.0 - (1.0 - ik) * lambda_K,
    "iy": lambda ik, ky: ik * ky,
    "capital_yield": _capital_yield,
    "lambda_a": lambda lambda_star, beta, R: lambda_star / (beta * R) - 1.0,
    "phi": lambda land_e, beta, lambda_a, theta, alpha: land_e * (1.0 - beta * (1.0 + lambda_a * theta)) / (beta * alpha),
    "lambda_z": lambda lambda_star, lambda_q, phi, alpha: (
        F.pow(lambda_star, 1.0 - (1.0 - phi) * alpha) * F.pow(lambda_q, -(1.0 - phi) * alpha)
    ),
    "housing_weight": _housing_weight,
    "mu_b_e": lambda beta, lambda_a, lambda_star: beta * lambda_a / lambda_star,
    "land_to_debt": lambda land_e, by: land_e / by,
    "land_ratio": lambda land_h, land_e: land_h / land_e,
    "L_e": lambda land_ratio: 1.0 / (1.0 + land_ratio),
    "L_h": lambda L_e: 1.0 - L_e,
    "Omega_h": lambda lambda_star, beta, lambda_a, gamma_h: (lambda_star - beta * (1.0 + lambda_a) * gamma_h) * (lambda_star - gamma_h),
    "Omega_e": lambda lambda_star, beta, gamma_e: (lambda_star - beta * gamma_e) * (lambda_star - gamma_e),
    "excess_return": lambda lambda_star, lambda_a, beta: lambda_star * lambda_a / (beta * (1.0 + lambda_a)),
}
_THETA = {"theta": lambda by, assets: by / assets}
_HOUSEHOLD = {
    "C_h": lambda alpha, lambda_star, R, by: 1.0 - alpha + (1.0 / lambda_star - 1.0 / R) * by,
    "C_e": lambda C_h, iy: 1.0 - C_h - iy,
}
#: What follows differently where other quantities are given.
VARIANTS: dict[str, dict[str, Formula]] = {
    "given_beta": SHARED | _THETA | {
        "alpha": _capital_share,
        "C_e": lambda alpha, iy, by, beta, lambda_a, lambda_star: alpha - iy - by * (1.0 - beta * (1.0 + lambda_a)) / lambda_star,
        "C_h": lambda C_e, iy: 1.0 - C_e - iy,
    },
    "given_debt": SHARED | _THETA | _HOUSEHOLD | {"beta": _discount_factor},
    "free_beta": SHARED | _THETA | _HOUSEHOLD,
    "given_collateral": SHARED | _HOUSEHOLD | {"by": lambda theta, assets: theta * assets, "beta": _discount_factor},
}


def variant_of(code: int) -> str:
    """Restriction codes up to 2 take the discount factor as given, 6 takes it as free, those from 100 fix the collateral share."""
    return "given_beta" if code <= 2 else "free_beta" if code == 6 else "given_collateral" if code >= 100 else "given_debt"


def needs(formula: Formula) -> tuple[str, ...]:
    return tuple(inspect.signature(formula).parameters)


def layers(formulas: dict[str, Formula], given: Iterable[str], wanted: Iterable[str] | None = None) -> list[list[str]]:
    """Quantities to compute, in layers of which each needs only given ones and earlier layers.

    A formula's quantity is never taken from ``given``. Raises for a quantity that is neither given nor has a formula, and
    for formulas that need each other.
    """
    given, graph, open_names = set(given) - set(formulas), {}, list(formulas if wanted is None else wanted)
    while open_names:
        name = open_names.pop()
        if name in graph or name in given:
            continue
        if name not in formulas:
            raise KeyError(f"{name} is neither given nor derived")
        graph[name] = needs(formulas[name])
        open_names += graph[name]
    order, out = TopologicalSorter(graph), []
    try:
        order.prepare()
    except CycleError as e:
        raise ValueError(f"formulas need each other: {' -> '.join(e.args[1])}") from e
    while order.is_active():
        ready = sorted(order.get_ready())
        order.done(*ready)
        found = [n for n in ready if n in graph]
        out += [found] if found else []
    return out


def solve(given: dict[str, Column], formulas: dict[str, Formula], wanted: Iterable[str] | None = None) -> dict[str, Column]:
    """Given and derived quantities as Columns over the same row."""
    known = {k: v for k, v in given.items() if k not in formulas}
    for layer in layers(formulas, known, wanted):
        known |= {n: formulas[n](*(known[a] for a in needs(formulas[n]))) for n in layer}
    return known


def with_steady_state(
    df: DataFrame, given: dict[str, Column], variant: str, wanted: Iterable[str] | None = None, prefix: str = "ss_"
) -> DataFrame:
    """Add all quantities of a variant (or the wanted ones, and what they need) as columns with a prefix."""
    formulas = VARIANTS[variant]
    inputs = {k: v for k, v in given.items() if k not in formulas}
    df = df.withColumns({prefix + k: v for k, v in inputs.items()})
    for layer in layers(formulas, inputs, wanted):
        df = df.withColumns({prefix + n: formulas[n](*(F.col(prefix + a) for a in needs(formulas[n]))) for n in layer})
    return df
