"""Structural parameters, their restrictions and the prior, over rows of free parameters.

A row's ``data`` holds the free vector: the deep parameters of the chosen
restriction code, then shock persistences, then shock standard deviations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempera.functions import counter_rng
from tempera.operators.steady_state import VARIANTS, solve, variant_of
from tempera.plans.sizing import spread
from tempera.schema import NEG_INF

# ---- Fixed values: deep parameters in order, per restriction code -------------------------
DEEP = {
    0: ["beta", "lambda_q", "lambda_star", "gamma_h", "gamma_e", "eta", "Omega"],
    1: ["beta", "lambda_q", "gamma_h", "gamma_e", "Omega"],
    2: ["lambda_q", "lambda_star", "gamma_h", "gamma_e", "eta", "Omega"],
    3: ["lambda_q", "lambda_star", "gamma_h", "gamma_e", "Omega"],
    4: ["lambda_q", "gamma_h", "gamma_e", "Omega"],
    5: ["lambda_q", "lambda_star", "gamma_h", "gamma_e", "Omega", "R"],
    207: ["gamma_h", "gamma_e", "Omega"],
}
SAME_AS = {103: 3, 203: 3, 105: 5, 205: 5}
PERSISTENCES = ["lambda_a", "lambda_z", "nu_z", "lambda_q", "nu_q", "varphi", "psi", "theta"]

# ---- Fixed values: prior family and hyper-parameters ---------------------------------------
PRIOR = {
    "beta": ("gamma", 1.5832, 1.0126),
    "lambda_q": ("gamma", 1.8611, 3.0112),
    "lambda_star": ("gamma", 1.8611, 3.0112),
    "gamma_h": ("beta", 1.0, 2.0),
    "gamma_e": ("beta", 1.0, 2.0),
    "eta": ("gamma", 1.0, 1.0),
    "Omega": ("gamma", 1.0, 0.5),
    "R": ("gamma", 0.7371, 0.3078),
}
PRIOR_PERSISTENCE = ("beta", 1.0, 2.0)
PRIOR_DEVIATION = ("inverse_gamma", 3.260961642159758e-01, 1.451789062500018e-04)

# ---- Fixed values: calibrated steady-state ratios -------------------------------------------
CALIBRATION = {
    "R": 1.01, "by": 5.38, "ky": 4.6194, "ik": 0.0523, "land_e": 2.60, "land_h": 5.8011,
    "lambda_q": 1.01375, "lambda_star": 1.00375, "beta": 0.98, "eta": 0.0, "alpha": 0.3, "theta": 0.75,
}
RATE_PARAMETERS = {"lambda_q", "lambda_star", "R"}  # stored as percentage points over one
# ---- Fixed values: section names of the calibrated values in parameter files --------------------
SECTIONS = {
    "R": "R", "by": "by", "ky": "ky", "ik": "ik", "land_e": "qlLeOY", "land_h": "qlLhOY", "lambda_q": "glambdaq",
    "lambda_star": "glambdastar", "beta": "gbeta", "eta": "geta", "alpha": "galpha", "theta": "gtheta",
}
#: Steady-state values that come with an evaluated row.
VALUES = ("by", "theta", "lambda_K", "delta", "iy", "lambda_a", "alpha", "C_e", "C_h", "beta", "phi", "lambda_z")
EPSILON = math.sqrt(2.220446049250313e-16)


def deep_names(code: int) -> list[str]:
    return DEEP[SAME_AS.get(code, code)]


def n_free(code: int) -> int:
    shocks = len(PERSISTENCES) + (1 if 100 <= code < 200 else 0)
    return len(deep_names(code)) + 2 * shocks


def calibration_from(sections: DataFrame) -> dict[str, float]:
    """Calibrated values found in a parsed parameter file, defaults for the rest."""
    rows = sections.where((F.col("ordinal") == 0) & F.col("section").isin(list(SECTIONS.values()))).collect()
    found = {r["section"]: r["value"] for r in rows}
    return {k: found.get(SECTIONS[k], v) for k, v in CALIBRATION.items()}


def structural(x: Column, code: int, calibration: dict[str, float] = CALIBRATION) -> dict[str, Column]:
    """Free vector to structural parameters; the rest keep their calibrated value."""
    out = {k: F.lit(v) for k, v in calibration.items()}
    for i, name in enumerate(deep_names(code)):
        v = F.element_at(x, i + 1)
        if name == "beta":
            v = 1.0 / (1.0 + 0.01 * v)
        elif name in RATE_PARAMETERS:
            v = 1.0 + 0.01 * v
        out[name] = v
    return out


def derived(p: dict[str, Column], code: int = 203) -> dict[str, Column]:
    """Structural parameters with the steady state that follows from them under a restriction code."""
    return p | solve(p, VARIANTS[variant_of(code)], VALUES)


def valid(x: Column, code: int, d: dict[str, Column]) -> Column:
    """Sign and range restrictions on the free vector and on the steady state."""
    names = deep_names(code)
    ok = F.lit(True)
    for i, name in enumerate(names):
        v = F.element_at(x, i + 1)
        if name in ("gamma_h", "gamma_e"):
            ok = ok & (v >= 0.0) & (v < 1.0)
        elif name in ("eta", "Omega"):
            ok = ok & (v >= 0.0)
        else:
            ok = ok & (v > 0.0)
    shocks = (n_free(code) - len(names)) // 2
    rest = F.slice(x, len(names) + 1, shocks)
    deviations = F.slice(x, len(names) + 1 + shocks, shocks)
    ok = ok & F.forall(rest, lambda v: v >= 0.0) & F.forall(deviations, lambda v: v > 0.0)
    ok = ok & (d["lambda_star"] < d["R"] - EPSILON)
    ok = ok & (d["theta"] < (1.0 - d["beta"]) / (d["beta"] * d["lambda_a"]) - EPSILON)
    return ok & (d["lambda_z"] >= EPSILON)


def log_pdf(family: str, x: Column, a: float, b: float) -> Column:
    """Gamma(shape, rate), Beta(a, b) or inverse Gamma(shape, scale) log density."""
    if family == "beta":
        constant = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        return F.lit(constant) + (a - 1.0) * F.log(x) + (b - 1.0) * F.log(1.0 - x)
    constant = a * math.log(b) - math.lgamma(a)
    if family == "gamma":
        return F.lit(constant) + (a - 1.0) * F.log(x) - b * x
    return F.lit(constant) - (a + 1.0) * F.log(x) - b / x


def _families(code: int) -> list[tuple[str, float, float]]:
    names = deep_names(code)
    shocks = (n_free(code) - len(names)) // 2
    return [PRIOR[n] for n in names] + [PRIOR_PERSISTENCE] * shocks + [PRIOR_DEVIATION] * shocks


def log_prior(x: Column, code: int) -> Column:
    total = F.lit(0.0)
    for i, (family, a, b) in enumerate(_families(code)):
        total = total + log_pdf(family, F.element_at(x, i + 1), a, b)
    return total


def evaluate(
    params: DataFrame, code: int = 203, vector: str = "data", calibration: dict[str, float] = CALIBRATION
) -> DataFrame:
    """Structural and derived values, validity and log prior (impossible when invalid)."""
    x = F.col(vector)
    d = derived(structural(x, code, calibration), code)
    keep = [
        "lambda_q", "lambda_star", "R", "beta", "alpha", "theta", "lambda_a", "phi", "lambda_z", "C_h", "C_e", "by", "delta",
    ]
    wide = params.select("*", *[d[k].alias(k) for k in keep])
    seen = {k: F.col(k) for k in keep}
    wide = wide.withColumn("valid", F.coalesce(valid(x, code, seen), F.lit(False)))
    return wide.withColumn("log_prior", F.when(F.col("valid"), log_prior(x, code)).otherwise(F.lit(NEG_INF)))


def log_posterior(priors: DataFrame, likelihoods: DataFrame, log_scale: float = 0.0) -> DataFrame:
    """(id, log_posterior): likelihood plus prior plus the normaliser's scale; impossible if either part is, or is missing.

    ``priors`` is (id, valid, log_prior), ``likelihoods`` is (id, loglik).
    """
    both = priors.select("id", "valid", "log_prior").join(likelihoods.select("id", "loglik"), "id", "full")
    possible = F.col("valid") & (F.col("loglik") > NEG_INF / 10)
    total = F.col("loglik") + F.col("log_prior") + F.lit(float(log_scale))
    return both.select("id", F.when(possible, total).otherwise(F.lit(NEG_INF)).alias("log_posterior"))


def _gamma_draws(shape: float, keys: np.ndarray, lane: int, seed: int) -> np.ndarray:
    """Unit-rate Gamma variates by squeeze rejection, retrying only the rejected keys."""
    boost = shape < 1.0
    d = (shape + 1.0 if boost else shape) - 1.0 / 3.0
    c = 1.0 / math.sqrt(9.0 * d)
    out = np.zeros(len(keys))
    todo = np.arange(len(keys))
    attempt = 0
    while len(todo):
        counter = (lane << 20) + attempt
        z = counter_rng.normal(keys[todo], counter, seed)
        u = counter_rng.uniform(keys[todo], counter + counter_rng.purpose(1), seed)
        v = (1.0 + c * z) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            ok = (v > 0) & (np.log(u) < 0.5 * z * z + d - d * v + d * np.log(v))
        out[todo[ok]] = d * v[ok]
        todo = todo[~ok]
        attempt += 1
    if boost:
        out *= counter_rng.uniform(keys, lane + counter_rng.purpose(2), seed) ** (1.0 / shape)
    return out


def draw_from_prior(keys: DataFrame, key: str, code: int = 203, seed: int = 7) -> DataFrame:
    """One prior draw of the free vector per row, keyed by the row's id."""
    families = _families(code)

    def one(lane: int, family: str, a: float, b: float, k: np.ndarray) -> np.ndarray:
        if family == "gamma":
            return _gamma_draws(a, k, lane, seed) / b
        if family == "inverse_gamma":
            return b / np.maximum(_gamma_draws(a, k, lane, seed), 1e-300)
        x = _gamma_draws(a, k, 2 * lane + 100, seed)
        return x / (x + _gamma_draws(b, k, 2 * lane + 101, seed))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            k = pdf["id"].to_numpy(dtype=np.int64)
            columns = [one(lane, *family, k) for lane, family in enumerate(families)]
            yield pd.DataFrame({"id": k, "data": list(np.stack(columns, axis=1))})

    ids = keys.select(F.col(key).cast("long").alias("id"))
    return spread(ids, "id").mapInPandas(run, "id long, data array<double>")


def prior_scale(draws: DataFrame, code: int = 203) -> DataFrame:
    """Log normaliser of the restricted prior: -ln(share of valid draws)."""
    share = F.avg(F.col("valid").cast("double"))
    return evaluate(draws, code).agg(
        (-F.log(share)).alias("log_scale"), F.count(F.lit(1)).alias("draws"),
        F.sum((~F.col("valid")).cast("long")).alias("rejected"),
    )
