"""Log-domain aggregation and the three marginal-likelihood estimators.

Draws are rows (src, ln_h, ln_k): the source ('proposal' or 'posterior'), the
log proposal density and the log posterior kernel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempera.operators.selection import kth_largest
from tempera.plans.staging import materialize
from tempera.schema import NEG_INF, POS_INF

_STEP = 64.0  # exponent range summed inside one bucket
BRIDGE_LIMIT = 1.0e50
BRIDGE_TOLERANCE = 1.0e-7


def log_sum_exp(df: DataFrame, by: list[str], value: Column, out: str = "lse") -> DataFrame:
    """ln(sum(exp(value))) and row count per group in a single pass.

    Values are summed inside exponent buckets of fixed width, which needs no
    prior maximum and combines map-side; only (groups x buckets) rows meet.
    """
    v = F.greatest(value, F.lit(NEG_INF))
    possible = v > NEG_INF / 10
    bucket = F.when(possible, F.floor(v / _STEP).cast("double"))
    parts = (
        df.select(*by, v.alias("_v"), bucket.alias("_bucket"))
        .groupBy(*by, "_bucket")
        .agg(F.sum(F.exp(F.col("_v") - F.col("_bucket") * _STEP)).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    )
    top = F.max("_bucket").over(Window.partitionBy(*by))
    scaled = parts.withColumn("_top", top).withColumn(
        "_scaled", F.col("_sum") * F.exp((F.col("_bucket") - F.col("_top")) * _STEP)
    )
    grouped = scaled.groupBy(*by).agg(
        F.max("_top").alias("_top"), F.sum("_scaled").alias("_scaled"), F.sum("_n").alias("n")
    )
    lse = F.when(F.col("_scaled") > 0, F.col("_top") * _STEP + F.log("_scaled")).otherwise(F.lit(NEG_INF))
    return grouped.select(*by, lse.alias(out), "n")


def harmonic_mean(draws: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Modified harmonic mean: ln T - ln sum(h / k)."""
    by = by or []
    total = log_sum_exp(draws, by, F.col("ln_h") - F.col("ln_k"))
    return total.select(*by, (F.log(F.col("n").cast("double")) - F.col("lse")).alias("log_mdd"), "n")


def region_cutoff(draws: DataFrame, tie: str) -> float:
    """Kernel cut-off: the smaller of the 30th best proposal and the top-decile posterior value."""
    proposal = draws.where(F.col("src") == "proposal")
    posterior = draws.where(F.col("src") == "posterior")
    m = posterior.count()
    if m < 10:
        raise ValueError("at least ten posterior draws are needed")
    return min(kth_largest(proposal, "ln_k", tie, 30), kth_largest(posterior, "ln_k", tie, m // 10))


def region_estimate(draws: DataFrame, min_kernel: float, max_proposal: float = POS_INF) -> DataFrame:
    """Evidence from the region S = {ln k >= min_kernel, ln h <= max_proposal}."""
    inside = (F.col("ln_k") >= min_kernel) & (F.col("ln_h") <= max_proposal)
    if min_kernel <= NEG_INF:
        inside = F.col("ln_h") <= max_proposal
    if max_proposal >= POS_INF:
        inside = F.lit(True) if min_kernel <= NEG_INF else F.col("ln_k") >= min_kernel
    parts = log_sum_exp(draws.withColumn("_in", inside), ["src", "_in"], F.col("ln_h") - F.col("ln_k"))

    def pick(src: str, want: Column, what: Column) -> Column:
        return F.when((F.col("src") == src) & want, what)

    yes, every = F.col("_in"), F.lit(True)
    agg = parts.agg(
        F.coalesce(F.sum(pick("proposal", yes, F.col("n"))), F.lit(0)).alias("in_proposal"),
        F.coalesce(F.sum(pick("posterior", yes, F.col("n"))), F.lit(0)).alias("in_posterior"),
        F.sum(pick("proposal", every, F.col("n"))).alias("n_proposal"),
        F.sum(pick("posterior", every, F.col("n"))).alias("n_posterior"),
        F.coalesce(F.max(pick("posterior", yes, F.col("lse"))), F.lit(NEG_INF)).alias("_lse"),
    )
    integral = F.col("_lse") - F.when(
        F.col("in_posterior") > 0, F.log(F.col("n_posterior").cast("double"))
    ).otherwise(F.lit(0.0))
    share = F.log(F.greatest(F.col("in_proposal"), F.lit(1)) / F.col("n_proposal"))
    log_mdd = F.when(F.col("in_proposal") > 0, share - integral).otherwise(F.lit(NEG_INF))
    return agg.select(log_mdd.alias("log_mdd"), "in_proposal", "in_posterior", integral.alias("log_integral"))


def _bridge_term(c: Column, rho: float) -> Column:
    """-ln(1 + rho e**c), written so that neither tail overflows."""
    return F.when(c < 0, -F.log(1.0 + rho * F.exp(c))).otherwise(-c - F.log(F.exp(-c) + rho))


def _bridge_term_scalar(c: float, rho: float) -> float:
    return -math.log(1.0 + rho * math.exp(c)) if c < 0 else -c - math.log(math.exp(-c) + rho)


class BridgeDraws:
    """Log ratios ln h - ln k written once; residuals at many trial values in one scan."""

    def __init__(self, draws: DataFrame):
        ratio = draws.select((F.col("src") == "proposal").alias("p"), (F.col("ln_h") - F.col("ln_k")).alias("d"))
        self.table = materialize(ratio, "bridge")
        r = {
            row["p"]: row
            for row in self.table.groupBy("p")
            .agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
            .collect()
        }
        self.rho_proposal = r[True]["n"] / r[False]["n"]
        self.rho_posterior = r[False]["n"] / r[True]["n"]
        self._low_proposal, self._high_posterior = r[True]["lo"], r[False]["hi"]

    def residual(self, trials: list[float]) -> list[float]:
        """LSE over proposal draws minus LSE over posterior draws, per trial log evidence.

        The term falls monotonically in its argument, so the extreme ratios
        give each sum's exact maximum and hence a safe shift.
        """
        lanes, shifts = [], []
        for r in trials:
            top_p = _bridge_term_scalar(self._low_proposal + r, self.rho_proposal)
            top_q = _bridge_term_scalar(-self._high_posterior - r, self.rho_posterior)
            lanes.append(F.struct(F.lit(float(r)).alias("r"), F.lit(top_p).alias("tp"), F.lit(top_q).alias("tq")))
            shifts.append((top_p, top_q))
        # Trials ride along as a constant array, so every call runs the same compiled plan.
        each = self.table.select("p", "d", F.posexplode(F.array(*lanes)).alias("i", "t"))
        r, d = F.col("t.r"), F.col("d")
        up = F.exp(_bridge_term(d + r, self.rho_proposal) - F.col("t.tp"))
        down = F.exp(_bridge_term(-d - r, self.rho_posterior) - F.col("t.tq"))
        sums = each.groupBy("i", "p").agg(F.sum(F.when(F.col("p"), up).otherwise(down)).alias("s")).collect()
        s = {(row["i"], row["p"]): row["s"] for row in sums}
        return [
            tp + math.log(s[i, True]) - tq - math.log(s[i, False]) for i, (tp, tq) in enumerate(shifts)
        ]

    def root(self, tolerance: float = BRIDGE_TOLERANCE, max_rounds: int = 50) -> float:
        """Trial value with zero residual.

        Decades bracket the sign change; then each scan tries the midpoint and
        points close around the interpolated root, which mostly cuts the
        bracket a thousandfold.
        """
        decades = [10.0**e for e in range(51)]
        at_zero = self.residual([0.0])[0]
        sign = -1.0 if at_zero < 0 else 1.0
        inner, outer = (0.0, at_zero), None
        for first in range(0, 51, 17):
            tried = [sign * v for v in decades[first : first + 17]]
            for point in zip(tried, self.residual(tried)):
                if sign * point[1] < 0:
                    outer = point
                    break
                inner = point
            if outer:
                break
        if outer is None:
            return sign * BRIDGE_LIMIT
        (low, f_low), (high, f_high) = sorted((inner, outer))
        best, miss = min((inner, outer), key=lambda t: abs(t[1]))
        for _ in range(max_rounds):
            width = high - low
            if abs(miss) < tolerance or width <= 1e-15 * max(1.0, abs(best)):
                break
            guess = low + width * f_low / (f_low - f_high)
            grid = [0.5 * (low + high), guess]
            grid += [guess + side * width * share for side in (-1, 1) for share in (0.05, 0.0005)]
            grid = sorted({g for g in grid if low < g < high})
            points = list(zip(grid, self.residual(grid)))
            best, miss = min([(best, miss), *points], key=lambda t: abs(t[1]))
            for g, v in points:
                if v > 0:
                    low, f_low = g, v
            for g, v in reversed(points):
                if v <= 0 and g > low:
                    high, f_high = g, v
        return best
