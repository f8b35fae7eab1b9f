"""Time-series preparation, likelihoods, regimes and the prior."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempera.catalog.registry import query, rounded, table
from tempera.operators import prior, target, timeseries
from tempera.operators.prior import CALIBRATION as CAL
from tempera.operators.steady_state import VARIANTS, with_steady_state
from tempera.plans.adapters import quarterly_orders, vector_samples
from tempera.schema import NEG_INF

QUARTER = "year(o_orderdate) + (quarter(o_orderdate) - 1) / 4.0::DOUBLE"


@query(
    "quarter_calendar",
    f"""WITH e AS (SELECT CAST(min({QUARTER}) * 4 AS BIGINT) AS a, CAST(max({QUARTER}) * 4 AS BIGINT) AS z FROM orders)
    SELECT q - a AS pos, q / 4.0::DOUBLE AS dt FROM (SELECT a, unnest(range(a, z + 1)) AS q FROM e)""",
)
def quarter_calendar(spark, sf_dir):
    return timeseries.quarter_calendar(table(spark, sf_dir, "orders").select("o_orderdate"), "o_orderdate")


@query(
    "quarter_volume",
    f"""SELECT {QUARTER} AS dt, o_orderpriority AS var, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2""",
)
def quarter_volume(spark, sf_dir):
    out = quarterly_orders(spark, sf_dir, "o_orderpriority")
    return out.select("dt", F.col("key").alias("var"), rounded("value", 2).alias("value"))


@query(
    "log_difference",
    f"""WITH q AS (SELECT {QUARTER} AS dt, o_orderpriority AS var, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
    d AS (SELECT dt, var, ln(v) - lag(ln(v)) OVER (PARTITION BY var ORDER BY dt) AS dlog FROM q)
    SELECT dt, var, round(dlog, 9) AS dlog FROM d WHERE dlog IS NOT NULL""",
)
def log_difference(spark, sf_dir):
    panel = quarterly_orders(spark, sf_dir, "o_orderpriority").withColumnRenamed("key", "var")
    return timeseries.log_difference(panel, ["var"], "value").select("dt", "var", rounded("dlog", 9).alias("dlog"))


@query(
    "sample_window",
    f"""WITH q AS (SELECT {QUARTER} AS dt,
        sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS urgent,
        sum(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END) AS low FROM orders GROUP BY 1)
    SELECT dt, 'low' AS var, round(low, 2) AS value FROM q WHERE dt BETWEEN 1996.25 AND 2000.75
    UNION ALL SELECT dt, 'urgent', round(urgent, 2) FROM q WHERE dt BETWEEN 1996.25 AND 2000.75""",
)
def sample_window(spark, sf_dir):
    """Two selected series inside a sample window, back in long form."""
    long = quarterly_orders(spark, sf_dir, "o_orderpriority").withColumnRenamed("key", "var")
    wide = timeseries.to_wide(long, ["1-URGENT", "2-HIGH", "5-LOW"])
    wide = wide.withColumnsRenamed({"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"})
    inside = timeseries.sample_window(wide, 1996.25, 2000.75, ["urgent", "low"])
    return timeseries.to_long(inside, ["urgent", "low"]).select("dt", "var", rounded("value", 2).alias("value"))


LEVEL_VAR, NOISE_VAR, START_VAR, LAGS = 0.3, 1.1, 10.0, 3

_SERIES = f"""b AS (SELECT CAST(min({QUARTER}) * 4 AS BIGINT) AS a, CAST(max({QUARTER}) * 4 AS BIGINT) AS z FROM orders),
    q AS (SELECT o_custkey AS series, CAST(({QUARTER}) * 4 AS BIGINT) AS q, ln(1 + sum(o_totalprice) / 10000.0::DOUBLE) AS y FROM orders GROUP BY 1, 2),
    c AS (SELECT DISTINCT series FROM q),
    o AS (SELECT c.series, g.q - b.a AS t, coalesce(q.y, 0.0::DOUBLE) AS y
          FROM c CROSS JOIN b CROSS JOIN (SELECT unnest(range(a, z + 1)) AS q FROM b) g LEFT JOIN q ON q.series = c.series AND q.q = g.q),
    f(series, t, z, p, ll, e) AS (
      SELECT series, -1::BIGINT, 0.0::DOUBLE, {START_VAR}::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM c
      UNION ALL
      SELECT f.series, f.t + 1, f.z + f.p / (f.p + {NOISE_VAR}) * (o.y - f.z),
             f.p - f.p * f.p / (f.p + {NOISE_VAR}) + {LEVEL_VAR},
             -0.5 * ({math.log(2 * math.pi)!r}::DOUBLE + ln(f.p + {NOISE_VAR}) + (o.y - f.z) * (o.y - f.z) / (f.p + {NOISE_VAR})), o.y - f.z
      FROM f JOIN o ON o.series = f.series AND o.t = f.t + 1)"""


def _customer_likelihood(spark, sf_dir):
    """Local-level filter over every customer's quarterly log order volume."""
    volume = quarterly_orders(spark, sf_dir, "o_custkey").select(
        "key", timeseries.quarter_number(F.col("dt")).alias("q"), F.log1p(F.col("value") / 10000.0).alias("y")
    )
    ends = table(spark, sf_dir, "orders").agg(
        F.min(timeseries.quarter_number(timeseries.quarter_of(F.col("o_orderdate")))).alias("a"),
        F.max(timeseries.quarter_number(timeseries.quarter_of(F.col("o_orderdate")))).alias("z"),
    ).first()
    periods = ends["z"] - ends["a"] + 1
    series = timeseries.as_series(volume, "key", "q", "y", ends["a"], periods)
    model = timeseries.StateSpace.local_level(LEVEL_VAR, NOISE_VAR, START_VAR)
    return timeseries.period_log_likelihood(series, model, periods)


@query(
    "period_log_likelihood",
    f"""WITH RECURSIVE {_SERIES} SELECT series, t, round(ll, 6) AS loglik, round(e, 6) AS error FROM f WHERE t >= 0""",
)
def period_log_likelihood(spark, sf_dir):
    return _customer_likelihood(spark, sf_dir).select(
        "series", F.col("t").cast("long"), rounded("loglik").alias("loglik"), rounded(F.col("error")[0]).alias("error")
    )


@query(
    "log_likelihood",
    f"""WITH RECURSIVE {_SERIES} SELECT series, round(sum(ll), 6) AS loglik FROM f WHERE t >= {LAGS} GROUP BY series""",
)
def log_likelihood(spark, sf_dir):
    """Per customer, summed over the periods after the lags."""
    total = timeseries.log_likelihood(_customer_likelihood(spark, sf_dir), LAGS)
    return total.select("series", rounded("loglik").alias("loglik"))


_SHARES = """q AS (SELECT year(l_shipdate) + (quarter(l_shipdate) - 1) / 4.0::DOUBLE AS dt, l_returnflag AS r, l_linestatus AS s,
      sum(l_quantity) AS w, avg(l_extendedprice) / 10000 - 3 AS e FROM lineitem GROUP BY 1, 2, 3),
    p AS (SELECT q.*, w / sum(w) OVER (PARTITION BY dt) AS p FROM q)"""


def _regimes(spark, sf_dir):
    from pyspark.sql import Window

    parts = table(spark, sf_dir, "lineitem").groupBy(
        timeseries.quarter_of(F.col("l_shipdate")).alias("dt"), F.col("l_returnflag").alias("r"), F.col("l_linestatus").alias("s")
    ).agg(F.sum("l_quantity").alias("w"), (F.avg("l_extendedprice") / 10000 - 3).alias("e"))
    return parts.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("dt")))


@query(
    "regime_marginal",
    f"""WITH {_SHARES} SELECT dt, r AS regime, round(sum(p), 9) AS probability FROM p GROUP BY dt, r""",
)
def regime_marginal(spark, sf_dir):
    """Base-regime probabilities from those of the (flag, status) grand regimes."""
    out = timeseries.base_regime_probability(_regimes(spark, sf_dir), ["dt"], ["r"], "p")
    return out.select("dt", F.col("r").alias("regime"), rounded("probability", 9).alias("probability"))


@query(
    "weighted_forecast_error",
    f"""WITH {_SHARES} SELECT dt, round(sum(p * e), 9) AS error FROM p GROUP BY dt""",
)
def weighted_forecast_error(spark, sf_dir):
    out = timeseries.weighted_error(_regimes(spark, sf_dir), ["dt"], "p", "e")
    return out.select("dt", rounded("error", 9).alias("error"))


# ---- prior over parameter rows made from embeddings --------------------------------------------
CODE = 203


def parameter_rows(spark, sf_dir):
    """21 free parameters per embedding, moved into the range the model knows."""
    e = F.transform(F.slice("embedding", 1, prior.n_free(CODE)), lambda v: v.cast("double"))
    shift = F.transform(
        e, lambda v, i: F.when(i < 2, 0.5 + v).when(i < 4, 0.3 + v).when(i < 13, 0.4 + v).otherwise(0.1 + F.abs(v))
    )
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), shift.alias("data"))


_PARAMS = f"""e AS (SELECT vec_id AS id, list_transform(range(1, {prior.n_free(CODE) + 1}),
      lambda i: CASE WHEN i <= 2 THEN 0.5::DOUBLE + embedding[i]::DOUBLE WHEN i <= 4 THEN 0.3::DOUBLE + embedding[i]::DOUBLE
               WHEN i <= 13 THEN 0.4::DOUBLE + embedding[i]::DOUBLE ELSE 0.1::DOUBLE + abs(embedding[i]::DOUBLE) END) AS x FROM embeddings),
    a AS (SELECT *, 1 + 0.01 * x[1] AS lq, 1 + 0.01 * x[2] AS ls, {CAL['R']} AS r, {CAL['theta']} AS th FROM e),
    b AS (SELECT *, lq * ls AS lk, th * (ls * {CAL['land_e']} + {CAL['ky']} / lq) AS bal, 1 - (1 - {CAL['ik']}) * (lq * ls) AS delta FROM a),
    c AS (SELECT *, 1 - {CAL['alpha']} + (1 / ls - 1 / r) * bal AS ch,
            ({CAL['land_e']} * (1 - ls * th / r) + {CAL['ky']} * (1 - ls * th / (lk * r)))
            / ({CAL['alpha']} + {CAL['land_e']} * (1 - th) + {CAL['ky']} * (1 - delta - th) / lk) AS beta FROM b),
    d AS (SELECT *, 1 - ch - {CAL['ik']} * {CAL['ky']} AS ce, ls / (beta * r) - 1 AS la FROM c),
    g AS (SELECT *, {CAL['land_e']} * (1 - beta * (1 + la * th)) / (beta * {CAL['alpha']}) AS phi FROM d),
    h AS (SELECT *, pow(ls, 1 - (1 - phi) * {CAL['alpha']}) * pow(lq, -(1 - phi) * {CAL['alpha']}) AS lz FROM g),
    v AS (SELECT *, coalesce(x[1] > 0 AND x[2] > 0 AND x[3] >= 0 AND x[3] < 1 AND x[4] >= 0 AND x[4] < 1 AND x[5] >= 0
            AND list_min(x[6:13]) >= 0 AND list_min(x[14:21]) > 0 AND ls < r - 1.4901161193847656e-08
            AND th < (1 - beta) / (beta * la) - 1.4901161193847656e-08 AND lz >= 1.4901161193847656e-08, FALSE) AS valid FROM h)"""

NOISE_STATES, NOISE_SHOCKS, NOISE_TOTAL = 6, 8, 8


@query(
    "state_noise",
    f"""WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
    b AS (SELECT id, list_transform(range(48), lambda i: x[i + 1] * (0.1::DOUBLE + abs(x[49 + i % {NOISE_SHOCKS}]))) AS b FROM e)
    SELECT id, i, j, CASE WHEN i < {NOISE_STATES} AND j < {NOISE_STATES} THEN
        round(list_sum(list_transform(range({NOISE_SHOCKS}), lambda k: b[i * {NOISE_SHOCKS} + k + 1] * b[j * {NOISE_SHOCKS} + k + 1])), 9) ELSE 0 END AS v
    FROM b, range({NOISE_TOTAL}) s(i), range({NOISE_TOTAL}) t(j)""",
)
def state_noise(spark, sf_dir):
    """State noise of every embedding taken as impacts of eight shocks on six states and their sizes; two lagged states have none."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    rows = v.select(
        F.col("vec_id").alias("id"), F.slice("x", 1, NOISE_STATES * NOISE_SHOCKS).alias("impact"),
        F.transform(F.slice("x", 49, NOISE_SHOCKS), lambda s: 0.1 + F.abs(s)).alias("sigma"),
    )
    cells = timeseries.state_noise(rows, NOISE_STATES, NOISE_SHOCKS, NOISE_TOTAL).select("id", F.posexplode("noise").alias("cell", "v"))
    return cells.select(
        "id", F.floor(F.col("cell") / NOISE_TOTAL).alias("i"), (F.col("cell") % NOISE_TOTAL).cast("long").alias("j"), rounded("v", 9).alias("v")
    )


#: Values of every variant, as they are named in the result.
STEADY = (
    "beta", "theta", "by", "alpha", "lambda_K", "delta", "iy", "lambda_a", "phi", "lambda_z", "C_h", "C_e", "housing_weight", "mu_b_e",
    "land_to_debt", "land_ratio", "L_e", "L_h", "Omega_h", "Omega_e", "excess_return",
)


def _steady_sql() -> str:
    """The four variants written out, one after the other."""
    land, house, ky, ik, r = CAL["land_e"], CAL["land_h"], CAL["ky"], CAL["ik"], CAL["R"]
    start = f"""SELECT id, 1 + 0.01 * x[1] AS lq, 1 + 0.01 * x[2] AS ls, x[3] AS gh, x[4] AS ge, 1 / (1 + 0.01 * x[5]) AS b0 FROM e"""
    loan = f"{CAL['by']} / (ls * {land} + {ky} / lq)"
    household = f"1 - {CAL['alpha']} + (1 / ls - 1 / {r}) * by_"
    discount = f"""({land} * (1 - ls * th / {r}) + {ky} * (1 - ls * th / (lk * {r})))
        / ({CAL['alpha']} + {land} * (1 - th) + {ky} * (1 - delta - th) / lk)"""
    income = f"""((1 - b0 - b0 * (ls / (b0 * {r}) - 1) * th) * {land}
        + (1 - b0 * (ls / (b0 * {r}) - 1) * th / lk - b0 * (1 - delta) / lk) * {ky}) / b0"""
    parts = {
        "given_beta": (loan, f"{CAL['by']}", income, "b0"),
        "given_debt": (loan, f"{CAL['by']}", f"{CAL['alpha']}", discount),
        "free_beta": (loan, f"{CAL['by']}", f"{CAL['alpha']}", "b0"),
        "given_collateral": (f"{CAL['theta']}", f"{CAL['theta']} * (ls * {land} + {ky} / lq)", f"{CAL['alpha']}", discount),
    }
    variants = " UNION ALL ".join(
        f"""SELECT id, '{name}' AS variant, lq, ls, gh, ge, th, by_, lk, delta, {share} AS al, {beta} AS be
        FROM (SELECT *, {theta} AS th, {debt} AS by_ FROM g0)""" for name, (theta, debt, share, beta) in parts.items()
    )
    own = f"al - {ik} * {ky} - by_ * (1 - be * (1 + la)) / ls"
    return f"""WITH {_PARAMS.split('a AS (SELECT')[0].rstrip().rstrip(',')},
    g AS ({start}), g0 AS (SELECT *, lq * ls AS lk, 1 - (1 - {ik}) * lq * ls AS delta FROM g),
    p AS ({variants}),
    q AS (SELECT *, ls / (be * {r}) - 1 AS la FROM p),
    c AS (SELECT *, CASE WHEN variant = 'given_beta' THEN 1 - ({own}) - {ik} * {ky} ELSE {household} END AS ch,
            {land} * (1 - be * (1 + la * th)) / (be * al) AS phi FROM q)
    SELECT id, variant, {', '.join(f'round({expr}, 9) AS {name}' for name, expr in {
        'beta': 'be', 'theta': 'th', 'by': 'by_', 'alpha': 'al', 'lambda_K': 'lk', 'delta': 'delta', 'iy': f'({ik} * {ky})::DOUBLE', 'lambda_a': 'la',
        'phi': 'phi', 'lambda_z': 'pow(ls, 1 - (1 - phi) * al) * pow(lq, -(1 - phi) * al)', 'C_h': 'ch', 'C_e': f'1 - ch - {ik} * {ky}',
        'housing_weight': f'({house} / ch) * ls * (1 - ls / {r}) * (1 - gh / {r}) / (ls - gh)', 'mu_b_e': 'be * la / ls',
        'land_to_debt': f'{land} / by_', 'land_ratio': f'{house}::DOUBLE / {land}', 'L_e': f'1 / (1 + {house}::DOUBLE / {land})',
        'L_h': f'1 - 1 / (1 + {house}::DOUBLE / {land})', 'Omega_h': '(ls - be * (1 + la) * gh) * (ls - gh)',
        'Omega_e': '(ls - be * ge) * (ls - ge)', 'excess_return': 'ls * la / (be * (1 + la))'}.items())} FROM c"""


@query("steady_state_variants", _steady_sql())
def steady_state_variants(spark, sf_dir):
    """All derived values of every parameter row under each of the four restrictions."""
    rows = parameter_rows(spark, sf_dir)
    given = prior.structural(F.col("data"), CODE) | {"beta": 1.0 / (1.0 + 0.01 * F.element_at("data", 5))}
    parts = [
        with_steady_state(rows, given, v).select("id", F.lit(v).alias("variant"), *[rounded(f"ss_{n}", 9).alias(n) for n in STEADY])
        for v in VARIANTS
    ]
    return reduce(DataFrame.unionByName, parts)


_GAMMA = lambda x, a, b: f"({a * math.log(b) - math.lgamma(a)!r}::DOUBLE + {a - 1.0!r}::DOUBLE * ln({x}) - {b} * {x})"
_PRIOR_A, _PRIOR_B = prior.PRIOR_DEVIATION[1:]


@query(
    "structural_parameters",
    f"""WITH {_PARAMS} SELECT id, round(lq, 9) AS lambda_q, round(beta, 9) AS beta, round(la, 9) AS lambda_a,
      round(phi, 9) AS phi, round(lz, 9) AS lambda_z, round(ch, 9) AS c_h, round(ce, 9) AS c_e, valid FROM v""",
)
def structural_parameters(spark, sf_dir):
    """Structural and steady-state values of every parameter row, and whether it is admissible."""
    out = prior.evaluate(parameter_rows(spark, sf_dir), CODE)
    return out.select(
        "id", *[rounded(c, 9).alias(c) for c in ("lambda_q", "beta", "lambda_a", "phi", "lambda_z")],
        rounded("C_h", 9).alias("c_h"), rounded("C_e", 9).alias("c_e"), "valid",
    )


_LOG_PRIOR = f"""        {_GAMMA('x[1]', 1.8611, 3.0112)} + {_GAMMA('x[2]', 1.8611, 3.0112)} + {_GAMMA('x[5]', 1.0, 0.5)}
        + list_sum(list_transform(x[3:4], lambda t: {math.log(2.0)!r}::DOUBLE + ln(1 - t)))
        + list_sum(list_transform(x[6:13], lambda t: {math.log(2.0)!r}::DOUBLE + ln(1 - t)))
        + list_sum(list_transform(x[14:21], lambda t: {_PRIOR_A * math.log(_PRIOR_B) - math.lgamma(_PRIOR_A)!r}::DOUBLE
                   - {_PRIOR_A + 1.0!r}::DOUBLE * ln(t) - {_PRIOR_B!r}::DOUBLE / t))"""


@query(
    "log_prior",
    f"""WITH {_PARAMS} SELECT id, CASE WHEN NOT valid THEN {NEG_INF!r}::DOUBLE ELSE round({_LOG_PRIOR}, 6) END AS log_prior FROM v""",
)
def log_prior(spark, sf_dir):
    out = prior.evaluate(parameter_rows(spark, sf_dir), CODE)
    value = F.when(F.col("valid"), rounded("log_prior")).otherwise(F.lit(NEG_INF))
    return out.select("id", value.alias("log_prior"))


@query("prior_normaliser")
def prior_normaliser(spark, sf_dir):
    """Prior draws keyed by order: share violating the restrictions, and the log normaliser."""
    draws = prior.draw_from_prior(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", CODE)
    return prior.prior_scale(draws, CODE).select(rounded("log_scale").alias("log_scale"), "draws", "rejected")


@query("feasible_prior_start")
def feasible_prior_start(spark, sf_dir):
    """The first admissible prior draw, by order key."""
    draws = prior.draw_from_prior(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", CODE)
    ok = prior.evaluate(draws, CODE).where("valid").orderBy("id").limit(1)
    return ok.select("id", F.posexplode("data").alias("pos", "x"), "log_prior").select(
        "id", F.col("pos").cast("long"), rounded("x").alias("x"), rounded("log_prior").alias("log_prior")
    )


# ---- likelihood of one panel at many parameter rows ---------------------------------------------
_PANEL = f"""b AS (SELECT {QUARTER} AS dt, ln(sum(o_totalprice)) AS y FROM orders GROUP BY 1),
    y AS (SELECT row_number() OVER (ORDER BY dt) - 1 AS t, y - avg(y) OVER () AS y FROM b),
    th AS (SELECT vec_id AS id, exp(2 * embedding[1]::DOUBLE - 3) AS lv, exp(2 * embedding[2]::DOUBLE - 3) AS nv,
                  0.5::DOUBLE + embedding[3]::DOUBLE AS rho, embedding[3] < 0.25 AS ok FROM embeddings),
    f(id, t, z, p, ll) AS (
      SELECT id, -1::BIGINT, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM th WHERE ok
      UNION ALL
      SELECT f.id, f.t + 1, th.rho * f.z + th.rho * f.p / (f.p + th.nv) * (y.y - f.z),
             th.rho * th.rho * (f.p - f.p * f.p / (f.p + th.nv)) + th.lv,
             -0.5 * ({math.log(2 * math.pi)!r}::DOUBLE + ln(f.p + th.nv) + (y.y - f.z) * (y.y - f.z) / (f.p + th.nv))
      FROM f JOIN th ON th.id = f.id JOIN y ON y.t = f.t + 1)"""


def ar_model(x: np.ndarray) -> timeseries.StateSpace:
    """Autoregressive state observed with noise: log variances and persistence from the first three parameters."""
    n = len(x)

    def square(v) -> np.ndarray:
        return np.broadcast_to(v, (n,)).reshape(n, 1, 1).astype(float)

    return timeseries.StateSpace(
        transition=square(0.5 + x[:, 2]), state_noise=square(np.exp(2 * x[:, 0] - 3)), measure=square(1.0),
        measure_noise=square(np.exp(2 * x[:, 1] - 3)), intercept=np.zeros((n, 1)), z0=np.zeros((n, 1)), p0=square(1.0),
    )


@query(
    "parameter_log_likelihood",
    f"""WITH RECURSIVE {_PANEL}
    SELECT th.id, CASE WHEN th.ok THEN round((SELECT sum(ll) FROM f WHERE f.id = th.id AND f.t >= {LAGS}), 6) ELSE {NEG_INF!r}::DOUBLE END AS loglik FROM th""",
)
def parameter_log_likelihood(spark, sf_dir):
    """Likelihood of the quarterly log order volume at every embedding read as a parameter row."""
    value = F.when(F.col("loglik") > NEG_INF / 10, rounded("loglik")).otherwise(F.lit(NEG_INF))
    return panel_log_likelihood(spark, sf_dir).select("id", value.alias("loglik"))


def panel_log_likelihood(spark, sf_dir):
    total = quarterly_orders(spark, sf_dir, "o_orderpriority").groupBy("dt").agg(F.log(F.sum("value")).alias("y"))
    y = np.array([r["y"] for r in total.orderBy("dt").collect()])  # as long as the calendar
    params = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")).alias("data"),
        (F.col("embedding")[2] < 0.25).alias("valid"),
    )
    return timeseries.parameter_log_likelihood(params, ar_model, (y - y.mean())[:, None], LAGS)


# Log scale of the prior normaliser as published for this model.
LOG_SCALE = 0.36140037694606386


@query(
    "log_posterior_kernel",
    f"""WITH RECURSIVE {_PANEL.replace("b AS (", "pb AS (").replace("FROM b)", "FROM pb)")}, {_PARAMS},
    l AS (SELECT id, sum(ll) AS loglik FROM f WHERE t >= {LAGS} GROUP BY id)
    SELECT v.id, CASE WHEN v.valid AND l.loglik IS NOT NULL THEN round(l.loglik + {_LOG_PRIOR} + {LOG_SCALE!r}::DOUBLE, 6)
      ELSE {NEG_INF!r}::DOUBLE END AS log_posterior FROM v LEFT JOIN l ON l.id = v.id""",
)
def log_posterior_kernel(spark, sf_dir):
    """Likelihood of the quarterly order volume plus log prior plus scale, at every embedding read as parameters."""
    priors = prior.evaluate(parameter_rows(spark, sf_dir), CODE)
    out = prior.log_posterior(priors, panel_log_likelihood(spark, sf_dir), LOG_SCALE)
    value = F.when(F.col("log_posterior") > NEG_INF / 10, rounded("log_posterior")).otherwise(F.lit(NEG_INF))
    return out.select("id", value.alias("log_posterior"))


@query(
    "refreshed_weights",
    """SELECT vec_id AS id, round(CASE WHEN vec_id % 3 = 0 THEN -100.0::DOUBLE * embedding[1]::DOUBLE * embedding[1]::DOUBLE
         ELSE -0.5 * list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * embedding[i]::DOUBLE)) END, 9) AS weight FROM embeddings""",
)
def refreshed_weights(spark, sf_dir):
    """Stored weights kept where current, log posterior recomputed where the vector has changed."""
    samples = vector_samples(spark, sf_dir).select("id", "data", "weight", (F.col("id") % 3 == 0).alias("calculated"))
    fresh = target.refresh_weights(samples, lambda x, p: -0.5 * np.sum(x * x, axis=1))
    return fresh.select("id", rounded("weight", 9).alias("weight"))
