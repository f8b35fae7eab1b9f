"""Moments, densities, starters and distribution queries over embeddings and orders."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tempera.catalog.binning import SAMPLES, uniforms
from tempera.catalog.registry import query, rounded, table
from tempera.functions import logmath
from tempera.functions.logmath import HALF_LOG_2PI
from tempera.operators import distribution, group_density, moments, selection, starters
from tempera.plans.adapters import order_samples, vector_samples
from tempera.plans.staging import materialize
from tempera.schema import NEG_INF

DIM = 64

VECTORS = """
v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS data,
             -100.0::DOUBLE * embedding[1]::DOUBLE * embedding[1]::DOUBLE AS weight FROM embeddings)"""


@query(
    "mean_vector",
    f"""WITH {VECTORS}, e AS (SELECT label, i AS pos, data[i + 1] AS x FROM v, range({DIM}) t(i))
    SELECT CAST(label AS BIGINT) AS label, pos, round(avg(x), 9) AS mean FROM e GROUP BY label, pos""",
)
def mean_vector(spark, sf_dir):
    out = moments.mean_vector(vector_samples(spark, sf_dir), "label")
    return out.select(F.col("grp").alias("label"), F.col("pos").cast("long"), rounded("mean", 9).alias("mean"))


_COV = f"""{VECTORS}, e AS (SELECT id, label, i, data[i + 1] AS x FROM v, range({DIM}) t(i)),
cov AS (SELECT a.label, a.i, b.i AS j, avg(a.x * b.x) - avg(a.x) * avg(b.x) AS cov
        FROM e a JOIN e b ON a.id = b.id GROUP BY a.label, a.i, b.i)"""


@query(
    "covariance_matrix",
    f"""WITH {_COV} SELECT CAST(label AS BIGINT) AS label, i, j, round(cov, 9) AS cov FROM cov""",
)
def covariance_matrix(spark, sf_dir):
    out = moments.covariance(vector_samples(spark, sf_dir), "label", DIM)
    return out.select(F.col("grp").alias("label"), F.col("i").cast("long"), F.col("j").cast("long"), rounded("cov", 9).alias("cov"))


@query(
    "covariance_factor",
    f"""WITH {_COV} SELECT CAST(label AS BIGINT) AS label, i, j, round(cov, 9) AS cov FROM cov""",
)
def covariance_factor(spark, sf_dir):
    """B B' of each label's proposal directions B = U sqrt(D)."""
    factor = moments.covariance_factor(moments.covariance(vector_samples(spark, sf_dir), "label", DIM))
    left = factor.select("grp", "i", F.col("j").alias("k"), F.col("value").alias("a"))
    right = factor.select("grp", F.col("i").alias("j"), F.col("j").alias("k"), F.col("value").alias("b"))
    product = left.join(right, ["grp", "k"]).groupBy("grp", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("cov"))
    return product.select(F.col("grp").alias("label"), F.col("i").cast("long"), F.col("j").cast("long"), rounded("cov", 9).alias("cov"))


@query(
    "sample_covariance_and_mode",
    f"""WITH {_COV}, m AS (SELECT label, arg_max(id, (round(weight, 9), -id)) AS mode_id, count(*) AS n FROM v GROUP BY label)
    SELECT CAST(cov.label AS BIGINT) AS label, i, j, round(cov * n / (n - 1), 9) AS cov, mode_id, n
    FROM cov JOIN m ON m.label = cov.label WHERE n > 1""",
)
def sample_covariance_and_mode(spark, sf_dir):
    v = vector_samples(spark, sf_dir)
    mode = v.groupBy(F.col("label").cast("long").alias("grp")).agg(
        F.max_by("id", F.struct(F.round("weight", 9), -F.col("id"))).alias("mode_id")
    )
    cov = moments.covariance(v, "label", DIM).where("n > 1").join(mode, "grp")
    return cov.select(
        F.col("grp").alias("label"), F.col("i").cast("long"), F.col("j").cast("long"),
        rounded(F.col("cov") * F.col("n") / (F.col("n") - 1), 9).alias("cov"), "mode_id", "n",
    )


RIDGE, RADIUS = 0.05, 12.0


def _group_density_sql() -> str:
    """Covariances swept column by column: the inverse with its sign turned, and the pivots, whose logs sum to the log determinant."""
    cell = """CASE WHEN i = k AND j = k THEN -1 / m[k][k] WHEN i = k THEN m[k][j] / m[k][k] WHEN j = k THEN m[i][k] / m[k][k]
              ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END"""
    constant = f"({-logmath.HALF_LOG_2PI * DIM!r}::DOUBLE - 0.5 * log_det)"
    return f"""WITH RECURSIVE {_COV},
    mu AS (SELECT label, list(mean ORDER BY i) AS mean FROM (SELECT label, i, avg(x) AS mean FROM e GROUP BY label, i) GROUP BY label),
    r AS (SELECT label, i, list(cov + CASE WHEN i = j THEN {RIDGE} ELSE 0 END ORDER BY j) AS row FROM cov GROUP BY label, i),
    sweep AS (
      SELECT label, 1 AS k, list(row ORDER BY i) AS m, 0::DOUBLE AS log_det FROM r GROUP BY label
      UNION ALL
      SELECT label, k + 1, list_transform(range(1, {DIM + 1}), lambda i: list_transform(range(1, {DIM + 1}), lambda j: {cell})), log_det + ln(m[k][k])
      FROM sweep WHERE k <= {DIM}),
    a AS (SELECT label, m, log_det, mean FROM sweep JOIN mu USING (label) WHERE k = {DIM + 1}),
    z AS (SELECT id, v.label, log_det, list_transform(range(1, {DIM + 1}), lambda i: data[i] - mean[i]) AS z, m FROM v JOIN a ON a.label = v.label),
    q AS (SELECT id, label, log_det, -list_sum(list_transform(range(1, {DIM + 1}), lambda i: z[i] * list_inner_product(m[i], z))) AS q FROM z)
    SELECT id, CAST(label AS BIGINT) AS label, round(q, 6) AS distance, round({constant} - 0.5 * q, 6) AS density,
           CASE WHEN q > {RADIUS} THEN {NEG_INF!r}::DOUBLE ELSE round({constant} - {math.log(logmath.chi2_cdf(RADIUS, DIM))!r}::DOUBLE - 0.5 * q, 6) END AS truncated
    FROM q"""


@query("group_log_density", _group_density_sql())
def group_log_density(spark, sf_dir):
    """Density of every vector under the full covariance of its label, free and truncated."""
    v = vector_samples(spark, sf_dir)
    factors = materialize(
        group_density.group_factors(moments.covariance(v, "label", DIM), moments.mean_vector(v, "label"), RIDGE), "group-factors"
    )
    out = group_density.group_log_density(v.select("id", F.col("label").cast("long").alias("grp"), "data"), factors, RADIUS)
    truncated = F.when(F.col("truncated") == NEG_INF, F.lit(NEG_INF)).otherwise(rounded("truncated"))
    return out.select("id", F.col("grp").alias("label"), rounded("distance").alias("distance"), rounded("density").alias("density"), truncated.alias("truncated"))


def _dist(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, {DIM + 1}), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


@query(
    "squared_distance_to_best",
    f"""WITH {VECTORS}, b AS (SELECT data FROM v ORDER BY weight DESC, id LIMIT 1)
    SELECT v.id, round({_dist('v.data', 'b.data')}, 9) AS distance FROM v, b""",
)
def squared_distance_to_best(spark, sf_dir):
    v = vector_samples(spark, sf_dir)
    best = starters.best_sample(v).first()["data"]
    return v.select("id", rounded(logmath.squared_distance(F.col("data"), logmath.vector_literal(best)), 9).alias("distance"))


STARTS = 4


def _farthest_sql(band: bool) -> str:
    """Unrolled picks inside the best 20 per cent."""
    parts = [
        VECTORS,
        "n AS (SELECT count(*) AS n FROM v)",
        "p AS (SELECT v.*, row_number() OVER (ORDER BY weight DESC, id) - 1 AS rk FROM v)",
        f"c AS (SELECT greatest({STARTS}, CAST(ceil(0.2::DOUBLE * n) AS BIGINT)) AS m FROM n)",
        "pool AS (SELECT p.* FROM p, c WHERE rk < m)",
        "s0 AS (SELECT 0 AS pick, id, weight, data FROM pool WHERE rk = 0)",
    ]
    for k in range(1, STARTS):
        chosen = " UNION ALL ".join(f"SELECT * FROM s{j}" for j in range(k))
        where = (
            f"WHERE rk >= greatest(1, (SELECT m FROM c) * {k - 1} // {STARTS}) AND rk < (SELECT m FROM c) * {k} // {STARTS}"
            if band else ""
        )
        parts.append(
            f"""s{k} AS (SELECT {k} AS pick, id, weight, data FROM
              (SELECT p.id, p.weight, p.data, (SELECT sum({_dist('p.data', 'x.data')}) FROM ({chosen}) x) AS far FROM pool p {where})
              ORDER BY round(far, 9) DESC, id LIMIT 1)"""
        )
    union = " UNION ALL ".join(f"SELECT * FROM s{j}" for j in range(STARTS))
    return f"WITH {', '.join(parts)} SELECT CAST(pick AS BIGINT) AS pick, id, round(weight, 9) AS weight FROM ({union})"


def _picked(df):
    return df.select(F.col("pick").cast("long"), "id", rounded("weight", 9).alias("weight"))


@query("farthest_starts", _farthest_sql(False))
def farthest_starts(spark, sf_dir):
    return _picked(starters.farthest_first(vector_samples(spark, sf_dir), STARTS, 0.2))


@query("farthest_starts_in_bands", _farthest_sql(True))
def farthest_starts_in_bands(spark, sf_dir):
    return _picked(starters.farthest_in_bands(vector_samples(spark, sf_dir), STARTS, 0.2))


CENTRES, RUNS = 5, 5


def _kmeans_sql() -> str:
    """Lloyd steps as a recursion: a row holds the centres of one run, and ends it once no vector changes its centre."""
    far = f"list_transform(centres, lambda c: {_dist('v.data', 'c')})"
    return f"""WITH RECURSIVE {VECTORS},
    draws AS (SELECT v.id, v.data, run FROM v, range({RUNS}) t(run)),
    {uniforms('u', 'draws', 'id', 'run', 3, 'a')},
    starts AS (SELECT run, list(data ORDER BY a, id) AS centres FROM
      (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY run ORDER BY a, id) <= {CENTRES}) GROUP BY run),
    km AS (
      SELECT run, 0 AS it, centres, '' AS who, FALSE AS still FROM starts
      UNION ALL
      SELECT run, it + 1, list_transform(range(len(centres)), lambda j: coalesce(list_filter(means, lambda m: m.j = j)[1].mean, centres[j + 1])),
             now_who, now_who = who
      FROM (SELECT run, it, centres, who, list({{'j': j, 'mean': mean}}) AS means, string_agg(ids, ';' ORDER BY j) AS now_who FROM
        (SELECT run, it, centres, who, j, list(x ORDER BY dim) AS mean, first(ids) AS ids FROM
          (SELECT run, it, centres, who, j, dim, avg(data[dim]) AS x, j || ':' || count(*) || ':' || sum(hash(id) % 1000000007) AS ids FROM
            (SELECT run, it, centres, who, id, data, list_position(d, list_min(d)) - 1 AS j, unnest(range(1, {DIM + 1})) AS dim FROM
              (SELECT km.*, v.id, v.data, {far} AS d FROM km, v WHERE NOT still))
           GROUP BY run, it, centres, who, j, dim)
         GROUP BY run, it, centres, who, j)
       GROUP BY run, it, centres, who)),
    costs AS (SELECT run, centres, sum(list_min({far})) AS cost FROM km, v WHERE still GROUP BY run, centres),
    best AS (SELECT unnest(centres) AS c FROM (SELECT * FROM costs ORDER BY round(cost, 9), run LIMIT 1))
    SELECT pick - 1 AS pick, pos - 1 AS pos, round(c[pos], 6) AS x
    FROM (SELECT row_number() OVER (ORDER BY c) AS pick, c FROM best), range(1, {DIM + 1}) t(pos)"""


@query("kmeans_starts", _kmeans_sql())
def kmeans_starts(spark, sf_dir):
    """Cluster centres of all vectors, as chain starts."""
    centres = starters.kmeans_centres(vector_samples(spark, sf_dir), CENTRES, 3, RUNS)
    return centres.select(F.col("pick").cast("long"), F.posexplode("data").alias("pos", "x")).select(
        "pick", F.col("pos").cast("long"), rounded("x").alias("x")
    )


@query(
    "splice_vectors",
    f"""WITH {VECTORS}, b AS (SELECT data FROM v ORDER BY weight DESC, id LIMIT 1)
    SELECT v.id, round(list_sum(list_transform(range(1, {DIM + 1}), lambda i: i * CASE WHEN i BETWEEN 9 AND 24 THEN b.data[i - 4] ELSE v.data[i] END)), 9) AS checksum,
           len(v.data) AS dim FROM v, b""",
)
def splice_vectors(spark, sf_dir):
    """Elements 8..23 of every vector replaced by elements 4..19 of the best one."""
    v = vector_samples(spark, sf_dir)
    best = logmath.vector_literal(starters.best_sample(v).first()["data"])
    mixed = v.select("id", logmath.splice(F.col("data"), 8, best, 4, 16).alias("m"))
    weighted = F.aggregate(
        F.transform("m", lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x
    )
    return mixed.select("id", rounded(weighted, 9).alias("checksum"), F.size("m").cast("long").alias("dim"))


# ---- densities: diagonal parameters taken as fixed inputs --------------------------------------
MU = [0.01 * ((i % 7) - 3) for i in range(DIM)]
PRECISION = [60.0 + (i % 5) for i in range(DIM)]
TRUNCATION = 62.0


def _list(v) -> str:
    return "[" + ", ".join(repr(float(x)) for x in v) + "]::DOUBLE[]"


def _quad(mu, precision) -> str:
    return f"list_sum(list_transform(range(1, {DIM + 1}), lambda i: (data[i] - ({_list(mu)})[i]) * (data[i] - ({_list(mu)})[i]) * ({_list(precision)})[i]))"


_CONST = -HALF_LOG_2PI * DIM + logmath.half_log_det(PRECISION)


@query(
    "normal_log_density",
    f"""WITH {VECTORS} SELECT id, round(-0.5 * {_quad(MU, PRECISION)}, 6) AS kernel,
      round({_CONST!r}::DOUBLE - 0.5 * {_quad(MU, PRECISION)}, 6) AS density FROM v""",
)
def normal_log_density(spark, sf_dir):
    x = F.col("data")
    return vector_samples(spark, sf_dir).select(
        "id", rounded(logmath.log_normal_kernel(x, MU, PRECISION)).alias("kernel"),
        rounded(logmath.log_normal_density(x, MU, PRECISION)).alias("density"),
    )


@query(
    "truncated_normal_log_density",
    f"""WITH {VECTORS}, q AS (SELECT id, {_quad(MU, PRECISION)} AS q FROM v)
    SELECT id, q <= {TRUNCATION} AS inside,
      CASE WHEN q > {TRUNCATION} THEN {NEG_INF!r}::DOUBLE
           ELSE round({logmath.truncated_normal_constant(np.array(PRECISION), TRUNCATION)!r}::DOUBLE - 0.5 * q, 6) END AS density FROM q""",
)
def truncated_normal_log_density(spark, sf_dir):
    x = F.col("data")
    density = logmath.log_truncated_normal(x, MU, np.array(PRECISION), TRUNCATION)
    return vector_samples(spark, sf_dir).select(
        "id", (logmath.quadratic_form(x, MU, PRECISION) <= TRUNCATION).alias("inside"),
        F.when(density > NEG_INF / 10, rounded(density)).otherwise(F.lit(NEG_INF)).alias("density"),
    )


MIX_WEIGHTS = [math.log(0.3), math.log(0.7)]
MIX_MU = [MU, [-m for m in MU]]
MIX_PRECISION = [PRECISION, [50.0] * DIM]


@query(
    "normal_mixture_log_kernel",
    f"""WITH {VECTORS}, t AS (SELECT id,
        {MIX_WEIGHTS[0] + logmath.half_log_det(MIX_PRECISION[0])!r}::DOUBLE - 0.5 * {_quad(MIX_MU[0], MIX_PRECISION[0])} AS a,
        {MIX_WEIGHTS[1] + logmath.half_log_det(MIX_PRECISION[1])!r}::DOUBLE - 0.5 * {_quad(MIX_MU[1], MIX_PRECISION[1])} AS b FROM v)
    SELECT id, round(greatest(a, b) + ln(1 + exp(-abs(a - b))), 6) AS kernel FROM t""",
)
def normal_mixture_log_kernel(spark, sf_dir):
    kernel = logmath.log_normal_mixture(F.col("data"), MIX_WEIGHTS, MIX_MU, MIX_PRECISION)
    return vector_samples(spark, sf_dir).select("id", rounded(kernel).alias("kernel"))


# ---- empirical distribution --------------------------------------------------------------------
@query(
    "ecdf_grid",
    f"""WITH {SAMPLES}, e AS (SELECT level, min(energy) AS a, max(energy) AS z, count(*) AS n FROM s GROUP BY level),
    g AS (SELECT level, i AS point, a + i * ((z - a) / 99) AS x, n FROM e, range(100) t(i))
    SELECT CAST(g.level AS BIGINT) AS level, g.point, round(g.x, 6) AS x,
           round((SELECT count(*) FROM s WHERE s.level = g.level AND s.energy <= g.x) / g.n::DOUBLE, 9) AS share FROM g""",
)
def ecdf_grid(spark, sf_dir):
    df = order_samples(spark, sf_dir).select("level", (-F.col("weight")).alias("energy"))
    return distribution.ecdf_grid(df, ["level"], "energy").select(
        F.col("level").cast("long"), F.col("point").cast("long"), rounded("x").alias("x"), rounded("share", 9).alias("share")
    )


@query(
    "mean_and_deviation",
    """SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, count(value) AS n
    FROM events GROUP BY event_type""",
)
def mean_and_deviation(spark, sf_dir):
    out = distribution.moments(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", rounded("mean").alias("mean"), rounded("sd").alias("sd"), "n")


@query(
    "forecast_percentiles",
    """WITH q AS (SELECT year(o_orderdate) + (quarter(o_orderdate) - 1) / 4.0::DOUBLE AS dt, o_totalprice AS v FROM orders)
    SELECT dt, p, round(quantile_cont(v, p), 6) AS value FROM q, (VALUES (0.16::DOUBLE), (0.5::DOUBLE), (0.84::DOUBLE)) t(p) GROUP BY dt, p"""
    .replace("quantile_cont(v, p)", "CASE p WHEN 0.16 THEN quantile_cont(v, 0.16) WHEN 0.5 THEN quantile_cont(v, 0.5) ELSE quantile_cont(v, 0.84) END"),
)
def forecast_percentiles(spark, sf_dir):
    """Error bands and median of the paths at each horizon (quarter)."""
    from tempera.operators.timeseries import quarter_of

    paths = table(spark, sf_dir, "orders").select(
        quarter_of(F.col("o_orderdate")).alias("dt"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("id")
    )
    out = selection.exact_percentiles(paths, ["dt"], "v", "id", [0.16, 0.5, 0.84])
    return out.select("dt", "p", rounded("value").alias("value"))


@query(
    "forecast_mean",
    """SELECT year(o_orderdate) + (quarter(o_orderdate) - 1) / 4.0::DOUBLE AS dt, round(avg(ln(o_totalprice)), 9) AS mean, count(*) AS n
    FROM orders GROUP BY 1""",
)
def forecast_mean(spark, sf_dir):
    """Mean of the log paths at each horizon."""
    from tempera.operators.timeseries import quarter_of

    return table(spark, sf_dir, "orders").groupBy(quarter_of(F.col("o_orderdate")).alias("dt")).agg(
        rounded(F.avg(F.log("o_totalprice")), 9).alias("mean"), F.count(F.lit(1)).alias("n")
    )


@query(
    "importance_mean",
    """WITH w AS (SELECT event_type, ln(value) AS x,
        -0.5 * (ln(value) - 4) * (ln(value) - 4) / 0.8 - 0.5 * ln(0.8::DOUBLE) + 0.5 * (ln(value) - 3.3) * (ln(value) - 3.3) AS lw
      FROM events WHERE value > 0)
    SELECT event_type, round(max(exp(lw)), 9) AS max_weight, round(avg(exp(lw)), 9) AS mean_weight,
           round(sum(exp(lw) * x) / sum(exp(lw)), 9) AS mean FROM w GROUP BY event_type""",
)
def importance_mean(spark, sf_dir):
    """Log values reweighted from N(3.3, 1) to N(4, 0.8)."""
    x = F.col("x")
    events = table(spark, sf_dir, "events").where("value > 0").select("event_type", F.log("value").alias("x"))
    log_weight = -0.5 * (x - 4) * (x - 4) / 0.8 - F.lit(0.5 * math.log(0.8)) + 0.5 * (x - 3.3) * (x - 3.3)
    out = distribution.importance_summary(events, ["event_type"], "x", log_weight)
    return out.select(
        "event_type", *[rounded(c, 9).alias(c) for c in ("max_weight", "mean_weight", "mean")]
    )


def _poly(coefficients, x: str) -> str:
    out = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


_TAIL = "sqrt(-2.0 * ln(least(a, 1 - a)))"


@query(
    "normal_generators",
    f"""WITH k AS (SELECT o_orderkey AS id FROM orders),
    {uniforms('u0', 'k', 'id', '0', 31, 'a')}, {uniforms('u2', 'u0', 'id', '2', 31, 'b')}, {uniforms('u3', 'u2', 'id', '3', 31, 'c')}
    SELECT id,
      round(3.6 + 2.4::DOUBLE * CASE
        WHEN a < 0.02425 THEN {_poly(distribution.TAIL_NUM, _TAIL)} / {_poly(distribution.TAIL_DEN, _TAIL)}
        WHEN a > 1 - 0.02425 THEN -{_poly(distribution.TAIL_NUM, _TAIL)} / {_poly(distribution.TAIL_DEN, _TAIL)}
        ELSE {_poly(distribution.CENTRAL_NUM, '((a - 0.5) * (a - 0.5))')} * (a - 0.5) / {_poly(distribution.CENTRAL_DEN, '((a - 0.5) * (a - 0.5))')} END, 6) AS inverse_cdf,
      round(3.6 + 2.4::DOUBLE * sqrt(-2.0 * ln(b)) * cos({2 * math.pi!r}::DOUBLE * c), 6) AS box_muller_cos,
      round(3.6 + 2.4::DOUBLE * sqrt(-2.0 * ln(b)) * sin({2 * math.pi!r}::DOUBLE * c), 6) AS box_muller_sin
    FROM u3""",
)
def normal_generators(spark, sf_dir):
    """N(3.6, 2.4) draws keyed by order, by inverse CDF and by both Box-Muller halves."""
    draws = distribution.normal_draws(
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", 3.6, 2.4, 31
    )
    return draws.select("id", *[rounded(c).alias(c) for c in ("inverse_cdf", "box_muller_cos", "box_muller_sin")])
