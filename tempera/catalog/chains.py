"""Simulation queries: every event user (or embedding) drives a chain of its own."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import functions as F

from tempera.catalog.binning import threefry_steps, uniforms
from tempera.catalog.registry import query, rounded, table
from tempera.operators import chains, climb, tuning
from tempera.operators.store import SampleStore
from tempera.plans.adapters import vector_samples
from tempera.plans.ladder import run_ladder
from tempera.plans.settings import RunSettings

BURN_IN, THIN, DRAWS, SCALE, SEED = 20, 2, 40, 8.0, 41
STEPS = BURN_IN + THIN * DRAWS


def normal_density(x: np.ndarray, p: dict) -> np.ndarray:
    z = (x - p["mu"].reshape(len(x), -1)) / p["s"].reshape(len(x), -1)
    return -0.5 * np.sum(z * z, axis=1)


def user_posteriors(spark, sf_dir):
    """Posterior of each user's mean value under a flat prior: mean and standard error."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("chain")).agg(
        F.avg("value").alias("mu"), (F.stddev_pop("value") / F.sqrt(F.count("value"))).alias("s")
    ).where("s > 0")


@query(
    "random_walk_metropolis",
    f"""WITH RECURSIVE p AS (SELECT user_id AS chain, avg(value) AS mu, stddev_pop(value) / sqrt(count(value)) AS s
        FROM events GROUP BY user_id HAVING stddev_pop(value) > 0),
    k AS (SELECT chain, t FROM p, range({STEPS}) r(t)),
    {uniforms('ua', 'k', 'chain', '2 * t', SEED, 'a')}, {uniforms('ub', 'ua', 'chain', '2 * t + 1', SEED, 'b')},
    {uniforms('uc', 'ub', 'chain', f't + {chains.ACCEPT}', SEED, 'c')},
    z AS (SELECT chain, t, sqrt(-2.0 * ln(a)) * cos({2 * math.pi!r}::DOUBLE * b) AS z, ln(c) AS lu FROM uc),
    w(chain, t, x) AS (SELECT chain, -1::BIGINT, mu + 2 * s FROM p
      UNION ALL
      SELECT w.chain, w.t + 1,
        CASE WHEN -0.5 * ((w.x + {SCALE} * z.z - p.mu) / p.s) * ((w.x + {SCALE} * z.z - p.mu) / p.s)
                  + 0.5 * ((w.x - p.mu) / p.s) * ((w.x - p.mu) / p.s) >= z.lu
             THEN w.x + {SCALE} * z.z ELSE w.x END
      FROM w JOIN z ON z.chain = w.chain AND z.t = w.t + 1 JOIN p ON p.chain = w.chain)
    SELECT w.chain, (t - {BURN_IN}) // {THIN} AS iter, round(x, 6) AS x,
           round(-0.5 * ((x - mu) / s) * ((x - mu) / s), 6) AS weight
    FROM w JOIN p ON p.chain = w.chain WHERE t >= {BURN_IN} AND (t - {BURN_IN}) % {THIN} = {THIN - 1}""",
)
def random_walk_metropolis(spark, sf_dir):
    """A burnt-in, thinned one-block chain per user."""
    posteriors = user_posteriors(spark, sf_dir)
    tasks = posteriors.select(
        "chain", F.lit(0).alias("level"), F.lit(1.0).alias("temperature"),
        F.array(F.col("mu") + 2 * F.col("s")).alias("start"), "mu", "s",
    )
    plan = chains.Schedule(draws=DRAWS, burn_in=BURN_IN, thin=THIN, seed=SEED)
    draws = chains.simulate(tasks, normal_density, plan, [np.array([[SCALE]])])
    return draws.select("chain", "iter", rounded(F.col("data")[0]).alias("x"), rounded("weight").alias("weight"))


BLOCK_STEPS = 60


@query(
    "block_metropolis",
    f"""WITH RECURSIVE e AS (SELECT user_id AS chain, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS dim, value FROM events),
    q AS (SELECT chain, dim, avg(value) AS mu, stddev_pop(value) / sqrt(count(value)) AS s FROM e GROUP BY chain, dim),
    p AS (SELECT chain, max(CASE WHEN dim = 0 THEN mu END) AS m0, max(CASE WHEN dim = 1 THEN mu END) AS m1,
                 max(CASE WHEN dim = 0 THEN s END) AS s0, max(CASE WHEN dim = 1 THEN s END) AS s1
          FROM q GROUP BY chain HAVING min(s) > 0 AND count(*) = 2),
    k AS (SELECT chain, t FROM p, range({2 * BLOCK_STEPS}) r(t)),
    {uniforms('ua', 'k', 'chain', '2 * t', 43, 'a')}, {uniforms('ub', 'ua', 'chain', '2 * t + 1', 43, 'b')},
    {uniforms('uc', 'ub', 'chain', f't + {chains.ACCEPT}', 43, 'c')},
    z AS (SELECT chain, t, sqrt(-2.0 * ln(a)) * cos({2 * math.pi!r}::DOUBLE * b) * CASE WHEN t % 2 = 0 THEN 12.0 ELSE 9.0 END AS move, ln(c) AS lu FROM uc),
    w(chain, t, x0, x1, moved) AS (SELECT chain, -1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, FALSE FROM p
      UNION ALL
      SELECT chain, t + 1, CASE WHEN ok AND (t + 1) % 2 = 0 THEN y ELSE x0 END, CASE WHEN ok AND (t + 1) % 2 = 1 THEN y ELSE x1 END, ok
      FROM (SELECT w.chain, w.t, w.x0, w.x1,
              CASE WHEN (w.t + 1) % 2 = 0 THEN w.x0 ELSE w.x1 END + z.move AS y,
              -0.5 * (pow((CASE WHEN (w.t + 1) % 2 = 0 THEN w.x0 ELSE w.x1 END + z.move - CASE WHEN (w.t + 1) % 2 = 0 THEN m0 ELSE m1 END)
                          / CASE WHEN (w.t + 1) % 2 = 0 THEN s0 ELSE s1 END, 2)
                      - pow((CASE WHEN (w.t + 1) % 2 = 0 THEN w.x0 - m0 ELSE w.x1 - m1 END) / CASE WHEN (w.t + 1) % 2 = 0 THEN s0 ELSE s1 END, 2)) >= z.lu AS ok
            FROM w JOIN z ON z.chain = w.chain AND z.t = w.t + 1 JOIN p ON p.chain = w.chain))
    SELECT chain, count(*) FILTER (WHERE t % 2 = 1) AS draws,
           round(avg(CASE WHEN t % 2 = 1 THEN x0 END), 6) AS mean0, round(avg(CASE WHEN t % 2 = 1 THEN x1 END), 6) AS mean1,
           round(max(CASE WHEN t = {2 * BLOCK_STEPS - 1} THEN x0 END), 6) AS last0
    FROM w WHERE t >= 0 GROUP BY chain""",
)
def block_metropolis(spark, sf_dir):
    """A two-block chain per user: browsing and other values move in turn."""
    dim = F.when(F.col("event_type").isin("view", "click"), 0).otherwise(1)
    parts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("chain")).agg(
        *[
            F.array(*[fn(F.when(dim == d, F.col("value"))) for d in (0, 1)]).alias(name)
            for name, fn in (("mu", F.avg), ("s", lambda v: F.stddev_pop(v) / F.sqrt(F.count(v))))
        ]
    ).where("s[0] > 0 AND s[1] > 0")
    tasks = parts.select(
        "chain", F.lit(0).alias("level"), F.lit(1.0).alias("temperature"),
        F.array(F.lit(0.0), F.lit(0.0)).alias("start"), "mu", "s",
    )
    blocks = [np.array([[12.0], [0.0]]), np.array([[0.0], [9.0]])]
    draws = chains.simulate(tasks, normal_density, chains.Schedule(draws=BLOCK_STEPS, seed=43), blocks)
    return draws.groupBy("chain").agg(
        F.count(F.lit(1)).alias("draws"),
        rounded(F.avg(F.col("data")[0])).alias("mean0"), rounded(F.avg(F.col("data")[1])).alias("mean1"),
        rounded(F.max_by(F.col("data")[0], "iter")).alias("last0"),
    )


@query(
    "metropolis_hastings_step",
    f"""WITH p AS (SELECT user_id AS chain, avg(value) AS mu, stddev_pop(value) / sqrt(count(value)) AS s FROM events GROUP BY user_id HAVING stddev_pop(value) > 0),
    k AS (SELECT e.event_id AS id, e.value AS y, p.* FROM events e JOIN p ON p.chain = e.user_id),
    {uniforms('u', 'k', 'id', '0', 47, 'a')},
    r AS (SELECT *, -0.5 * ((y - mu) / s) * ((y - mu) / s) - (-y / 50.0) AS ly, 0.0 - (-mu / 50.0) AS lx FROM u)
    SELECT id, ly - lx >= ln(a) AS accepted, round(CASE WHEN ly - lx >= ln(a) THEN y ELSE mu END, 6) AS x FROM r""",
)
def metropolis_hastings_step(spark, sf_dir):
    """Each event value is an independent exponential proposal to its user's chain, now at the mean."""
    from tempera.functions.counter_rng import with_uniforms
    from tempera.operators.energy import mh_accept

    posteriors = user_posteriors(spark, sf_dir).withColumnRenamed("chain", "user_id")
    k = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("value").alias("y"))
    k = with_uniforms(k.join(posteriors, "user_id"), F.col("id"), {"u": 0}, 47)
    z = (F.col("y") - F.col("mu")) / F.col("s")
    proposed = -0.5 * z * z - (-F.col("y") / 50.0)
    ok = mh_accept(proposed, F.lit(0.0) - (-F.col("mu") / 50.0), F.col("u"))
    return k.select("id", ok.alias("accepted"), rounded(F.when(ok, F.col("y")).otherwise(F.col("mu"))).alias("x"))


def _nested_uniform(source: str, key: str, counter: str, seed: int, out: str) -> str:
    """The counter generator as nested subqueries, for use inside a recursive step."""
    sql = source
    for step in threefry_steps(key, counter, seed, out):
        sql = f"({step} FROM {sql})"
    return sql


TUNE = tuning.TuneSettings(period=25, max_period=200)


def _tuning_sql() -> str:
    target, p0 = TUNE.target, TUNE.period
    draws = _nested_uniform("w", "chain", "2 * n", TUNE.seed, "a")
    draws = _nested_uniform(draws, "chain", "2 * n + 1", TUNE.seed, "b")
    draws = _nested_uniform(draws, "chain", f"n + {chains.ACCEPT}", TUNE.seed, "c")
    return f"""WITH RECURSIVE p AS (SELECT user_id AS chain, avg(value) AS mu, stddev_pop(value) / sqrt(count(value)) AS s
        FROM events GROUP BY user_id HAVING stddev_pop(value) > 0),
    w(chain, n, mu, s, x, scale, best, ls, lr, hs, hr, per, due, since, acc, rate, live) AS (
      SELECT chain, 0::BIGINT, mu, s, mu, 1.0::DOUBLE, 1.0::DOUBLE, -1.0::DOUBLE, -1.0::DOUBLE, -1.0::DOUBLE, -1.0::DOUBLE,
             {p0}::BIGINT, {p0}::BIGINT, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, TRUE FROM p
      UNION ALL
      SELECT chain, n, mu, s, x, scale, best, ls, CASE WHEN boxed THEN -1.0 ELSE lr END, hs, CASE WHEN boxed THEN -1.0 ELSE hr END,
             per, CASE WHEN chk THEN n + per ELSE due END, CASE WHEN chk THEN n ELSE since END, CASE WHEN chk THEN 0 ELSE acc END, rate,
             n % {p0} <> 0 OR per <= {TUNE.max_period}
      FROM (SELECT * REPLACE (
              CASE WHEN boxed THEN inside WHEN chk THEN scale ELSE best END AS best,
              CASE WHEN boxed THEN inside
                   WHEN chk AND lr < 0 THEN hs * CASE WHEN rate > pow({target}, 0.2) THEN 5.0 ELSE ln({target}) / ln(rate) END
                   WHEN chk THEN ls * CASE WHEN rate < pow({target}, 5) THEN 0.2 ELSE ln({target}) / ln(rate) END
                   ELSE scale END AS scale,
              CASE WHEN boxed THEN 2 * per ELSE per END AS per)
            FROM (SELECT *, chk AND lr >= 0 AND hr >= 0 AS boxed,
                    CASE WHEN hr - lr > 1e-6 THEN ls + ({target} - lr) / (hr - lr) * (hs - ls) ELSE 0.5 * (ls + hs) END AS inside
                  FROM (SELECT * REPLACE (
                          CASE WHEN chk AND rate < {target} THEN scale ELSE ls END AS ls, CASE WHEN chk AND rate < {target} THEN rate ELSE lr END AS lr,
                          CASE WHEN chk AND rate >= {target} THEN scale ELSE hs END AS hs, CASE WHEN chk AND rate >= {target} THEN rate ELSE hr END AS hr)
                        FROM (SELECT * REPLACE (CASE WHEN chk THEN acc / (n - since)::DOUBLE ELSE rate END AS rate)
                              FROM (SELECT *, n % {p0} = 0 AND due <= n AS chk
                                    FROM (SELECT * REPLACE (n + 1 AS n, CASE WHEN ok THEN y ELSE x END AS x, acc + CAST(ok AS BIGINT) AS acc)
                                          FROM (SELECT *, -0.5 * ((y - mu) / s) * ((y - mu) / s) + 0.5 * ((x - mu) / s) * ((x - mu) / s) >= ln(c) AS ok
                                                FROM (SELECT *, x + sqrt(-2.0 * ln(a)) * cos({2 * math.pi!r}::DOUBLE * b) * scale AS y
                                                      FROM {draws} WHERE live)))))))))
    SELECT chain, 0::BIGINT AS block, round(best, 6) AS scale, round(rate, 6) AS rate, round(best / s, 6) AS relative_scale
    FROM w WHERE NOT live"""


@query("adaptive_scale_tuning", _tuning_sql())
def adaptive_scale_tuning(spark, sf_dir):
    """Tuned proposal scale for every user's posterior, from unit scale."""
    posteriors = user_posteriors(spark, sf_dir)
    tasks = posteriors.select(
        "chain", F.lit(0).alias("level"), F.lit(1.0).alias("temperature"), F.array("mu").alias("start"), "mu", "s"
    )
    out = tuning.tune_scales(tasks, normal_density, [np.eye(1)], TUNE)
    return out.join(posteriors, "chain").select(
        "chain", F.col("block").cast("long"), rounded("scale").alias("scale"), rounded("rate").alias("rate"),
        rounded(F.col("scale") / F.col("s")).alias("relative_scale"),
    )


def label_mixture(spark, sf_dir):
    """Mixture over the first two coordinates, one component per label, from the table's moments."""
    rows = (
        table(spark, sf_dir, "embeddings")
        .groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(F.col("embedding")[d].cast("double")).alias(f"m{d}") for d in (0, 1)],
        )
        .orderBy("label")
        .collect()
    )
    total = sum(r["n"] for r in rows)
    log_w = np.log(np.array([r["n"] / total for r in rows]))
    mu = np.array([[r["m0"], r["m1"]] for r in rows])

    def density(x: np.ndarray, params: dict) -> np.ndarray:
        e = (x[:, None, :] - mu[None]) / 0.02
        terms = log_w - 0.5 * np.sum(e * e, axis=2)
        top = terms.max(axis=1)
        return top + np.log(np.exp(terms - top[:, None]).sum(axis=1))

    return density, mu


@query("equi_energy_ladder")
def equi_energy_ladder(spark, sf_dir):
    """A three-level tempered run, one chain per embedding, groups by label; counts and moments per bin."""
    density, mu = label_mixture(spark, sf_dir)
    roster = vector_samples(spark, sf_dir).select(F.col("id").alias("chain"), F.col("label").cast("long").alias("grp"))
    n = roster.count()
    settings = RunSettings(
        levels=3, t_low=1.0, t_high=30.0, thin=2, sweeps_per_draw=4, draws=10 * n, burn_in=20,
        covariance_draws=2 * n, period=20, max_period=40, pool_capacity=500, seed=5,
    )
    store = SampleStore.in_shared_folder(spark, f"ladder-{uuid.uuid4().hex}")
    run_ladder(roster, density, [float(v) for v in mu.mean(axis=0)], store, settings)
    x, y = F.col("data")[0], F.col("data")[1]
    return store.scan().groupBy(F.col("level").cast("long"), F.col("bin").cast("long")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("weight")).alias("mean_weight"),
        rounded(F.avg(x)).alias("mean_x"), rounded(F.avg(y)).alias("mean_y"),
    )


# ---- hybrid chains with an exact SQL form: the pool is drawn from the event values themselves ----
POOL_BINS, POOL_CAPACITY, CALLS, T_COLD, T_HOT = 5, 200, 40, 1.0, 12.0
CENTRE, WIDTH = 50.0, 8.0


def centred_density(x: np.ndarray, p: dict) -> np.ndarray:
    z = (x[:, 0] - 50.0) / 8.0
    return -0.5 * z * z


def _hybrid_sql() -> str:
    step = "w"
    for counter, name in (("3 * n", "g"), ("3 * n + 1", "k"), ("3 * n + 2", "l")):
        step = _nested_uniform(step, "chain", f"{counter} + {chains.JUMP}", 83, name)
    for counter, seed, name in (("2 * n", 83, "a"), ("2 * n + 1", 83, "b"), (f"n + {chains.ACCEPT}", 83, "c")):
        step = _nested_uniform(step, "chain", counter, seed, name)
    energy = f"0.5 * ((x - {CENTRE}) / {WIDTH}) * ((x - {CENTRE}) / {WIDTH})"
    return f"""WITH RECURSIVE v AS (SELECT event_id AS id, value AS x FROM events),
    r AS (SELECT id, x, {energy} AS energy FROM v),
    q AS (SELECT *, row_number() OVER (ORDER BY energy, id) - 1 AS rn, count(*) OVER () AS n FROM r),
    q2 AS (SELECT *, CAST(ceil(n / {POOL_BINS}.0::DOUBLE) AS BIGINT) AS chunk FROM q),
    q3 AS (SELECT *, least(rn // chunk, (CASE WHEN (n - 1) % chunk = 0 AND n - 1 >= chunk THEN (n - 1) // chunk
                     ELSE CAST(ceil(n / chunk::DOUBLE) AS BIGINT) END) - 1) AS bin FROM q2),
    low AS (SELECT bin, min(energy) AS lo, count(*) AS m FROM q3 GROUP BY bin),
    numbered AS (SELECT bin, x, energy, row_number() OVER (PARTITION BY bin ORDER BY id) - 1 AS row FROM q3),
    picks AS (SELECT bin, m, pick, pick AS k FROM low, range({POOL_CAPACITY}) t(pick)),
    {uniforms('pu', 'picks', 'bin', 'pick', 79, 'a')},
    pool AS (SELECT pu.bin * {POOL_CAPACITY} + pu.pick AS idx, nb.x AS px, -nb.energy AS pw
             FROM pu JOIN numbered nb ON nb.bin = pu.bin AND nb.row = CAST(floor(pu.a * pu.m) AS BIGINT)),
    bounds AS (SELECT list(lo ORDER BY bin) AS lows FROM low),
    w(chain, n, x, w, ee, mh) AS (
      SELECT user_id, 0::BIGINT, avg(value), -0.5 * ((avg(value) - {CENTRE}) / {WIDTH}) * ((avg(value) - {CENTRE}) / {WIDTH}), 0::BIGINT, 0::BIGINT
      FROM events GROUP BY user_id
      UNION ALL
      SELECT chain, n + 1, CASE WHEN j THEN px WHEN ok THEN y ELSE x END, CASE WHEN j THEN pw WHEN ok THEN wy ELSE w END,
             CAST(j AS BIGINT), CAST(NOT j AND ok AS BIGINT)
      FROM (SELECT *, g > 0.3 AND ln(l) <= (pw - w) * ({1.0 / T_COLD!r}::DOUBLE - {1.0 / T_HOT!r}::DOUBLE) AS j,
                   (wy - CASE WHEN g > 0.3 AND ln(l) <= (pw - w) * ({1.0 / T_COLD!r}::DOUBLE - {1.0 / T_HOT!r}::DOUBLE) THEN pw ELSE w END) / {T_COLD} >= ln(c) AS ok
            FROM (SELECT *, -0.5 * ((y - {CENTRE}) / {WIDTH}) * ((y - {CENTRE}) / {WIDTH}) AS wy
                  FROM (SELECT s.*, pool.px, pool.pw, x + 6.0 * (sqrt(-2.0 * ln(a)) * cos({2 * math.pi!r}::DOUBLE * b)) AS y
                        FROM (SELECT *, greatest(len(list_filter(lows, lambda t: t <= -w)) - 1, 0) * {POOL_CAPACITY}
                                       + CAST(floor(k * {POOL_CAPACITY}) AS BIGINT) AS idx
                              FROM {step}, bounds WHERE n < {CALLS}) s JOIN pool ON pool.idx = s.idx))))
    SELECT chain, n - 1 AS iter, round(x, 6) AS x, round(w, 6) AS weight, ee, mh FROM w WHERE n > 0"""


@query("equi_energy_chains", _hybrid_sql())
def equi_energy_chains(spark, sf_dir):
    """Cross-level chains, one per user: jumps into a pool of event values, else a Metropolis move."""
    from tempera.operators.binning import assign_equal_count, equal_count_bounds
    from tempera.operators.starters import draw_pool
    from tempera.plans.ladder import pool_from_rows

    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "value")
    z = (F.col("value") - CENTRE) / WIDTH
    above = events.select("id", F.lit(1).alias("level"), F.array("value").alias("data"), (-(0.5 * z * z)).alias("weight"))
    bounds = equal_count_bounds(above, POOL_BINS)
    picks = draw_pool(assign_equal_count(above, bounds).select("bin", "id", "data", "weight"), POOL_CAPACITY, 79)
    pool = pool_from_rows(picks, [r["lo"] for r in bounds.orderBy("bin").collect()], T_HOT)
    tasks = events.groupBy(F.col("user_id").alias("chain")).agg(F.avg("value").alias("m")).select(
        "chain", F.lit(0).alias("level"), F.lit(T_COLD).alias("temperature"), F.array("m").alias("start")
    )
    draws = chains.simulate(tasks, centred_density, chains.Schedule(draws=CALLS, seed=83), [np.array([[6.0]])], pool)
    return draws.select(
        "chain", "iter", rounded(F.col("data")[0]).alias("x"), rounded("weight").alias("weight"),
        F.col("ee_jumps").alias("ee"), F.col("mh_jumps").alias("mh"),
    )


@query("hybrid_jump_counts")
def hybrid_jump_counts(spark, sf_dir):
    """Cross-level chains below a pool of hot samples: how often they jumped, moved or stayed."""
    density, mu = label_mixture(spark, sf_dir)
    tasks = vector_samples(spark, sf_dir).select(
        F.col("id").alias("chain"), F.lit(0).alias("level"), F.lit(1.0).alias("temperature"),
        F.slice("data", 1, 2).alias("start"),
    )
    hot = tasks.withColumn("level", F.lit(1)).withColumn("temperature", F.lit(20.0))
    above = chains.simulate(hot, density, chains.Schedule(draws=20, burn_in=20, seed=61), [0.1 * np.eye(2)])
    from tempera.operators.binning import assign_equal_count, equal_count_bounds
    from tempera.operators.starters import draw_pool
    from tempera.plans.ladder import pool_from_rows
    from tempera.plans.staging import materialize

    stored = materialize(
        above.select(
            (F.col("chain") * 20 + F.col("iter")).alias("id"), "level", "data", "weight"
        ),
        "hot",
    )
    bounds = equal_count_bounds(stored, 5)
    lows = [r["lo"] for r in bounds.orderBy("bin").collect()]
    picks = draw_pool(assign_equal_count(stored, bounds).select("bin", "id", "data", "weight"), 400, 67)
    pool = pool_from_rows(picks, lows, 20.0)
    plan = chains.Schedule(draws=20, thin=3, burn_in=10, seed=71)
    draws = chains.simulate(tasks, density, plan, [0.03 * np.eye(2)], pool)
    return draws.groupBy("iter").agg(
        F.sum("ee_jumps").alias("ee_jumps"), F.sum("mh_jumps").alias("mh_jumps"), (3 * F.count(F.lit(1))).alias("calls")
    )


def _normal_fit_objective(x: np.ndarray, p: dict) -> np.ndarray:
    """Minus the mean log likelihood of a normal with mean x0 and log deviation x1."""
    log_s = np.clip(x[:, 1], -50, 50)
    return log_s + 0.5 * (p["var"] + (p["mean"] - x[:, 0]) ** 2) * np.exp(-2.0 * log_s)


def _fit_starts(spark, sf_dir):
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(
        (F.avg("value") / 10.0).alias("mean"), (F.var_pop("value") / 100.0).alias("var")
    ).where("var > 0")
    return events.select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("start"), "mean", "var")


def _fit_summary(ends):
    mean, log_sd = F.col("data")[0], F.col("data")[1]
    return ends.select(
        "id", rounded(mean / F.exp(log_sd), 4).alias("mean_to_sd"), rounded(log_sd, 4).alias("log_sd")
    )


@query(
    "hill_climb",
    """WITH m AS (SELECT user_id AS id, avg(value / 10) AS mean, stddev_pop(value / 10) AS sd FROM events GROUP BY user_id HAVING var_pop(value) > 0)
    SELECT id, round(mean / sd, 4) AS mean_to_sd, round(ln(sd), 4) AS log_sd FROM m""",
)
def hill_climb(spark, sf_dir):
    """A quasi-Newton climb per user to the normal fit of that user's values."""
    ends = climb.hill_climb(_fit_starts(spark, sf_dir), _normal_fit_objective, crit=1e-13, max_iter=200)
    return _fit_summary(ends)


@query(
    "hill_climb_in_box",
    """WITH m AS (SELECT user_id AS id, avg(value / 10) AS mean, var_pop(value / 10) AS v FROM events GROUP BY user_id HAVING var_pop(value) > 0),
    b AS (SELECT id, least(mean, 5.0) AS mean, greatest(0, 0.5 * ln(v + pow(mean - least(mean, 5.0), 2))) AS log_sd FROM m)
    SELECT id, round(mean / exp(log_sd), 4) AS mean_to_sd, round(log_sd, 4) AS log_sd FROM b""",
)
def hill_climb_in_box(spark, sf_dir):
    """The same climb kept inside the box [0, 5]."""
    ends = climb.hill_climb(
        _fit_starts(spark, sf_dir), _normal_fit_objective, crit=1e-13, max_iter=200, box=(0.0, 5.0)
    )
    return _fit_summary(ends)
