"""Log-domain aggregates and evidence estimators over event values."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tempera.catalog.registry import query, rounded, table
from tempera.functions import logmath
from tempera.functions.logmath import HALF_LOG_2PI
from tempera.operators import evidence, selection
from tempera.plans.adapters import evidence_draws

DRAWS = f"""
d AS (SELECT event_id AS id, CASE WHEN event_type IN ('view', 'click') THEN 'proposal' ELSE 'posterior' END AS src,
             {-HALF_LOG_2PI - math.log(1.4)!r}::DOUBLE - 0.5 * ((ln(value) - 3.3) / 1.4) * ((ln(value) - 3.3) / 1.4) AS ln_h,
             2.5::DOUBLE - 0.5 * ((ln(value) - 3.5) / 1.2) * ((ln(value) - 3.5) / 1.2) AS ln_k
      FROM events WHERE value > 0)"""


@query(
    "add_logs",
    f"""WITH {DRAWS} SELECT id,
      round(greatest(ln_h, ln_k) + ln(1 + exp(-abs(ln_h - ln_k))), 9) AS sum_log,
      round(greatest(ln_h, ln_k) + ln(0.25 * exp(ln_h - greatest(ln_h, ln_k)) + 0.75 * exp(ln_k - greatest(ln_h, ln_k))), 9) AS scaled_log
    FROM d""",
)
def add_logs(spark, sf_dir):
    h, k = F.col("ln_h"), F.col("ln_k")
    return evidence_draws(spark, sf_dir).select(
        "id", rounded(logmath.add_logs(h, k), 9).alias("sum_log"),
        rounded(logmath.add_scaled_logs(F.lit(0.25), h, F.lit(0.75), k), 9).alias("scaled_log"),
    )


@query(
    "log_sum_exp",
    """WITH s AS (SELECT o_orderpriority AS level, -o_totalprice / 100.0::DOUBLE AS w FROM orders),
    m AS (SELECT level, max(w) AS m FROM s GROUP BY level)
    SELECT s.level, round(max(m) + ln(sum(exp(w - m))), 6) AS lse, count(*) AS n
    FROM s JOIN m ON s.level = m.level GROUP BY s.level""",
)
def log_sum_exp(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("level"), "o_totalprice")
    out = evidence.log_sum_exp(orders, ["level"], -F.col("o_totalprice") / 100.0)
    return out.select("level", rounded("lse").alias("lse"), "n")


@query(
    "evidence_harmonic_mean",
    f"""WITH {DRAWS}, p AS (SELECT ln_h - ln_k AS v FROM d WHERE src = 'posterior'), m AS (SELECT max(v) AS m FROM p)
    SELECT round(ln(count(*)) - (max(m) + ln(sum(exp(v - m)))), 6) AS log_mdd, count(*) AS n FROM p, m""",
)
def evidence_harmonic_mean(spark, sf_dir):
    draws = evidence_draws(spark, sf_dir).where("src = 'posterior'")
    return evidence.harmonic_mean(draws).select(rounded("log_mdd").alias("log_mdd"), "n")


def _region_sql(cut_kernel: str, cut_proposal: str) -> str:
    return f"""WITH {DRAWS},
    c AS (SELECT {cut_kernel} AS l1, {cut_proposal} AS l2),
    s AS (SELECT d.*, ln_k >= l1 AND ln_h <= l2 AS inside FROM d, c),
    m AS (SELECT max(ln_h - ln_k) AS m FROM s WHERE inside AND src = 'posterior'),
    a AS (SELECT count(*) FILTER (WHERE src = 'proposal' AND inside) AS in_proposal,
                 count(*) FILTER (WHERE src = 'posterior' AND inside) AS in_posterior,
                 count(*) FILTER (WHERE src = 'proposal') AS n, count(*) FILTER (WHERE src = 'posterior') AS mm,
                 max(m) + ln(sum(CASE WHEN src = 'posterior' AND inside THEN exp(ln_h - ln_k - m) END)) AS lse
          FROM s, m)
    SELECT round(ln(in_proposal / n::DOUBLE) - (lse - ln(mm)), 6) AS log_mdd,
           CAST(in_proposal AS BIGINT) AS in_proposal, CAST(in_posterior AS BIGINT) AS in_posterior,
           round(lse - ln(mm), 6) AS log_integral FROM a"""


_TOP30 = "(SELECT min(ln_k) FROM (SELECT ln_k FROM d WHERE src = 'proposal' ORDER BY ln_k DESC LIMIT 30))"
_DECILE = """(SELECT ln_k FROM (SELECT ln_k, row_number() OVER (ORDER BY ln_k DESC) AS r FROM d WHERE src = 'posterior')
              WHERE r = (SELECT count(*) // 10 FROM d WHERE src = 'posterior'))"""


def _region(out):
    return out.select(
        rounded("log_mdd").alias("log_mdd"), "in_proposal", "in_posterior", rounded("log_integral").alias("log_integral")
    )


@query("evidence_region", _region_sql(f"least({_TOP30}, {_DECILE})", "1e300::DOUBLE"))
def evidence_region(spark, sf_dir):
    """Region estimator with the data-driven kernel cut-off."""
    draws = evidence_draws(spark, sf_dir)
    return _region(evidence.region_estimate(draws, evidence.region_cutoff(draws, "id")))


@query("evidence_region_two_cuts", _region_sql("0.5::DOUBLE", "-1.5::DOUBLE"))
def evidence_region_two_cuts(spark, sf_dir):
    return _region(evidence.region_estimate(evidence_draws(spark, sf_dir), 0.5, -1.5))


@query("evidence_region_proposal_cut", _region_sql("-1e301::DOUBLE", "-1.5::DOUBLE"))
def evidence_region_proposal_cut(spark, sf_dir):
    return _region(evidence.region_estimate(evidence_draws(spark, sf_dir), -1.0e300, -1.5))


@query("evidence_region_uncut", _region_sql("-1e301::DOUBLE", "1e301::DOUBLE"))
def evidence_region_uncut(spark, sf_dir):
    return _region(evidence.region_estimate(evidence_draws(spark, sf_dir), -1.0e300, 1.0e300))


def _delta(r: str) -> str:
    """Bridge residual at trial value ``r`` as scalar subqueries over table x(p, v), c(n, m)."""

    def side(flag: str, arg: str, rho: str) -> str:
        f = f"CASE WHEN {arg} < 0 THEN -ln(1 + {rho} * exp({arg})) ELSE -({arg}) - ln(exp(-({arg})) + {rho}) END"
        return f"(SELECT ln(sum(exp({f}))) FROM x, c WHERE {flag})"

    return f"({side('p', f'v + {r}', 'n / m')} - {side('NOT p', f'-v - {r}', 'm / n')})"


_X = f"""{DRAWS}, x AS (SELECT src = 'proposal' AS p, ln_h - ln_k AS v FROM d),
c AS (SELECT count(*) FILTER (WHERE p)::DOUBLE AS n, count(*) FILTER (WHERE NOT p)::DOUBLE AS m FROM x)"""

TRIALS = [k / 4.0 for k in range(-8, 25)]


@query(
    "bridge_residual_grid",
    f"""WITH {_X}, g(r) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in TRIALS)})
    SELECT r, round({_delta('g.r')}, 6) AS residual FROM g""",
)
def bridge_residual_grid(spark, sf_dir):
    """Residuals at 33 trial values from one scan."""
    bridge = evidence.BridgeDraws(evidence_draws(spark, sf_dir))
    rows = list(zip(TRIALS, bridge.residual(TRIALS)))
    return spark.createDataFrame(rows, "r double, residual double").select("r", rounded("residual").alias("residual"))


@query(
    "evidence_bridge",
    f"""WITH RECURSIVE {_X},
    bis(lo, hi, it) AS (SELECT -1000.0::DOUBLE, 1000.0::DOUBLE, 0 UNION ALL
      SELECT CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END, it + 1
      FROM (SELECT lo, hi, it, (lo + hi) / 2 AS mid, {_delta('(lo + hi) / 2')} > 0 AS up FROM bis WHERE it < 60))
    SELECT round((lo + hi) / 2, 5) AS log_mdd FROM bis WHERE it = 60""",
)
def evidence_bridge(spark, sf_dir):
    root = evidence.BridgeDraws(evidence_draws(spark, sf_dir)).root(tolerance=1e-11)
    return spark.createDataFrame([(root,)], "log_mdd double").select(rounded("log_mdd", 5).alias("log_mdd"))


@query(
    "kth_largest_kernel",
    f"""WITH {DRAWS} SELECT round({_TOP30}, 9) AS best30, round({_DECILE}, 9) AS decile""",
)
def kth_largest_kernel(spark, sf_dir):
    """The 30th best proposal kernel and the top-decile posterior kernel, the latter by rank selection."""
    draws = evidence_draws(spark, sf_dir)
    posterior = draws.where("src = 'posterior'")
    m = posterior.count()
    pair = (
        selection.kth_largest(draws.where("src = 'proposal'"), "ln_k", "id", 30),
        selection.kth_largest(posterior, "ln_k", "id", m // 10),
    )
    return spark.createDataFrame([pair], "best30 double, decile double").select(
        rounded("best30", 9).alias("best30"), rounded("decile", 9).alias("decile")
    )


@query(
    "running_max",
    """SELECT event_id AS id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS best FROM events""",
)
def running_max(spark, sf_dir):
    """Best value each chain has seen so far."""
    from tempera.operators.walks import running_max as walk

    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return walk(events, "user_id", ["ts", "event_id"], "value").select(
        F.col("event_id").alias("id"), F.col("running").alias("best")
    )


@query(
    "burn_in_and_thin",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS it FROM events)
    SELECT event_id AS id, user_id AS chain, (it - 10) // 3 AS draw, round(value, 6) AS value
    FROM r WHERE it >= 10 AND (it - 10) % 3 = 2""",
)
def burn_in_and_thin(spark, sf_dir):
    """Drop ten draws of each chain, then keep every third."""
    from tempera.operators.walks import thin

    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    kept = thin(events, "user_id", ["ts", "event_id"], burn_in=10, every=3)
    return kept.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("chain"), "draw", rounded("value").alias("value")
    )


@query(
    "acceptance_rate",
    """WITH r AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT user_id AS chain, round(avg(CASE WHEN value <> before THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS rate, count(*) AS n
    FROM r WHERE before IS NOT NULL GROUP BY user_id""",
)
def acceptance_rate(spark, sf_dir):
    """Share of steps at which a chain moved."""
    from tempera.operators.walks import acceptance

    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return acceptance(events, "user_id", ["ts", "event_id"], "value").select(
        F.col("user_id").alias("chain"), rounded("rate", 9).alias("rate"), "n"
    )
