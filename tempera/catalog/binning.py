"""Store, ranking, binning and jump queries over orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tempera.catalog.registry import query, rounded
from tempera.operators import binning, energy, ranking, starters
from tempera.operators.evidence import log_sum_exp
from tempera.operators.store import SampleStore
from tempera.plans.adapters import LEVELS, order_samples

BINS = 10
FILE_SAMPLES = 1000
FREED = 2

SAMPLES = """
s AS (SELECT o_orderkey AS id, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS level,
             -o_totalprice / 10000.0::DOUBLE AS weight, o_totalprice / 10000.0::DOUBLE AS energy
      FROM orders)"""

RANKED = SAMPLES + f""",
r0 AS (SELECT level, id, energy, weight,
              row_number() OVER (PARTITION BY level ORDER BY energy, id) - 1 AS rn,
              count(*) OVER (PARTITION BY level) AS n FROM s),
r1 AS (SELECT *, CAST(ceil(n / {BINS}.0::DOUBLE) AS BIGINT) AS chunk FROM r0),
binned AS (SELECT *, least(rn // chunk,
              (CASE WHEN (n - 1) % chunk = 0 AND n - 1 >= chunk THEN (n - 1) // chunk
                    ELSE CAST(ceil(n / chunk::DOUBLE) AS BIGINT) END) - 1) AS bin FROM r1),
bounds AS (SELECT level, bin, min(energy) AS lo, max(energy) AS hi, count(*) AS n, max(chunk) AS chunk
           FROM binned GROUP BY level, bin)"""

def threefry_steps(key: str, counter: str, seed: int, out: str) -> list[str]:
    """The counter generator in SQL: select lists, each over the rows of the one before."""
    # Fixed values of the published cipher.
    mask, parity, rotations, rounds = 4294967295, 466688986, (13, 15, 26, 6, 17, 29, 16, 24), 13
    k, c = f"CAST({key} AS BIGINT)", f"CAST({counter} AS BIGINT)"
    steps = [
        f"SELECT *, {k} & {mask} AS k0_, ({k} >> 32) & {mask} AS k1_, {c} AS c_",
        f"SELECT * EXCLUDE (c_), xor(xor(k0_, k1_), {parity}) AS k2_, ((c_ & {mask}) + k0_) & {mask} AS x_, "
        f"(((c_ >> 32) & {mask}) * 65536 + {seed} + k1_) & {mask} AS y_",
    ]
    for i in range(rounds):
        r = rotations[i % 8]
        x = f"((x_ + y_) & {mask})"
        y = f"xor(((y_ << {r}) & {mask}) | (y_ >> {32 - r}), {x})"
        if i % 4 == 3:
            j = i // 4 + 1
            x, y = f"(({x} + k{j % 3}_) & {mask})", f"(({y} + k{(j + 1) % 3}_ + {j}) & {mask})"
        steps.append(f"SELECT * REPLACE ({x} AS x_, {y} AS y_)")
    last = f"SELECT * EXCLUDE (k0_, k1_, k2_, x_, y_), ((x_ * 1048576 + (y_ >> 12)) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS {out}"
    return [*steps, last]


def uniforms(name: str, source: str, key: str, counter: str, seed: int, out: str) -> str:
    """The generator as a chain of common table expressions: rows of ``source`` get a uniform ``out``."""
    steps = threefry_steps(key, counter, seed, out)
    names = [f"{name}_{i}" for i in range(len(steps) - 1)] + [name]
    return ",\n".join(f"{n} AS ({s} FROM {f})" for n, s, f in zip(names, steps, [source, *names]))


@query(
    "bin_equal_count",
    f"""WITH {RANKED},
    top AS (SELECT level, bin, arg_max(id, (weight, -id)) AS best_id FROM binned GROUP BY level, bin),
    mx AS (SELECT level, bin, max(weight) AS m FROM binned GROUP BY level, bin),
    l AS (SELECT b.level, b.bin, max(m) + ln(sum(exp(weight - m))) AS lse
          FROM binned b JOIN mx ON b.level = mx.level AND b.bin = mx.bin GROUP BY b.level, b.bin)
    SELECT CAST(bounds.level AS BIGINT) AS level, CAST(bounds.bin AS BIGINT) AS bin, n,
           round(lo, 6) AS lo, round(hi, 6) AS hi, best_id, round(lse, 6) AS lse
    FROM bounds JOIN top USING (level, bin) JOIN l USING (level, bin)""",
)
def bin_equal_count(spark, sf_dir):
    samples = order_samples(spark, sf_dir)
    bounds = binning.equal_count_bounds(samples, BINS)
    binned = binning.assign_equal_count(samples, bounds)
    lse = log_sum_exp(binned, ["level", "bin"], F.col("weight")).drop("n")
    # A bin's first sample in energy order is its best one.
    return lse.join(F.broadcast(bounds), ["level", "bin"]).select(
        F.col("level").cast("long"), F.col("bin").cast("long"), "n", rounded("lo").alias("lo"),
        rounded("hi").alias("hi"), F.col("lo_id").alias("best_id"), rounded("lse").alias("lse"),
    )


@query(
    "bin_lookup",
    f"""WITH {RANKED},
    looked AS (SELECT s.level, s.id, s.energy,
        greatest(0, (SELECT count(*) FROM bounds b WHERE b.level = s.level + 1 AND b.lo <= s.energy) - 1) AS bin
        FROM s)
    SELECT CAST(level AS BIGINT) AS level, CAST(bin AS BIGINT) AS bin, count(*) AS n,
           round(min(energy), 6) AS lo, round(max(energy), 6) AS hi
    FROM looked GROUP BY level, bin""",
)
def bin_lookup(spark, sf_dir):
    """Every sample's bin among the bounds of the level above; without bounds it is bin 0."""
    samples = order_samples(spark, sf_dir)
    bounds = binning.equal_count_bounds(samples, BINS)
    looked = binning.attach_bounds(samples, bounds, F.col("level") + 1).select(
        "level", (-F.col("weight")).alias("energy"),
        binning.bin_index(-F.col("weight"), F.col("lower_bounds")).alias("bin"),
    )
    return looked.groupBy(F.col("level").cast("long"), F.col("bin").cast("long")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.min("energy")).alias("lo"), rounded(F.max("energy")).alias("hi")
    ).select("level", "bin", "n", "lo", "hi")


@query(
    "bin_geometric",
    f"""WITH RECURSIVE {SAMPLES},
    e AS (SELECT level, min(energy) AS a, max(energy) AS z FROM s GROUP BY level),
    bis(level, lo, hi, it) AS (
      SELECT level, 0.0::DOUBLE, pow(z - a, 1.0 / {BINS - 2}) * 1.000000000001, 0 FROM e
      UNION ALL
      SELECT b.level,
        CASE WHEN list_sum(list_transform(range(1, {BINS - 1}), lambda i: pow((b.lo + b.hi) / 2, i))) < e.z - e.a
             THEN (b.lo + b.hi) / 2 ELSE b.lo END,
        CASE WHEN list_sum(list_transform(range(1, {BINS - 1}), lambda i: pow((b.lo + b.hi) / 2, i))) < e.z - e.a
             THEN b.hi ELSE (b.lo + b.hi) / 2 END, b.it + 1
      FROM bis b JOIN e ON b.level = e.level WHERE b.it < 80),
    g AS (SELECT level, (lo + hi) / 2 AS g FROM bis WHERE it = 80),
    bounds AS (
      SELECT e.level, j AS bin,
        CASE WHEN j = {BINS - 2} THEN z WHEN j = {BINS - 1} THEN z + pow(g, {BINS - 1})
             ELSE a + coalesce(list_sum(list_transform(range(1, j + 1), lambda i: pow(g, i))), 0) END AS lo
      FROM e JOIN g ON e.level = g.level, range({BINS}) t(j)),
    looked AS (SELECT s.level, s.energy,
      greatest(0, (SELECT count(*) FROM bounds b WHERE b.level = s.level AND b.lo <= s.energy) - 1) AS bin FROM s),
    c AS (SELECT level, bin, count(*) AS n FROM looked GROUP BY level, bin)
    SELECT CAST(b.level AS BIGINT) AS level, CAST(b.bin AS BIGINT) AS bin, round(b.lo, 6) AS lo,
           coalesce(c.n, 0) AS n FROM bounds b LEFT JOIN c ON b.level = c.level AND b.bin = c.bin""",
)
def bin_geometric(spark, sf_dir):
    samples = order_samples(spark, sf_dir)
    bounds = binning.geometric_bounds(samples, BINS)
    counts = binning.assign_bins(samples, bounds).groupBy("level", "bin").agg(F.count(F.lit(1)).alias("n"))
    return bounds.join(counts, ["level", "bin"], "left").select(
        F.col("level").cast("long"), F.col("bin").cast("long"), rounded("lo").alias("lo"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


ADAPTIVE_WIDTH = 3.0


@query(
    "bin_adaptive",
    f"""WITH RECURSIVE {SAMPLES},
    r AS (SELECT level, energy, row_number() OVER (PARTITION BY level ORDER BY energy, id) - 1 AS rn,
                 count(*) OVER (PARTITION BY level) AS n FROM s),
    walk(level, bin, start, step, n) AS (
      SELECT level, -1::BIGINT, 0::BIGINT, 0::BIGINT, max(n) FROM r GROUP BY level
      UNION ALL
      SELECT level, bin + 1, start + step,
        (SELECT CASE WHEN start + step + st = n - 1 THEN st + 1 ELSE greatest(st, 1) END
         FROM (SELECT coalesce(
                 (SELECT max(CASE WHEN c.st <= 1 OR hi.energy - lo.energy <= {ADAPTIVE_WIDTH} THEN c.st END)
                  FROM (SELECT CAST(floor(first_step / pow(2, j)) AS BIGINT) AS st
                        FROM (SELECT CASE WHEN start + step + CAST(ceil(n / {BINS}.0::DOUBLE) AS BIGINT) < n
                                          THEN CAST(ceil(n / {BINS}.0::DOUBLE) AS BIGINT)
                                          ELSE n - (start + step) - 1 END AS first_step) f, range(40) t(j)) c
                  JOIN r hi ON hi.level = walk.level AND hi.rn = start + step + c.st
                  JOIN r lo ON lo.level = walk.level AND lo.rn = start + step
                  WHERE c.st >= 1), 0) AS st) q),
        n
      FROM walk WHERE start + step < n)
    SELECT CAST(w.level AS BIGINT) AS level, w.bin, round(r.energy, 6) AS lo, least(w.step, w.n - w.start) AS n
    FROM walk w JOIN r ON r.level = w.level AND r.rn = w.start WHERE w.bin >= 0""",
)
def bin_adaptive(spark, sf_dir):
    bounds = binning.adaptive_bounds(order_samples(spark, sf_dir), BINS, ADAPTIVE_WIDTH)
    return bounds.select(F.col("level").cast("long"), F.col("bin").cast("long"), rounded("lo").alias("lo"), "n")


LADDER = energy.temperatures(LEVELS, 1.0, 60.0)


@query(
    "bin_width_rule",
    f"""WITH {SAMPLES},
    t(level, here, above) AS (VALUES {', '.join(f'({i + 1}, {a!r}::DOUBLE, {b!r}::DOUBLE)' for i, (a, b) in enumerate(zip(LADDER[:-1], LADDER[1:])))}),
    e AS (SELECT level, min(energy) AS low FROM s GROUP BY level),
    b AS (SELECT s.level, energy, CAST(floor((energy - low) / (-ln(0.3::DOUBLE) / (1.0 / here - 1.0 / above))) AS BIGINT) AS bin
          FROM s JOIN t ON s.level = t.level JOIN e ON s.level = e.level)
    SELECT CAST(level AS BIGINT) AS level, bin, count(*) AS n, round(min(energy), 6) AS lo, round(max(energy), 6) AS hi
    FROM b GROUP BY level, bin""",
)
def bin_width_rule(spark, sf_dir):
    binned = binning.width_rule_bins(order_samples(spark, sf_dir), LADDER, 0.3)
    return binned.groupBy(F.col("level").cast("long"), F.col("bin").cast("long")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.min("energy")).alias("lo"), rounded(F.max("energy")).alias("hi")
    )


@query(
    "ee_jump_acceptance",
    f"""WITH {RANKED},
    t(level, temp) AS (VALUES {', '.join(f'({i}, {a!r}::DOUBLE)' for i, a in enumerate(LADDER))}),
    x AS (SELECT level, id, energy,
            greatest(0, (SELECT count(*) FROM bounds b WHERE b.level = binned.level + 1 AND b.lo <= binned.energy) - 1) AS bin
          FROM binned WHERE level < {LEVELS - 1}),
    {uniforms('u0', 'x', 'id', '0', 11, 'a')}, {uniforms('u1', 'u0', 'id', '1', 11, 'b')}, {uniforms('u2', 'u1', 'id', '2', 11, 'c')},
    p AS (SELECT u2.*, bo.bin * bo.chunk + CAST(floor(b * bo.n) AS BIGINT) AS pick
          FROM u2 JOIN bounds bo ON bo.level = u2.level + 1 AND bo.bin = u2.bin),
    j AS (SELECT p.level, a > 0.3 AS attempt,
                 a > 0.3 AND ln(c) <= (p.energy - y.energy) / t0.temp + (y.energy - p.energy) / t1.temp AS ok,
                 p.energy AS ex, y.energy AS ey
          FROM p JOIN binned y ON y.level = p.level + 1 AND y.rn = p.pick
          JOIN t t0 ON t0.level = p.level JOIN t t1 ON t1.level = p.level + 1)
    SELECT CAST(level AS BIGINT) AS level, count(*) AS n, count(*) FILTER (WHERE attempt) AS attempts,
           count(*) FILTER (WHERE ok) AS accepted,
           round(avg(CASE WHEN ok THEN ey ELSE ex END), 6) AS mean_energy_after
    FROM j GROUP BY level""",
)
def ee_jump_acceptance(spark, sf_dir):
    """One cross-level jump attempt for every order below the top level."""
    binned = binning.equal_count_ranked(order_samples(spark, sf_dir), BINS)
    bounds = binned.groupBy("level", "bin").agg(
        F.min("energy").alias("lo"), F.max("energy").alias("hi"),
        F.count(F.lit(1)).alias("n"), F.max("chunk").alias("chunk"),
    )
    jumps = energy.propose_jumps(binned, bounds, LADDER, 0.3, seed=11)
    after = F.when(F.col("accepted"), F.col("energy_y")).otherwise(F.col("energy"))
    return jumps.groupBy(F.col("level").cast("long")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("attempt").alias("attempts"),
        F.count_if("accepted").alias("accepted"), rounded(F.avg(after)).alias("mean_energy_after"),
    )


def _top_sql(direction: str) -> str:
    return f"""WITH {SAMPLES},
    r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY weight {direction}, id) AS rank FROM s)
    SELECT CAST(level AS BIGINT) AS level, rank, id, round(weight, 6) AS weight FROM r WHERE rank <= 20"""


def _top(df):
    return df.select(F.col("level").cast("long"), "rank", "id", rounded("weight").alias("weight"))


@query("topk_most_weight", _top_sql("DESC"))
def topk_most_weight(spark, sf_dir):
    return _top(ranking.k_most_weight(order_samples(spark, sf_dir), 20, ["level"]))


@query("topk_least_weight", _top_sql("ASC"))
def topk_least_weight(spark, sf_dir):
    return _top(ranking.k_least_weight(order_samples(spark, sf_dir), 20, ["level"]))


@query(
    "argmax_weight",
    f"""WITH {SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY weight DESC, id) AS k FROM s)
    SELECT CAST(level AS BIGINT) AS level, id, round(weight, 6) AS weight FROM r WHERE k = 1""",
)
def argmax_weight(spark, sf_dir):
    best = ranking.most_weight(order_samples(spark, sf_dir), ["level"], [])
    return best.select(F.col("level").cast("long"), "id", rounded("weight").alias("weight"))


@query(
    "argmin_weight",
    f"""WITH {SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY weight, id) AS k FROM s)
    SELECT CAST(level AS BIGINT) AS level, id, round(weight, 6) AS weight FROM r WHERE k = 1""",
)
def argmin_weight(spark, sf_dir):
    worst = ranking.least_weight(order_samples(spark, sf_dir), ["level"], [])
    return worst.select(F.col("level").cast("long"), "id", rounded("weight").alias("weight"))


@query(
    "best_pool",
    f"""WITH {SAMPLES} SELECT id, CAST(level AS BIGINT) AS level, round(weight, 6) AS weight
    FROM s ORDER BY weight DESC, id LIMIT 100""",
)
def best_pool(spark, sf_dir):
    """The 100 best samples of the whole store, lowest-energy bins first."""
    return ranking.k_most_weight(order_samples(spark, sf_dir), 100).select(
        "id", F.col("level").cast("long"), rounded("weight").alias("weight")
    )


@query(
    "kth_best_start",
    f"""WITH {SAMPLES} SELECT id, CAST(level AS BIGINT) AS level, round(weight, 6) AS weight
    FROM s ORDER BY weight DESC, id LIMIT 1 OFFSET 29""",
)
def kth_best_start(spark, sf_dir):
    return starters.kth_best_sample(order_samples(spark, sf_dir), 30).select(
        "id", F.col("level").cast("long"), rounded("weight").alias("weight")
    )


@query(
    "best_start",
    f"""WITH {SAMPLES} SELECT id, CAST(level AS BIGINT) AS level, round(weight, 6) AS weight
    FROM s ORDER BY weight DESC, id LIMIT 1""",
)
def best_start(spark, sf_dir):
    return starters.best_sample(order_samples(spark, sf_dir)).select(
        "id", F.col("level").cast("long"), rounded("weight").alias("weight")
    )


@query(
    "random_start_from_k_best",
    f"""WITH {SAMPLES}, k AS (SELECT * FROM s ORDER BY weight DESC, id LIMIT 50),
    {uniforms('u', 'k', 'id', '0', 17, 'a')}
    SELECT id, CAST(level AS BIGINT) AS level, round(weight, 6) AS weight FROM u ORDER BY a, id LIMIT 1""",
)
def random_start_from_k_best(spark, sf_dir):
    return starters.pick_from_k_best(order_samples(spark, sf_dir), 50, 17).select(
        "id", F.col("level").cast("long"), rounded("weight").alias("weight")
    )


@query(
    "random_start_from_pool",
    f"""WITH {RANKED}, z AS (SELECT DISTINCT level FROM binned),
    {uniforms('u0', 'z', 'level', '0', 23, 'a')}, {uniforms('u1', 'u0', 'level', '1', 23, 'b')},
    c AS (SELECT level, bin, count(*) AS c,
                 coalesce(sum(count(*)) OVER (PARTITION BY level ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                 sum(count(*)) OVER (PARTITION BY level) AS total
          FROM binned GROUP BY level, bin),
    chosen AS (SELECT c.level, c.bin, CAST(floor(u1.b * c.c) AS BIGINT) AS pick FROM c JOIN u1 ON u1.level = c.level
               WHERE floor(u1.a * least(1000, total)) >= before AND floor(u1.a * least(1000, total)) < before + c),
    inside AS (SELECT b.*, row_number() OVER (PARTITION BY b.level ORDER BY id) - 1 AS k
               FROM binned b JOIN chosen ON b.level = chosen.level AND b.bin = chosen.bin)
    SELECT id, CAST(inside.level AS BIGINT) AS level, CAST(inside.bin AS BIGINT) AS bin, round(weight, 6) AS weight
    FROM inside JOIN chosen ON inside.level = chosen.level AND inside.k = chosen.pick""",
)
def random_start_from_pool(spark, sf_dir):
    """A start for every level."""
    binned = binning.equal_count_bins(order_samples(spark, sf_dir), BINS).select("level", "bin", "id", "weight")
    return starters.start_from_pool(binned, 1000, 23, ["level"]).select(
        "id", F.col("level").cast("long"), F.col("bin").cast("long"), rounded("weight").alias("weight")
    )


@query(
    "random_draw_pool",
    f"""WITH {RANKED},
    b AS (SELECT level, bin, count(*) AS n FROM binned GROUP BY level, bin),
    picks AS (SELECT level, bin, n, pick, (CAST(level AS BIGINT) << 32) | bin AS k FROM b, range(500) t(pick)),
    {uniforms('u', 'picks', 'k', 'pick', 29, 'a')},
    inside AS (SELECT level, bin, id, weight, row_number() OVER (PARTITION BY level, bin ORDER BY id) - 1 AS row FROM binned)
    SELECT CAST(u.level AS BIGINT) AS level, CAST(u.bin AS BIGINT) AS bin, u.pick, i.id, round(i.weight, 6) AS weight
    FROM u JOIN inside i ON i.level = u.level AND i.bin = u.bin AND i.row = CAST(floor(u.a * u.n) AS BIGINT)""",
)
def random_draw_pool(spark, sf_dir):
    """500 uniform picks with replacement from every stored bin of every level, read by file and row."""
    binned = binning.equal_count_bins(order_samples(spark, sf_dir), BINS)
    store = SampleStore.in_shared_folder(spark, f"pool-{uuid.uuid4().hex}")
    store.deposit_in_order(binned.select("id", F.array(-F.col("weight")).alias("data"), "weight", "level", "bin"), "id")
    return store.draw_pool(500, 29).select(
        F.col("level").cast("long"), F.col("bin").cast("long"), F.col("pick").cast("long"), "id", rounded("weight").alias("weight")
    )


@query(
    "level_bin_counts",
    f"""WITH {RANKED} SELECT CAST(level AS BIGINT) AS level, CAST(bin AS BIGINT) AS bin, count(*) AS n,
           CAST(ceil(count(*) / {FILE_SAMPLES}.0::DOUBLE) AS BIGINT) AS files, count(*) // {FILE_SAMPLES} AS full_files
    FROM binned GROUP BY level, bin""",
)
def level_bin_counts(spark, sf_dir):
    """Samples, files and files filled to capacity of every bin, from a store after compaction."""
    store = _filled_store(spark, sf_dir)
    for level in range(LEVELS):
        store.compact(level)
    return store.files().groupBy(F.col("level").cast("long"), F.col("bin").cast("long")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"), F.count_if("full").alias("full_files")
    )


def _filled_store(spark, sf_dir):
    store = SampleStore.in_shared_folder(spark, f"orders-{uuid.uuid4().hex}", capacity=FILE_SAMPLES)
    binned = binning.equal_count_bins(order_samples(spark, sf_dir), BINS)
    store.deposit(binned.select("id", F.array(-F.col("weight")).alias("data"), "weight", "level", "bin"))
    return store


@query(
    "store_level_scan",
    f"""WITH {RANKED} SELECT id, CAST(bin AS BIGINT) AS bin, round(energy, 6) AS x, round(weight, 6) AS weight
    FROM binned WHERE level = 3""",
)
def store_level_scan(spark, sf_dir):
    store = _filled_store(spark, sf_dir)
    return store.scan(3).select("id", F.col("bin").cast("long"), rounded(F.col("data")[0]).alias("x"), rounded("weight").alias("weight"))


@query(
    "store_after_drop",
    f"""WITH {RANKED} SELECT CAST(level AS BIGINT) AS level, count(DISTINCT bin) AS bins, count(*) AS n
    FROM binned WHERE level <> 4 GROUP BY level""",
)
def store_after_drop(spark, sf_dir):
    """Bins and samples per level once the hottest level has been freed."""
    store = _filled_store(spark, sf_dir)
    store.drop_level(4)
    return store.scan().groupBy(F.col("level").cast("long")).agg(
        F.countDistinct("bin").alias("bins"), F.count(F.lit(1)).alias("n")
    )


@query(
    "empty_levels",
    f"""WITH {SAMPLES} SELECT CAST(l AS BIGINT) AS level,
           l = {FREED} OR NOT EXISTS (SELECT 1 FROM s WHERE s.level = l) AS empty
    FROM range({LEVELS + 2}) t(l)""",
)
def empty_levels(spark, sf_dir):
    """Which levels of a store hold no sample: one that has been freed, and the two above the ladder."""
    store = _filled_store(spark, sf_dir)
    store.drop_level(FREED)
    rows = [(level, store.is_empty(level)) for level in range(LEVELS + 2)]
    return spark.createDataFrame(rows, "level long, empty boolean")


@query(
    "tempered_log_ratio",
    f"""WITH {SAMPLES}, t(level, temp) AS (VALUES {', '.join(f'({i}, {a!r}::DOUBLE)' for i, a in enumerate(LADDER))}),
    m AS (SELECT level, min(energy) AS best FROM s GROUP BY level)
    SELECT s.id, CAST(s.level AS BIGINT) AS level, round(s.weight / temp, 9) AS tempered,
           round((best - s.energy) / temp, 9) AS log_ratio
    FROM s JOIN t ON s.level = t.level JOIN m ON m.level = s.level""",
)
def tempered_log_ratio(spark, sf_dir):
    """Tempered log posterior of every sample, and its log ratio to the level's best."""
    samples = order_samples(spark, sf_dir)
    best = samples.groupBy("level").agg(F.min(-F.col("weight")).alias("best"))
    t = F.element_at(F.array(*[F.lit(v) for v in LADDER]), F.col("level") + 1)
    return samples.join(best, "level").select(
        "id", F.col("level").cast("long"), rounded(energy.tempered(F.col("weight"), t), 9).alias("tempered"),
        rounded(energy.log_ratio(-F.col("weight"), F.col("best"), t), 9).alias("log_ratio"),
    )
