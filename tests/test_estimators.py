import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempera.functions import counter_rng, logmath
from tempera.operators import distribution, evidence, group_density, moments, starters
from tempera.schema import NEG_INF


def test_column_and_numpy_generators_agree(spark):
    df = counter_rng.with_uniforms(spark.range(5000), F.col("id"), {"a": 3, "b": F.col("id") + 7}, 12).toPandas()
    ids = df["id"].to_numpy()
    assert (df["a"].to_numpy() == counter_rng.uniform(ids, 3, 12)).all()
    assert (df["b"].to_numpy() == counter_rng.uniform(ids, ids + 7, 12)).all()


def test_generator_looks_uniform_and_normal():
    u = counter_rng.uniform(np.arange(200_000), 5, 1)
    assert abs(u.mean() - 0.5) < 0.003 and abs(u.var() - 1 / 12) < 0.001
    assert abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.01
    z = counter_rng.normal(np.zeros(200_000), np.arange(200_000), 2)
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1.0) < 0.01


def test_log_sum_exp_survives_extremes(spark):
    values = [-1.0e300, -2000.0, -700.0, 700.0, 710.0, 710.5]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    out = evidence.log_sum_exp(df, [], F.col("v")).first()
    assert out["n"] == len(values)
    assert out["lse"] == pytest.approx(710.5 + math.log(1 + math.exp(-0.5) + math.exp(-10.5)))
    nothing = evidence.log_sum_exp(df.where("v < -1e299"), [], F.col("v")).first()
    assert nothing["lse"] == -1.0e300


def test_log_arithmetic(spark):
    row = spark.range(1).select(
        logmath.add_logs(F.lit(-1.0e300), F.lit(3.0)).alias("a"),
        logmath.add_scaled_logs(F.lit(2.0), F.lit(800.0), F.lit(3.0), F.lit(799.0)).alias("b"),
    ).first()
    assert row["a"] == 3.0
    assert row["b"] == pytest.approx(800 + math.log(2 + 3 * math.exp(-1)))


def test_chi_square_cdf():
    assert logmath.chi2_cdf(4.0, 2) == pytest.approx(1 - math.exp(-2.0))
    assert logmath.chi2_cdf(1.0, 1) == pytest.approx(math.erf(math.sqrt(0.5)))


@pytest.fixture(scope="module")
def known_evidence(spark):
    """Kernel e**2 times N(1, 1.5) in one dimension, proposal N(0.7, 2): ln evidence is 2."""
    n = 40_000
    z = counter_rng.normal(np.arange(2 * n), 0, 77)
    x = np.where(np.arange(2 * n) < n, 0.7 + 2.0 * z, 1.0 + 1.5 * z)
    frame = spark.createDataFrame(
        [(i, "proposal" if i < n else "posterior", float(v)) for i, v in enumerate(x)], "id long, src string, x double"
    )
    vec = F.array("x")
    return frame.select(
        "id", "src", "x",
        logmath.log_normal_density(vec, [0.7], [[0.25]]).alias("ln_h"),
        (F.lit(2.0) + logmath.log_normal_density(vec, [1.0], [[1 / 2.25]])).alias("ln_k"),
        logmath.log_truncated_normal(vec, [1.0], [[1 / 2.25]], 4.0).alias("ln_t"),
    ).cache()


def test_three_evidence_estimators_find_the_constant(known_evidence):
    bridge = evidence.BridgeDraws(known_evidence)
    root = bridge.root()
    assert root == pytest.approx(2.0, abs=0.02)
    assert abs(bridge.residual([root])[0]) < 1e-7
    region = evidence.region_estimate(known_evidence, evidence.region_cutoff(known_evidence, "id")).first()
    assert region["log_mdd"] == pytest.approx(2.0, abs=0.12)
    posterior = known_evidence.where("src = 'posterior'").withColumn("ln_h", F.col("ln_t"))
    assert evidence.harmonic_mean(posterior).first()["log_mdd"] == pytest.approx(2.0, abs=0.02)


def test_no_proposal_in_region(known_evidence):
    out = evidence.region_estimate(known_evidence, 1.0e6).first()
    assert out["log_mdd"] == -1.0e300 and out["in_proposal"] == 0


def test_bridge_far_from_zero(known_evidence):
    shifted = known_evidence.withColumn("ln_k", F.col("ln_k") + 5000.0)
    assert evidence.BridgeDraws(shifted).root() == pytest.approx(5002.0, abs=0.02)


def test_covariance_matches_numpy(spark):
    x = np.random.default_rng(1).normal(size=(500, 3)) @ np.diag([1.0, 2.0, 0.5])
    df = spark.createDataFrame([(i % 2, [float(v) for v in r]) for i, r in enumerate(x)], "g int, data array<double>")
    cov = moments.covariance(df, "g", 3)
    got = {(r["grp"], r["i"], r["j"]): r["cov"] for r in cov.collect()}
    for g in (0, 1):
        want = np.cov(x[g::2].T, bias=True)
        assert np.allclose([[got[g, i, j] for j in range(3)] for i in range(3)], want)
    blocks = moments.scale_blocks(moments.covariance_factor(cov).collect(), 3)
    assert np.allclose(blocks[1][0] @ blocks[1][0].T, np.cov(x[1::2].T, bias=True))
    split = moments.scale_blocks(moments.covariance_factor(cov).collect(), 3, [[0, 2], [1]])
    assert [b.shape for b in split[0]] == [(3, 2), (3, 1)]
    assert split[0][0][1].tolist() == [0.0, 0.0]


def test_full_precision_density(spark):
    a = np.array([[2.0, 0.3], [0.3, 1.0]])
    df = spark.createDataFrame([([0.5, -1.0],)], "x array<double>")
    got = df.select(logmath.log_normal_density(F.col("x"), [0.1, 0.2], a)).first()[0]
    e = np.array([0.4, -1.2])
    assert got == pytest.approx(-math.log(2 * math.pi) + 0.5 * math.log(np.linalg.det(a)) - 0.5 * e @ a @ e)


def test_mixture_and_inverse_normal(spark):
    df = spark.createDataFrame([([0.2],)], "x array<double>")
    got = df.select(
        logmath.log_normal_mixture(F.col("x"), [math.log(0.4), math.log(0.6)], [[0.0], [1.0]], [[[1.0]], [[4.0]]])
    ).first()[0]
    want = math.log(0.4 * math.exp(-0.02) + 0.6 * 2.0 * math.exp(-0.5 * 4 * 0.64))
    assert got == pytest.approx(want)
    p = spark.createDataFrame([(v,) for v in (0.001, 0.02, 0.3, 0.5, 0.9, 0.999)], "p double")
    back = distribution.with_inverse_normal(p, "p", "z").collect()
    assert all(distribution.normal_cdf(r["z"]) == pytest.approx(r["p"], abs=1e-8) for r in back)


def test_splice(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [9.0, 8.0, 7.0, 6.0])], "a array<double>, b array<double>")
    pick = lambda *k: df.select(logmath.splice(F.col("a"), k[0], F.col("b"), k[1], k[2])).first()[0]
    assert pick(1, 2, 2) == [1.0, 7.0, 6.0, 4.0]
    assert pick(0, 0, 4) == [9.0, 8.0, 7.0, 6.0]
    assert pick(2, 0, 2) == [1.0, 2.0, 9.0, 8.0]


def test_farthest_first_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(200, 2)), rng.normal(size=200)
    df = spark.createDataFrame(
        [(i, float(w[i]), [float(v) for v in x[i]]) for i in range(200)], "id long, weight double, data array<double>"
    )
    pool = sorted(range(200), key=lambda i: -w[i])[:40]
    chosen = [pool[0]]
    while len(chosen) < 4:
        chosen.append(max(pool, key=lambda i: sum(((x[i] - x[c]) ** 2).sum() for c in chosen)))
    assert [r["id"] for r in starters.farthest_first(df, 4).orderBy("pick").collect()] == chosen
    with pytest.raises(starters.TooFewSamples):
        starters.farthest_first(df.limit(2), 4)


def test_farthest_picks_break_ties_and_prune_by_norm(spark):
    rng = np.random.default_rng(8)
    x = np.round(np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(0, 9, (40, 3)), np.tile([20.0, 0, 0], (4, 1)), [[-20.0, 0, 0]] * 3]), 1)
    w = rng.normal(size=len(x))
    df = spark.createDataFrame([(i, float(w[i]), [float(v) for v in r]) for i, r in enumerate(x)], "id long, weight double, data array<double>")
    chosen = [int(max(range(len(x)), key=lambda i: w[i]))]
    while len(chosen) < 7:
        far = [round(float(sum(((r - x[c]) ** 2).sum() for c in chosen)), 9) for r in x]
        chosen.append(max(range(len(x)), key=lambda i: (far[i], -i)))
    assert [r["id"] for r in starters.farthest_first(df, 7, 1.0).orderBy("pick").collect()] == chosen
    picked = starters._Chosen({"data": list(x[chosen[0]]), "id": 0, "weight": 0.0})
    for c in chosen[1:4]:
        picked.add({"data": list(x[c])})
    far = np.array([sum(((r - x[c]) ** 2).sum() for c in chosen[:4]) for r in x])
    for bar in (0.0, far.mean(), far.max()):
        assert (far[(x**2).sum(axis=1) < picked.least_norm(float(bar))] < bar).all()


def test_kmeans_small_inputs(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, 3.0])], "id long, data array<double>")
    assert [r["data"] for r in starters.kmeans_centres(df, 5, seed=1).orderBy("pick").collect()] == [[0.0, 1.0], [2.0, 3.0]]
    assert starters.kmeans_centres(df.limit(0), 3, seed=1).count() == 0
    assert [r["data"] for r in starters.kmeans_centres(df, 1, seed=1).collect()] == [[1.0, 2.0]]


def test_kmeans_finds_separated_centres(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.1, size=(60, 2)) for c in (-3.0, 0.0, 3.0)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, data array<double>")
    got = [r["data"][0] for r in starters.kmeans_centres(df, 3, seed=1).orderBy("pick").collect()]
    assert got == pytest.approx([-3.0, 0.0, 3.0], abs=0.1)


def test_kmeans_takes_most_steps_without_a_scan(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(3000, 3))
    x[:200] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, data array<double>").repartition(3)
    scan, scans, found = starters._lloyd_step, [], []
    monkeypatch.setattr(starters, "_lloyd_step", lambda *a: scans.append(1) or scan(*a))
    for active in (0, 600, 100_000):
        monkeypatch.setattr(starters, "ACTIVE", active, raising=False)
        before = len(scans)
        centres = [r["data"] for r in starters.kmeans_centres(df, 4, 1, 2).orderBy("pick").collect()]
        found.append((len(scans) - before, centres))
    everywhere, some, alone = (n for n, _ in found)
    assert alone == 2 < some < everywhere
    for _, centres in found:
        assert np.allclose(centres, found[0][1], atol=1e-12)
        c = np.array(centres)
        near = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        assert np.allclose(c, [x[near == j].mean(axis=0) for j in range(4)], atol=1e-12)


def test_uniform_draws_cover_the_bin(spark):
    df = spark.range(40).select((F.col("id") % 2).alias("bin"), "id", F.col("id").cast("double").alias("weight"))
    drawn = starters.draw_pool(df, 4000, 9).groupBy("bin", "id").count().toPandas()
    assert len(drawn) == 40 and drawn["count"].between(120, 290).all()


def test_purposes_and_neighbouring_seeds_share_no_number():
    keys, counters = np.arange(50), np.arange(40)
    seen = {}
    for seed in (7, 8, 9):
        for number in range(4):
            for c in counters:
                for u in counter_rng.uniform(keys, int(c) + counter_rng.purpose(number), seed):
                    assert seen.setdefault(u, (seed, number)) == (seed, number)
    assert len(seen) == 3 * 4 * 50 * 40
    with pytest.raises(ValueError):
        counter_rng.purpose(16)


def test_cipher_gives_the_published_answers():
    ones = 0xFFFFFFFF
    lanes = lambda *a: tuple(int(v) for v in counter_rng.cipher(*a))
    assert lanes(0, 0, 0, 0, 20) == (0x6B200159, 0x99BA4EFE)
    assert lanes(ones, ones, ones, ones, 20) == (0x1CB996FC, 0xBB002BE7)
    assert lanes(0, 0, 0, 0, 13) == (0x9D1C5EC6, 0x8BD50731)


def test_streams_neither_alias_nor_overlap():
    keys = np.arange(4096)
    u = np.stack([counter_rng.uniform(keys, c, 1) for c in range(64)], axis=1)
    windows = np.lib.stride_tricks.sliding_window_view(u, 8, axis=1).reshape(-1, 8)
    assert len(np.unique(windows, axis=0)) == len(windows)
    first = {counter_rng.uniform(np.array([k]), 0, s)[0] for k in (0, 1, 7919, 2**32, 2**33 + 1, -1) for s in (0, 1, 2)}
    assert len(first) == 18
    assert counter_rng.uniform(np.array([3]), 2**40, 1)[0] != counter_rng.uniform(np.array([3]), 0, 1)[0]


def test_column_form_with_large_ids_and_counters(spark):
    ids = [0, 5, 2**33 + 5, -7, 2**62]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = [r.u for r in counter_rng.with_uniforms(df, F.col("id"), {"u": F.lit(2**41 + 3)}, 9).collect()]
    assert got == counter_rng.uniform(np.array(ids), 2**41 + 3, 9).tolist()


@pytest.mark.parametrize("size", [20_000, 7])
def test_group_densities_match_dense_algebra(spark, monkeypatch, size):
    monkeypatch.setattr(group_density, "SLICE", size)
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g, d in ((1, 3), (2, 5), (3, 1)):
        x = rng.normal(size=(40, d)) @ rng.normal(size=(d, d)) + g
        rows += [(100 * g + i, g, [float(v) for v in r]) for i, r in enumerate(x)]
        cov, mean = np.cov(x.T, bias=True).reshape(d, d) + 0.1 * np.eye(d), x.mean(axis=0)
        for i, r in enumerate(x):
            q = float((r - mean) @ np.linalg.solve(cov, r - mean))
            want[100 * g + i] = (q, -0.5 * (q + d * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1]))
    df = spark.createDataFrame(rows, "id long, grp long, data array<double>")
    parts = [(moments.covariance(df.where(f"grp = {g}"), "grp", d), moments.mean_vector(df.where(f"grp = {g}"), "grp")) for g, d in ((1, 3), (2, 5), (3, 1))]
    cov, mean = (a.unionByName(b).unionByName(c) for a, b, c in zip(*parts))
    odd = spark.createDataFrame([(900, 1, [1.0]), (901, 2, None), (902, 9, [1.0])], df.schema)
    factors = group_density.group_factors(cov, mean, 0.1)
    got = {r["id"]: r for r in group_density.group_log_density(df.unionByName(odd), factors, 2.0).collect()}
    for i, (q, density) in want.items():
        assert (got[i]["distance"], got[i]["density"]) == pytest.approx((q, density))
        assert (got[i]["truncated"] == NEG_INF) == (q > 2.0) and got[i]["truncated"] != got[i]["density"]
    assert got[900]["density"] is None and got[901]["density"] is None and 902 not in got
    flat = spark.createDataFrame([(i, 1, [float(i), float(i)]) for i in range(5)], df.schema)
    none = group_density.group_factors(moments.covariance(flat, "grp", 2).withColumn("cov", -F.col("cov")), moments.mean_vector(flat, "grp"))
    assert none.first()["factor"] is None
    assert all(r["density"] is None for r in group_density.group_log_density(flat, none).collect())
