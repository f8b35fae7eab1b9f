import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tempera.operators import chains, climb, energy, tuning
from tempera.operators.binning import assign_equal_count, equal_count_bounds
from tempera.operators.starters import draw_pool
from tempera.operators.store import SampleStore
from tempera.plans.ladder import continue_ladder, pool_from_rows, run_ladder
from tempera.plans.settings import RunSettings, parse_settings
from tempera.plans.staging import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import test modules


def normal(x, p):
    return -0.5 * ((x - 3.0) / 2.0).__pow__(2).sum(axis=1)


def two_wells(x, p):
    """Equal normals at -5 and 5 with deviation 0.5."""
    a, b = (-0.5 * ((x[:, 0] - m) / 0.5) ** 2 for m in (-5.0, 5.0))
    return np.logaddexp(a, b)


def tasks(spark, n, start, t=1.0):
    return spark.range(n).select(
        F.col("id").alias("chain"), F.lit(0).alias("level"), F.lit(float(t)).alias("temperature"),
        F.array(*[F.lit(float(s)) for s in start]).alias("start"),
    )


def test_random_walk_recovers_mean_and_deviation(spark):
    plan = chains.Schedule(draws=100, burn_in=100, thin=5, seed=3)
    draws = chains.simulate(tasks(spark, 200, [0.0]), normal, plan, [np.array([[4.0]])])
    row = draws.agg(F.avg(F.col("data")[0]).alias("m"), F.stddev_pop(F.col("data")[0]).alias("s"), F.count("*").alias("n")).first()
    assert row["n"] == 20_000
    assert row["m"] == pytest.approx(3.0, abs=0.1) and row["s"] == pytest.approx(2.0, abs=0.1)


def test_draws_do_not_depend_on_partitioning(spark):
    plan = chains.Schedule(draws=5, burn_in=3, seed=8)
    run = lambda n: sorted(
        (r["chain"], r["iter"], r["data"][0])
        for r in chains.simulate(tasks(spark, 30, [0.0]).repartition(n), normal, plan, [np.eye(1)]).collect()
    )
    assert run(1) == run(7)


def test_temperature_flattens_the_target(spark):
    plan = chains.Schedule(draws=100, burn_in=100, thin=5, seed=3)
    draws = chains.simulate(tasks(spark, 200, [0.0], t=9.0), normal, plan, [np.array([[8.0]])])
    assert draws.agg(F.stddev_pop(F.col("data")[0])).first()[0] == pytest.approx(6.0, abs=0.35)


@pytest.mark.parametrize("blocks", [[np.eye(2)], [np.eye(2)[:, [0]], np.eye(2)[:, [1]]]])
def test_tuning_reaches_the_target_rate(spark, blocks):
    settings = tuning.TuneSettings(target=0.3, period=100, max_period=1600)
    out = tuning.tune_scales(tasks(spark, 20, [3.0, 3.0]), normal, blocks, settings).toPandas()
    assert len(out) == 20 * len(blocks)
    assert out["rate"].mean() == pytest.approx(0.3, abs=0.05)
    assert out["scale"].between(1.0, 20.0).all()


def test_four_passes_find_the_shape(spark):
    def stretched(x, p):
        return -0.5 * (x[:, 0] ** 2 / 100.0 + x[:, 1] ** 2 / 0.01)

    one = tasks(spark, 1, [0.0, 0.0])
    settings = tuning.TuneSettings(target=0.25, period=50, max_period=200)
    blocks = tuning.four_pass(one, [0], stretched, 2, settings, chains.Schedule(draws=1500, burn_in=200, thin=3))
    (b,) = blocks[0]
    shape = b @ b.T
    assert math.sqrt(shape[0, 0] / shape[1, 1]) == pytest.approx(100.0, rel=0.6)


def test_jumps_let_cold_chains_visit_both_wells(spark):
    hot = materialize(
        chains.simulate(
            tasks(spark, 100, [5.0], t=30.0).withColumn("level", F.lit(1)), two_wells,
            chains.Schedule(draws=40, burn_in=50, thin=5), [np.array([[5.0]])],
        ).select((F.col("chain") * 1000 + F.col("iter")).alias("id"), "level", "data", "weight"),
        "hot",
    )
    bounds = equal_count_bounds(hot, 5)
    picks = draw_pool(assign_equal_count(hot, bounds).select("bin", "id", "data", "weight"), 300, 4)
    pool = pool_from_rows(picks, [r["lo"] for r in bounds.orderBy("bin").collect()], 30.0)
    cold, plan, b = tasks(spark, 50, [5.0]), chains.Schedule(draws=100, thin=2), [np.array([[0.5]])]
    share = lambda d: d.agg(F.avg((F.col("data")[0] < 0).cast("double"))).first()[0]
    assert share(chains.simulate(cold, two_wells, plan, b)) == 0.0
    assert share(chains.simulate(cold, two_wells, plan, b, pool)) == pytest.approx(0.5, abs=0.12)


def test_full_ladder(spark, tmp_path):
    settings = RunSettings(
        levels=3, t_high=40.0, thin=2, sweeps_per_draw=4, draws=2000, burn_in=50, covariance_draws=800,
        period=20, max_period=80, pool_capacity=500, chains=20, save_space=1,
    )
    roster = spark.range(20).select(F.col("id").alias("chain"), (F.col("id") % 4).alias("grp"))
    store = SampleStore(spark, str(tmp_path / "store"))
    starts = spark.range(6).select("id", F.array((F.col("id") - 2.5) * 3).alias("start"))
    bounds = run_ladder(roster, two_wells, [5.0], store, settings, climb_starts=starts).toPandas()
    assert set(bounds["level"]) == {1, 2} and len(bounds) == 6
    counts = store.scan().groupBy("level").count().toPandas().set_index("level")["count"]
    assert counts[0] == 2000 and counts[1] == 2800 and counts[3] == 6
    below = store.scan(0).agg(F.avg((F.col("data")[0] < 0).cast("double"))).first()[0]
    assert 0.2 < below < 0.8
    ids = store.scan(1)
    assert ids.select("id").distinct().count() == ids.count()
    points = store.scan(0).select("data").distinct().count()
    continue_ladder(roster, two_wells, store, settings)
    assert store.scan(0).count() == 4000 and store.scan(0).select("id").distinct().count() == 4000
    assert store.scan(0).select("data").distinct().count() > 1.2 * points


def test_command_runs_a_ladder(spark, tmp_path, monkeypatch):
    from tempera import run

    (tmp_path / "wells.py").write_text(
        "import numpy as np\n\ndef log_posterior(x, p):\n    return np.logaddexp(*(-2.0 * (x[:, 0] - m) ** 2 for m in (-5.0, 5.0)))\n"
    )
    (tmp_path / "mode.txt").write_text("5.0\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "wells.py"))
    monkeypatch.setattr(run, "release_staged", lambda s: None)
    run.main(
        ["--target", "wells:log_posterior", "--mode", str(tmp_path / "mode.txt"), "--store", str(tmp_path), "--RunID", "t",
         "--nLevel", "2", "--TK", "20", "--ndraws", "200", "--nburnin", "20", "--THIN", "2", "--nInitial", "2",
         "--chains", "4", "--HillClimb", "3", "--pr", "10", "--mpr", "20"]
    )
    store = SampleStore(spark, str(tmp_path / "t"))
    assert store.scan(0).count() == 200 and store.scan(2).count() == 3


def test_climb_respects_walls(spark):
    def objective(x, p):
        f = (x[:, 0] - 1.0) ** 2 + 10.0 * (x[:, 1] - x[:, 0] ** 2) ** 2
        return np.where(x[:, 0] < -3.0, climb.WALL, f)

    starts = spark.createDataFrame([(0, [-2.9, 2.0]), (1, [3.0, 3.0]), (2, [-5.0, 0.0])], "id long, start array<double>")
    ends = {r["id"]: r for r in climb.hill_climb(starts, objective, crit=1e-12, max_iter=500).collect()}
    assert set(ends) == {0, 1}
    for r in ends.values():
        assert r["data"] == pytest.approx([1.0, 1.0], abs=1e-3) and r["code"] == climb.CONVERGED


def test_gradient_is_one_sided_next_to_a_wall():
    f = lambda x: np.where(x[:, 0] > 1.0, climb.WALL, x[:, 0] * 3.0)
    x = np.array([[1.0]])
    assert climb.numeric_gradient(f, x, f(x), 1e-6)[0, 0] == pytest.approx(3.0, rel=1e-5)


def test_acceptance_ratio(spark):
    df = spark.createDataFrame([(1.0, 3.0)], "wx double, wy double")
    got = df.select(energy.jump_log_ratio(F.col("wx"), F.col("wy"), F.lit(1.0), F.lit(4.0))).first()[0]
    assert got == pytest.approx((3.0 - 1.0) * (1.0 - 0.25))


def test_command_line():
    s = parse_settings(["--RunID", "r1", "--nLevel", "5", "--burnin", "7", "--pr", "10"])
    assert (s.run_id, s.levels, s.burn_in, s.period, s.max_period, s.top) == ("r1", 5, 7, 10, 160, 4)
