import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempera.operators import steady_state as ss
from tempera.operators import prior, target, timeseries
from tempera.plans import starting
from tempera.schema import NEG_INF, SAMPLE
from tempera.sources import config
from tempera.sources.record import SampleRecordSource


def dense_log_likelihood(model, y):
    """Joint normal density of all observations, built from the state-space recursion."""
    t, ny = y.shape
    f, h = model.transition, model.measure
    mean, blocks = [], {}
    z, p = model.z0, model.p0
    states = []
    for _ in range(t):
        mean.append(model.intercept + h @ z)
        states.append(p)
        z, p = f @ z, f @ p @ f.T + model.state_noise
    for i in range(t):
        carry = states[i]
        for j in range(i, t):
            blocks[i, j] = h @ carry @ h.T + (model.measure_noise if i == j else 0.0)
            carry = carry @ f.T
    cov = np.block([[blocks[i, j] if i <= j else blocks[j, i].T for j in range(t)] for i in range(t)])
    e = y.ravel() - np.concatenate(mean)
    return -0.5 * (t * ny * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + e @ np.linalg.solve(cov, e))


def test_filter_equals_joint_density(spark):
    model = timeseries.StateSpace(
        transition=np.array([[0.9, 0.2], [0.0, 0.7]]), state_noise=np.array([[0.5, 0.1], [0.1, 0.3]]),
        measure=np.array([[1.0, 0.5], [0.0, 1.0]]), measure_noise=0.2 * np.eye(2), intercept=np.array([0.3, -0.1]),
        z0=np.array([0.5, 0.0]), p0=np.array([[2.0, 0.4], [0.4, 1.0]]),
    )
    y = np.random.default_rng(5).normal(size=(3, 6, 2))
    df = spark.createDataFrame([(i, [float(v) for v in y[i].ravel()]) for i in range(3)], "series long, y array<double>")
    by_period = timeseries.period_log_likelihood(df, model, 6)
    got = {r["series"]: r["loglik"] for r in timeseries.log_likelihood(by_period).collect()}
    for i in range(3):
        assert got[i] == pytest.approx(dense_log_likelihood(model, y[i]))


def test_lagged_states_do_not_change_the_likelihood(spark):
    model = timeseries.StateSpace.local_level(0.4, 0.8, 3.0)
    df = spark.createDataFrame([(0, [0.3, -0.2, 1.0, 0.5])], "series long, y array<double>")
    a = timeseries.period_log_likelihood(df, model, 4).agg(F.sum("loglik")).first()[0]
    b = timeseries.period_log_likelihood(df, model.with_lags([0]), 4).agg(F.sum("loglik")).first()[0]
    assert a == pytest.approx(b)


def test_calendar_and_window(spark):
    cal = timeseries.calendar_between(spark, (1975, 2), (2010, 4)).orderBy("pos").collect()
    assert len(cal) == 143 and cal[0]["dt"] == 1975.25 and cal[-1]["dt"] == 2010.75
    panel = spark.createDataFrame([(2000.0, 1.0, 2.0), (2000.25, 3.0, -1.0e300), (2000.5, 4.0, 5.0)], "dt double, a double, b double")
    assert timeseries.sample_window(panel, 2000.0, 2000.25, ["a"]).count() == 2
    with pytest.raises(Exception, match="missing value"):
        timeseries.sample_window(panel, 2000.0, 2000.5, ["a", "b"]).collect()


def test_prior_normaliser_matches_the_published_scale(spark):
    """The printed log scale for this prior and calibration is 0.3614, from 10,000 draws."""
    draws = prior.draw_from_prior(spark.range(20_000), "id", 203, seed=13)
    out = prior.prior_scale(draws, 203).first()
    sampling_error = math.sqrt(0.3033 * 0.6967 * (1 / 10_000 + 1 / 20_000)) / 0.6967
    assert out["log_scale"] == pytest.approx(0.36140037694606386, abs=3 * sampling_error)


def test_prior_draws_have_the_prior_moments(spark):
    x = np.stack(prior.draw_from_prior(spark.range(20_000), "id", 203).toPandas()["data"].to_numpy())
    assert x.shape[1] == prior.n_free(203) == 21
    assert x[:, 0].mean() == pytest.approx(1.8611 / 3.0112, abs=0.015)
    assert x[:, 2].mean() == pytest.approx(1 / 3, abs=0.01) and x[:, 2].max() < 1
    assert x[:, 4].mean() == pytest.approx(2.0, abs=0.06)
    inverse = 1.0 / x[:, 20]
    assert inverse.mean() == pytest.approx(0.3260961642159758 / 1.451789062500018e-4, rel=0.05)


@pytest.mark.parametrize("family,a,b", [("gamma", 1.8611, 3.0112), ("beta", 1.0, 2.0), ("inverse_gamma", 3.0, 2.0)])
def test_log_densities_integrate_to_one(spark, family, a, b):
    top = 1.0 if family == "beta" else 60.0
    n = 60_000
    grid = spark.range(n).select(((F.col("id") + 0.5) * (top / n)).alias("x"))
    total = grid.agg(F.sum(F.exp(prior.log_pdf(family, F.col("x"), a, b))) * (top / n)).first()[0]
    assert total == pytest.approx(1.0, abs=2e-3)


@pytest.mark.parametrize("code", [0, 1, 2, 3, 4, 5])
def test_steady_state_identities(spark, code):
    """Whatever is fixed and whatever is derived, the same steady-state conditions hold."""
    n = len(prior.deep_names(code))
    x = [0.5] * n + [0.5] * (prior.n_free(code) - n)
    if code == 5:
        x[5] = 1.0
    df = spark.createDataFrame([(x,)], "data array<double>")
    r = prior.evaluate(df, code).first()
    c = prior.CALIBRATION
    assert r["by"] == pytest.approx(r["theta"] * (r["lambda_star"] * c["land_e"] + c["ky"] / r["lambda_q"]))
    assert (1 + r["lambda_a"]) * r["beta"] * r["R"] == pytest.approx(r["lambda_star"])
    assert r["C_h"] + r["C_e"] + c["ik"] * c["ky"] == pytest.approx(1.0)
    income = 1.0 - r["alpha"] + (1.0 / r["lambda_star"] - 1.0 / r["R"]) * r["by"]
    assert r["C_h"] == pytest.approx(income)


def test_calibration_from_a_file(spark):
    text = "//== ky ==//\n4.0\n//== glambdastar ==// % note\n1.01\n//== other ==//\n9\n"
    sections = config.parse_sections(spark.createDataFrame([("f", text)], "file string, text string"))
    made = prior.calibration_from(sections)
    assert made["ky"] == 4.0 and made["lambda_star"] == 1.01 and made["ik"] == prior.CALIBRATION["ik"]


def test_regime_flags(spark):
    def file(name, *states):
        return name, "".join(f"//== Number of states for state_variable[{i}] ==//\n{n}\n" for i, n in enumerate(states))

    texts = spark.createDataFrame([file("one", 1, 1), file("two", 2, 3)], "file string, text string")
    got = {r["file"]: (r["variables"], r["grand_regimes"], r["constant"]) for r in config.regime_flags(config.parse_sections(texts)).collect()}
    assert got == {"one": (2, 1, True), "two": (2, 6, False)}


def test_starting_points(spark, tmp_path):
    (tmp_path / "mode.txt").write_text("\n 1.5 2.5 -3 \n")
    assert starting.from_text(spark, str(tmp_path / "mode.txt")) == [1.5, 2.5, -3.0]
    sections = config.parse_sections(spark.createDataFrame([("f", "//== x ==//\n2\n4 5\n")], "file string, text string"))
    assert starting.from_sections(sections, "x") == [4.0, 5.0]
    assert len(starting.from_prior(spark, 203, seed=1)) == 21
    (tmp_path / "draws.txt").write_text("-1 -2 7 8\n-1 -2 9 10\n")
    assert starting.from_draws(spark, str(tmp_path / "draws.txt"), 3) in ([7.0, 8.0], [9.0, 10.0])


def test_start_from_record_file(spark, tmp_path):
    spark.dataSource.register(SampleRecordSource)
    df = spark.createDataFrame([([1.0, 2.0], 0, -99.0, True)], SAMPLE)
    df.write.format("sample_record").mode("append").save(str(tmp_path / "s"))
    row = target.start_from_file(spark, str(tmp_path / "s"), lambda x, p: -x.sum(axis=1)).first()
    assert row["weight"] == -3.0 and row["calculated"]


@pytest.mark.parametrize("code", [203, 205, 207, 103])
def test_restrictions_by_code(spark, code):
    n = len(prior.deep_names(code))
    good = [0.5] * n + [0.5] * (prior.n_free(code) - n)
    if code == 205:
        good[-1 - (prior.n_free(code) - n)] = 1.0  # R
    bad_habit, bad_deviation = list(good), list(good)
    bad_habit[prior.deep_names(code).index("gamma_h")] = 1.0
    bad_deviation[-1] = 0.0
    df = spark.createDataFrame([(0, good), (1, bad_habit), (2, bad_deviation)], "id int, data array<double>")
    got = {r["id"]: (r["valid"], r["log_prior"]) for r in prior.evaluate(df, code).collect()}
    assert got[0][0] and got[0][1] > -1e299
    assert got[1] == (False, -1.0e300) and got[2] == (False, -1.0e300)


def test_base_regime_and_weighted_error(spark):
    df = spark.createDataFrame(
        [(1, "a", "x", 0.2, 1.0), (1, "a", "y", 0.3, 2.0), (1, "b", "x", 0.5, -1.0)], "t int, u string, v string, p double, e double"
    )
    got = {r["u"]: r["probability"] for r in timeseries.base_regime_probability(df, ["t"], ["u"], "p").collect()}
    assert got == pytest.approx({"a": 0.5, "b": 0.5})
    assert timeseries.weighted_error(df, ["t"], "p", "e").first()["error"] == pytest.approx(0.3)


def test_formulas_are_ordered_and_checked():
    formulas = {"c": lambda a, b: a + b, "b": lambda a: a * 2, "d": lambda c, b: c - b}
    assert ss.layers(formulas, ["a"]) == [["b"], ["c"], ["d"]]
    assert ss.layers(formulas, ["a"], ["b"]) == [["b"]]
    with pytest.raises(KeyError, match="a is neither"):
        ss.layers(formulas, [], ["b"])
    with pytest.raises(ValueError, match="need each other"):
        ss.layers({"x": lambda y: y, "y": lambda x: x}, [])
    assert {ss.variant_of(c) for c in (0, 1, 2)} == {"given_beta"} and ss.variant_of(6) == "free_beta"
    assert {ss.variant_of(c) for c in (3, 4, 5)} == {"given_debt"} and {ss.variant_of(c) for c in (103, 203, 207)} == {"given_collateral"}


@pytest.mark.parametrize("variant", list(ss.VARIANTS))
def test_columns_and_projections_agree(spark, variant):
    df = spark.createDataFrame([([0.5, 0.4, 0.3, 0.6, 0.5] + [0.5] * 16,)], "data array<double>")
    given = prior.structural(F.col("data"), 203) | {"beta": F.lit(0.985)}
    row = ss.with_steady_state(df, given, variant).first()
    nested = df.select(*[c.alias(n) for n, c in ss.solve(given, ss.VARIANTS[variant]).items()]).first()
    assert {n: row[f"ss_{n}"] for n in ss.VARIANTS[variant]} == pytest.approx({n: nested[n] for n in ss.VARIANTS[variant]})
    assert row["ss_L_e"] + row["ss_L_h"] == pytest.approx(1.0) and row["ss_mu_b_e"] * row["ss_lambda_star"] == pytest.approx(row["ss_beta"] * row["ss_lambda_a"])


def test_regime_layout(spark):
    text = """//== Number of states for state_variable[1] ==//
2
//== Number of states for state_variable[2] ==//
3
//== Number of free parameters not time varying ==//
2
//== Time varying coefficient parameters ==//
3
0 0 0
1 0 0
1 1 1
//== Time varying variance parameters ==//
2
0 1 0
0 0 1
"""
    files = spark.createDataFrame([("f", text), ("none", text.replace("\n3\n0 0 0\n1 0 0\n1 1 1", "\n0"))], "file string, text string")
    sections = config.parse_sections(files)
    layout = {(r["file"], r["place"]): (r["block"], r["param"], r["regimes"], r["offset"]) for r in config.regime_layout(sections).collect()}
    assert [layout["f", i] for i in range(5)] == [
        ("coefficient", 0, 1, 2), ("coefficient", 1, 2, 3), ("coefficient", 2, 6, 5), ("variance", 0, 3, 11), ("variance", 1, 1, 14),
    ]
    assert [layout["none", i][3] for i in range(2)] == [2, 5]
    taken = {(r["file"], r["regime"]): r["take"] for r in config.regime_positions(sections).collect()}
    assert len(taken) == 12
    for a in range(2):
        for b in range(3):
            assert taken["f", 3 * a + b] == [0, 1, 2, 3 + a, 5 + 3 * a + b, 11 + b, 14]
    draws = spark.createDataFrame([("f", 7, [float(i) for i in range(15)])], "file string, id int, data array<double>")
    rows = config.regime_vectors(draws, config.regime_positions(sections)).collect()
    assert sorted(r["regime"] for r in rows) == list(range(6)) and [r["data"] for r in rows if r["regime"] == 4] == [[0.0, 1.0, 2.0, 4.0, 9.0, 12.0, 14.0]]


def test_missing_fixed_parameters_are_named(spark):
    sections = config.parse_sections(spark.createDataFrame([("f", "//== ky ==//\n4.5\n//== Iql ==//\n0\n")], "file string, text string"))
    got = {r["name"]: (r["value"], r["missing"]) for r in config.fixed_parameters(sections, spark.createDataFrame([("f", 205)], "file string, code int")).collect()}
    assert got["ky"] == (4.5, False) and got["Iql"] == (0.0, False) and got["Iqk"] == (1.0, False) and got["gtheta"] == (None, True)
    assert "R" not in got and "by" not in got


def test_state_noise_by_row(spark):
    rng = np.random.default_rng(3)
    impact, sigma = rng.normal(size=(5, 6)), rng.uniform(0.1, 2, size=(5, 2))
    rows = [(i, [float(v) for v in impact[i]], [float(v) for v in sigma[i]], "x") for i in range(5)]
    rows += [(7, None, [1.0, 1.0], "x"), (8, [1.0] * 5, [1.0, 1.0], "x"), (9, [1.0] * 6, [1.0, None], "x")]
    df = spark.createDataFrame(rows, "id int, impact array<double>, sigma array<double>, wide string")
    got = {r["id"]: r["noise"] for r in timeseries.state_noise(df, 3, 2, 4).collect()}
    for i in range(5):
        b = impact[i].reshape(3, 2) * sigma[i]
        want = np.zeros((4, 4))
        want[:3, :3] = b @ b.T
        assert np.array(got[i]).reshape(4, 4) == pytest.approx(want)
    assert got[7] is None and got[8] is None and got[9] is None
    assert timeseries.state_noise(df.limit(0), 3, 2).count() == 0
    with pytest.raises(ValueError):
        timeseries.state_noise(df, 3, 2, 2)


def test_a_row_without_its_other_half_is_impossible(spark):
    priors = spark.createDataFrame([(1, True, -2.0), (2, True, -3.0), (3, False, -1.0)], "id int, valid boolean, log_prior double")
    likelihoods = spark.createDataFrame([(1, 5.0), (3, 4.0), (4, 6.0)], "id int, loglik double")
    got = {r["id"]: r["log_posterior"] for r in prior.log_posterior(priors, likelihoods, 0.5).collect()}
    assert got == {1: 3.5, 2: NEG_INF, 3: NEG_INF, 4: NEG_INF}
