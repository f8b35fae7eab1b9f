import math

import pandas as pd
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tempera.operators import binning, energy, ranking, selection, walks


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, and that group is one repeated value."""
    i = F.col("id")
    return spark.range(9000).select(
        (i % 3).alias("g"),
        F.when(i % 3 == 0, F.lit(5.0)).otherwise((i * 7919 % 500).cast("double")).alias("v"),
        i,
    )


def _ranked(df, by):
    pdf = df.toPandas().sort_values([*by, "v", "id"]).reset_index(drop=True)
    pdf["rn"] = pdf.groupby(by).cumcount() if by else pdf.index
    return pdf


def test_global_rank_is_exact_for_hot_groups_and_ties(skewed):
    got = ranking.global_rank(skewed, ["g"], ["v", "id"]).toPandas()
    want = _ranked(skewed, ["g"]).set_index("id")["rn"]
    assert (got.set_index("id")["rn"].sort_index() == want.sort_index()).all()
    assert set(got["n"]) == {3000}


@pytest.mark.parametrize("small", [100_000, 40])
def test_selected_ranks_equal_sorted_rows(skewed, small):
    def wanted(n):
        return [0, 1, n // 3, n // 2, n - 1]

    got = selection.select_ranks(skewed, ["g"], "v", "id", wanted, small).toPandas()
    full = _ranked(skewed, ["g"])
    for r in got.itertuples():
        row = full[(full.g == r.g) & (full.rn == r.rank)].iloc[0]
        assert (row.v, row.id) == (r.v, r.id)
    assert len(got) == 15


def test_selection_over_a_whole_frame(skewed):
    got = selection.select_ranks(skewed, [], "v", "id", lambda n: [17, n // 2], small=30).toPandas()
    full = _ranked(skewed, [])
    assert [tuple(full.loc[k, ["v", "id"]]) for k in got["rank"]] == list(zip(got["v"], got["id"]))


def test_selection_with_too_many_groups_uses_full_ranks(skewed, monkeypatch):
    few = selection.select_ranks(skewed, ["g"], "v", "id", lambda n: [3, n - 1]).toPandas()
    monkeypatch.setattr(selection, "MAX_GROUPS", 2)
    many = selection.select_ranks(skewed, ["g"], "v", "id", lambda n: [3, n - 1]).toPandas()
    key = ["g", "rank"]
    assert few.sort_values(key).values.tolist() == many.sort_values(key).values.tolist()


def _chunks_by_walking(n, bins):
    size, start, out = math.ceil(n / bins), 0, []
    while start < n:
        if start + size == n - 1:
            size += 1
        out.append((start, min(start + size, n) - 1))
        start += size
    return out


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(1, 60))
def test_equal_chunks(n, bins):
    assert binning._equal_chunks(n, bins) == _chunks_by_walking(n, bins)


def test_equal_count_bins_agree_with_full_ranks(spark, skewed):
    samples = skewed.select(F.col("g").cast("int").alias("level"), "id", (-F.col("v")).alias("weight"))
    a = binning.equal_count_bins(samples, 7).select("level", "id", "bin").toPandas()
    b = binning.equal_count_ranked(samples, 7).select("level", "id", "bin").toPandas()
    merged = a.merge(b, on=["level", "id"])
    assert len(merged) == 9000 and (merged.bin_x == merged.bin_y).all()


def test_bins_partition_the_level(spark, skewed):
    samples = skewed.where("g = 1").select(F.lit(0).alias("level"), "id", (-F.col("v")).alias("weight"))
    for bounds in (
        binning.equal_count_bounds(samples, 6),
        binning.geometric_bounds(samples, 6),
        binning.adaptive_bounds(samples, 6, 20.0),
    ):
        lows = [r["lo"] for r in bounds.orderBy("bin").collect()]
        assert lows == sorted(lows)
        assert binning.assign_bins(samples, bounds).where("bin IS NOT NULL").count() == 3000


def test_adaptive_bins_respect_the_width(spark, skewed):
    samples = skewed.where("g = 1").select(F.lit(0).alias("level"), "id", (-F.col("v")).alias("weight"))
    bounds = binning.adaptive_bounds(samples, 6, 20.0).orderBy("bin").toPandas()
    assert bounds["n"].sum() == 3000
    assert bounds["n"].max() <= 501
    assert (bounds["lo"].diff().dropna() <= 40.0).all()


def _walked(energies, min_bins, max_width):
    """One bin after the other: (lower end, samples)."""
    e, out, start = sorted(energies), [], 0
    n = len(e)
    while start < n:
        first = -(-n // min_bins)
        step = first if start + first < n else n - start - 1
        while step > 1 and e[start + step] - e[start] > max_width:
            step //= 2
        step = max(1, step + 1 if start + step == n - 1 else step)
        out.append((e[start], min(step, n - start)))
        start += step
    return out


@pytest.mark.parametrize("width", [0.0, 0.3, 5.0, 1e9])
def test_adaptive_bins_follow_the_walk(spark, width):
    rng = np.random.default_rng(4)
    levels = {
        0: rng.normal(0, 3, 150), 1: np.round(rng.exponential(2, 97), 1), 3: np.zeros(64), 4: np.array([1.5]), 5: np.array([2.0, 2.0]),
        6: 0.1 * np.arange(80), 7: np.array([-1e-9, 0.0, 0.3, 0.1 + 0.2, 5e-324]),
    }
    rows = [(k, i, float(-v)) for k, vs in levels.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "level int, id long, weight double")
    got = binning.adaptive_bounds(df, 4, width).orderBy("level", "bin").collect()
    for level, energies in levels.items():
        mine = [r for r in got if r["level"] == level]
        assert [r["bin"] for r in mine] == list(range(len(mine)))
        assert [(r["lo"], r["n"]) for r in mine] == _walked([float(v) for v in energies], 4, width)
    assert binning.adaptive_bounds(df.limit(0), 4, width).count() == 0


def test_widest_energy_is_exact():
    rng = np.random.default_rng(1)
    lows = np.concatenate([rng.normal(0, s, 200) for s in (1e-300, 1e-9, 1.0, 1e12)] + [[0.0, -0.3, 1e308, -1e308]])
    for width in (0.0, 0.1, 0.3, 7.0, 1e-12, 1e300):
        top = binning.widest_energy(lows, width)
        assert (top - lows <= width).all() and not (np.nextafter(top, np.inf) - lows <= width).any()


def test_lookup_edges(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (1.5,), (2.0,), (99.0,)], "e double")
    bounds = F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))
    assert [r[0] for r in df.select(binning.bin_index(F.col("e"), bounds)).collect()] == [0, 0, 1, 2, 2]
    none = F.lit(None).cast("array<double>")
    assert {r[0] for r in df.select(binning.bin_index(F.col("e"), none)).collect()} == {0}


def test_ladder_values():
    t = energy.temperatures(10, 1.0, 1000.0)
    expected = [1.0, 2.994, 6.972, 14.904, 30.723, 62.272, 125.191, 250.671, 500.921, 1000.0, 1995.328]
    assert t == pytest.approx(expected, rel=2e-4)
    steps = [b - a for a, b in zip(t[:9], t[1:10])]
    ratios = [b / a for a, b in zip(steps[:-1], steps[1:])]
    assert max(ratios) - min(ratios) < 1e-6
    assert energy.geometric_points(2, 3.0, 9.0) == [3.0, 3.0]


def test_percentiles_interpolate(spark, skewed):
    got = selection.exact_percentiles(skewed, ["g"], "v", "id", [0.16, 0.5]).toPandas()
    pdf = skewed.toPandas()
    for r in got.itertuples():
        assert r.value == pytest.approx(pdf[pdf.g == r.g].v.quantile(r.p))


def test_walks_over_one_long_chain(spark):
    df = spark.range(2000).select(F.lit(1).alias("c"), F.col("id").alias("t"), ((F.col("id") * 31 % 97)).alias("v"))
    pdf = df.toPandas()
    run = walks.running_max(df, "c", ["t"], "v").orderBy("t").toPandas()
    assert (run["running"] == pdf.v.cummax()).all()
    kept = walks.thin(df, "c", ["t"], 100, 7).orderBy("t").toPandas()
    assert list(kept.t) == list(range(106, 2000, 7))
    moved = pd.Series(pdf.v).diff().dropna().ne(0).mean()
    assert walks.acceptance(df, "c", ["t"], "v").first()["rate"] == pytest.approx(moved)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_walks_over_many_chains_in_many_batches(spark, batch):
    rng = np.random.default_rng(batch)
    lengths = [1, 2, 400, 1, 0, 37, 5, 160, 3]
    rows = [(None if c == 5 else c, t, None if rng.random() < 0.2 else float(rng.integers(-4, 4)), "w") for c, n in enumerate(lengths) for t in range(n)]
    df = spark.createDataFrame(rows, "c int, t long, v double, wide string").repartition(4)
    chains = {}
    for c, t, v, _ in rows:
        chains.setdefault(c, []).append(v)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        best = {(r["c"], r["t"]): r["running"] for r in walks.running_max(df, "c", ["t"], "v").collect()}
        kept = sorted(((r["c"], r["t"], r["draw"]) for r in walks.thin(df, "c", ["t"], 3, 4).collect()), key=str)
        rates = {r["c"]: (r["rate"], r["n"]) for r in walks.acceptance(df, "c", ["t"], "v").collect()}
        assert walks.running_max(df.limit(0), "c", ["t"], "v").count() == walks.acceptance(df.limit(0), "c", ["t"], "v").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len(best) == len(rows)
    for c, values in chains.items():
        for t in range(len(values)):
            known = [v for v in values[: t + 1] if v is not None]
            assert best[c, t] == (max(known) if known else None)
        steps = [(a, b) for a, b in zip(values, values[1:]) if a is not None]
        known = [a != b for a, b in steps if b is not None]
        assert (c in rates) == bool(steps)
        if steps:
            assert rates[c][1] == len(steps) and rates[c][0] == (pytest.approx(np.mean(known)) if known else None)
    assert kept == sorted(((c, t, (t - 3) // 4) for c, vs in chains.items() for t in range(3, len(vs)) if (t - 3) % 4 == 3), key=str)


def test_wide_rows_move_once(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("c"), F.col("id").alias("t"), F.rand(1).alias("v"))
    plan = walks.running_max(df, "c", ["t"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan and "Sort" not in plan
