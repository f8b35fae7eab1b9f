import math
import random

import numpy as np
import pytest

from tempera.llm import ball_tree as bt

ROWS = "vec_id long, embedding array<float>, v string, dims string"


def brute(rows, k, every):
    clean = []
    for i, e, *_ in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            clean.append((i, [math.floor(64 * x) for x in e]))
    out = []
    for q, a in clean:
        if q % every:
            continue
        hits = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in clean if i != q and len(a) == len(b)))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,block_queries", [(10**6, 10**6), (100, 7), (30, 1000)])
def test_matches_brute_force(spark, shard_rows, block_queries):
    rng = random.Random(8)
    point = lambda s=1.0: [rng.gauss(0, s) for _ in range(6)]
    centers = [point(2) for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centers)]) for i in range(400)]
    rows += [(i, list(centers[0])) for i in range(1000, 1180)]  # one very common vector
    rows += [(2000 + i, [0.0] * 6) for i in range(40)]
    rows += [(3000, None), (3020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3040, [float("nan")] * 6), (3060, [float("inf")] * 6)]
    rows += [(4000, [1.0, 2.0]), (4001, [2.0, 1.0]), (4020, []), (None, point())]
    rows = [(i, None if e is None else [None if x is None else float(f"{x:.6g}") for x in e], "clash", "c") for i, e in rows]
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    # The table holds 32-bit components.
    stored = [(r.vec_id, r.embedding) for r in df.collect()]
    vectors = bt.quantized(df)
    got = bt.exact_top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20, shard_rows, block_queries)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute(stored, 20, 20)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**40 + 3 * i), -float(2**39 + i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = bt.quantized(df, scale=1.0)
    with pytest.raises(Exception, match="64 bits"):
        bt.exact_top_k(vectors, vectors.filter("vec_id = 0"), 3).collect()
    small = bt.quantized(spark.createDataFrame([(i, [float(2**29 + i), 1.0]) for i in range(9)], "vec_id long, embedding array<double>"), scale=1.0)
    top = bt.exact_top_k(small, small.filter("vec_id = 0"), 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in top] == [(8, 2**29 * (2**29 + 8) + 1), (7, 2**29 * (2**29 + 7) + 1)]


def test_empty_and_repeated(spark):
    none = bt.quantized(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert bt.exact_top_k(none, none, 5).count() == 0
    twice = bt.quantized(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<float>"))
    got = bt.exact_top_k(twice, twice.filter("vec_id = 0"), 5).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 1, 64 * 128), (2, 1, 64 * 128)]


def fresh(ids, q, k):
    return bt.Block({"ids": ids, "q": q, "bar": np.full(len(ids), bt.LOWEST), "tie": np.full(len(ids), bt.HIGHEST)}, k)


def best(ids, v, asked, k):
    s = v.astype(object) @ v[asked].astype(object).T
    return [sorted((-s[j, r], ids[j]) for j in range(len(ids)) if ids[j] != ids[a])[:k] for r, a in enumerate(asked)]


def held(block):
    found = [[] for _ in block.qids]
    for row, i, s in zip(block.row, block.ids, block.score):
        found[row].append((-s, i))
    return found


@pytest.mark.parametrize("scale", [60, 600, 2**27])  # products in 32 and in 64 bits, and of Python numbers
def test_a_leaf_is_opened_once_for_all_queries(monkeypatch, scale):
    rng = np.random.default_rng(5)
    v = np.floor(scale * rng.standard_normal((1500, 48))).astype(np.int64)
    ids, asked = rng.permutation(1500), np.arange(0, 1500, 10 if scale < 2**27 else 300)
    opened = []
    plain = bt._open
    monkeypatch.setattr(bt, "_open", lambda shard, leaf, block, rows: (opened.append(leaf), plain(shard, leaf, block, rows)))
    shard = bt.Shard(bt.build_tree(ids, v))
    block = fresh(ids[asked], bt._compact(v[asked]), 20)
    bt.search_tree(shard, block)
    block.settle()
    # Nothing is out of reach: a leaf serves once those that have no bar yet, and once all others.
    assert len(set(opened)) == 32 and len(opened) <= 64
    assert held(block) == best(ids, v, asked, 20)


def test_bar_and_tie_of_one_shard_hold_in_the_next():
    v = np.ones((900, 3), np.int64)
    v[::9] = 2
    ids = np.random.default_rng(6).permutation(900)
    asked = np.arange(0, 900, 50)
    shards = [bt.Shard(bt._unpack(bt._pack(**bt.build_tree(ids[a : a + 300], v[a : a + 300])))) for a in (0, 300, 600)]
    first = fresh(ids[asked], bt._compact(v[asked]), 7)
    bt.search_tree(shards[0], first)
    first.settle()
    # The first shard again is told from its bars alone; rows that tie with a bar count if their id is no larger.
    rest = bt.Block({"ids": first.qids, "q": first.q, "bar": first.bar.copy(), "tie": first.tie.copy()}, 7)
    for shard in shards:
        bt.search_tree(shard, rest)
    rest.settle()
    assert held(rest) == best(ids, v, asked, 7)
    assert (rest.tie <= first.tie).all() and (rest.bar >= first.bar).all()


def test_groups_of_blocks_meet_groups_of_shards(spark):
    rng = random.Random(9)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)], "x", "y") for i in range(800)]
    vectors = bt.quantized(spark.createDataFrame(rows, ROWS).repartition(3))
    assert 800 // 40 > bt.SHARDS_A_UNIT and 40 > bt.BLOCKS_A_UNIT
    got = bt.exact_top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20, 40, 1)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute([r[:2] for r in rows], 20, 20)
