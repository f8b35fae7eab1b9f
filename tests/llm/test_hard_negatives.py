import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempera.llm import hard_negatives as hn


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    return df.withColumn("score", F.lit("x")).withColumn("dims", F.lit(-1)).withColumn("slot", F.lit(None).cast("int"))


def brute(rows, anchor, k=5, m=3, low=50, high=95, scale=256):
    sound = [
        (i, y, [math.floor(scale * x) for x in v]) for i, y, v in rows
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, y, q in (r for r in sound if anchor(r[0])):
        scored = [(-sum(b * c for b, c in zip(q, v)), i, z == y) for i, z, v in sound if i != a and len(v) == len(q)]
        scored.sort(key=lambda s: s[:2])
        for p, pid, _ in [s for s in scored if s[2]][:k]:
            fits = [s for s in scored if not s[2] and low * -p <= 100 * -s[0] <= high * -p][:m]
            out += [(a, pid, r, nid, -p, -s) for r, (s, nid, _) in enumerate(fits, 1)]
    return sorted(out)


def found(spark, rows, anchor_every=5, **sizes):
    vectors = hn.prepared(frame(spark, rows))
    return sorted(map(tuple, hn.hard_negatives(vectors, vectors.filter(F.col("vec_id") % anchor_every == 0), **sizes).collect()))


@pytest.mark.parametrize("shard_rows, block_anchors", [(2048, 512), (7, 3)])
def test_matches_brute_force(spark, shard_rows, block_anchors):
    rng = random.Random(3)
    rows = [(i, rng.randrange(4), [rng.choice([-0.5, -0.25, 0.0, 0.125, 0.5, 0.75]) for _ in range(11)]) for i in range(90)]
    rows += [(i, 1, [0.25] * 11) for i in range(100, 112)]  # ties
    rows += [(105, 2, [0.25] * 11), (105, 1, [0.25] * 11)]  # repeated id
    rows += [(None, 1, [0.5] * 11), (200, None, [0.5] * 11), (205, 1, None), (210, 1, [None] * 11), (215, 1, [math.nan] * 11), (220, 1, [math.inf] * 11)]
    rows += [(225, 1, [0.5, 0.5]), (226, 1, [0.5, 0.25]), (227, 2, [0.25, 0.25]), (230, 3, []), (231, 3, []), (232, 2, []), (-10, 1, [0.5] * 11)]
    got = found(spark, rows, shard_rows=shard_rows, block_anchors=block_anchors)
    assert got == brute(rows, lambda i: i % 5 == 0) and len(got) > 100


def test_one_label_and_none(spark):
    rows = [(i, 7, [float(i), 1.0]) for i in range(12)]
    assert found(spark, rows) == []
    assert found(spark, []) == []
    assert found(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []


def test_scores_are_exact_for_large_numbers(spark):
    rng = np.random.default_rng(2)
    for top, dims in ((2**9, 64), (2**28, 9), (2**40, 3), (2**30, 17)):
        v, q = rng.integers(-top, top, (40, dims)), rng.integers(-top, top, (5, dims))
        v[0], q[0] = -top, -top
        want = q.astype(object) @ v.astype(object).T
        if np.abs(want).max() < 2**63:
            assert (hn.scores(q, hn.bit_planes(v)) == want).all()
        else:
            with pytest.raises(OverflowError):
                hn.scores(q, hn.bit_planes(v))
    rows = [(i, i % 2, [1e5 * (i + 1), -3e5 / (i + 1)]) for i in range(40)]
    assert found(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_planes_hold_only_the_bits_there_are(spark):
    assert hn.bit_planes(np.array([[0, -1, 3]])).shape == (3, 1, 1)
    assert hn.bit_planes(np.zeros((4, 20), np.int64)).shape == (1, 3, 4)
