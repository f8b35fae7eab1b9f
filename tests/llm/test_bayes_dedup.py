import random

import numpy as np
import pytest

from tempera.llm import bayes_dedup as bd
from tempera.llm.graph import connected_components

DOCS = "doc_id long, text string, component_id string, node long"


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if x]
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            if d in ids:
                parent[find(i)] = find(ids[d])
            ids[d] = i
    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(docs):
        c = low.get(find(i))
        out.append((d, len(sets[i]), c, c is None or d == c))
    return sorted(out, key=repr)


def noisy_group(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("chunk", [10_000, 25])
def test_components_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(bd, "CHUNK_ROWS", chunk)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for size, n, most in ((120, 90, 6), (60, 30, 3), (300, 20, 14)):
        texts += noisy_group(rng, [word() for _ in range(size)], n, most)
    texts += [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    docs = list(enumerate(texts, start=1000))
    docs += [(1, None), (2, ""), (3, " \t\n "), (4, "a b"), (5, "A\tB"), (6, "É a b c d"), (7, "é a b c d"), (8, "wort " * 50_000)]
    docs += [(9, "wort " * 40_000), (10, texts[0]), (10, texts[100]), (11, "same five words in row"), (11, "same five words in row")]
    docs += [(None, texts[3]), (None, "nowhere else at all seen")]
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in docs], DOCS).repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in bd.near_duplicates(df).collect()), key=repr)
    assert got == brute(docs)


def test_empty_table(spark):
    assert bd.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    # Least matches leave a pair at the threshold with at least 1 - MISS at each look.
    rng = np.random.default_rng(1)
    seen = rng.random((20_000, bd.BANDS * bd.BAND_ROWS)) < 0.85
    for n in range(bd.BATCH, bd.BANDS * bd.BAND_ROWS + 1, bd.BATCH):
        assert (seen[:, :n].sum(axis=1) >= bd.least_matches(n)).all()
    assert bd.least_matches(bd.BANDS * bd.BAND_ROWS) > 110


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.85):
        errors = []
        for _ in range(60):
            both, n = rng.integers(0, 2**63, 300, dtype=np.uint64), int(300 * (1 - share) / share / 2)
            a, b = (np.unique(np.r_[both, rng.integers(0, 2**63, n, dtype=np.uint64)]) for _ in range(2))
            errors.append((bd.signature(a) == bd.signature(b)).mean() - 300 / (300 + 2 * n))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_connected_components_on_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == dict.fromkeys(range(n), 0) | {1000: 1000, 1001: 1000}


def test_bands_follow_the_threshold():
    assert bd.bands_for(85) == bd.BANDS and bd.bands_for(80) > bd.BANDS
    for percent in (70, 80, 85, 95):
        t = percent / 100
        assert (1 - t**bd.BAND_ROWS) ** bd.bands_for(percent) < bd.MISS
    assert bd.least_matches(180, 80) < bd.least_matches(180)
