import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from tempera.llm import spot_signatures as ss

DOCS = "doc_id long, text string, n_chars string, fingerprint long"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "c", 0) for i, t in docs], DOCS)


def odd_words(spark, words):
    df = spark.createDataFrame([(w,) for w in words] or [("",)], "w string")
    return {r.w for r in df.filter(F.pmod(F.xxhash64("w"), F.lit(ss.ODD_ANCHORS)) == 0).collect()}


def chains(text, odd):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    anchor = lambda w: w in ss.ANCHORS or w in odd
    content = [w for w in words if not anchor(w)]
    out, passed = set(), 0
    if words:
        out.add(("^", *content[: ss.CHAIN]))
    for w in words:
        if anchor(w):
            out.add((w, *content[passed : passed + ss.CHAIN]))
        else:
            passed += 1
    return out


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_matches_brute_force(spark):
    rng = random.Random(9)
    words = ["the", "of", "der", "la", *(f"w{i}" for i in range(40))]
    docs = [(3 * i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(80)]
    docs += [(500, None), (501, ""), (502, "!!! ### $$$"), (503, "🙂é the été 🙂"), (504, "the"), (505, "Und Und Und"), (506, "the w1 w2 " * 20_000)]
    docs += [(-5, "first of all texts"), (600, docs[7][1])]
    odd = odd_words(spark, {w for _, t in docs for w in re.split(r"[\W_]+", (t or "").lower())} | set(words))
    rows = {r.doc_id: r for r in ss.fingerprints(frame(spark, docs).repartition(5)).collect()}
    ordered = sorted((i, t or "") for i, t in docs)
    assert sorted(rows) == [i for i, _ in ordered]
    # Edited texts can hold words cut in two; their anchors are looked up as well.
    edited = {}
    for (i, a), (_, b) in zip(ordered, ordered[1:] + ordered[:1]):
        q = len(a) // 4
        edited[i] = a[: len(a) - q] + b[:q]
    odd |= odd_words(spark, {w for t in edited.values() for w in re.split(r"[\W_]+", t.lower())})
    for (i, a), (_, b) in zip(ordered, ordered[1:] + ordered[:1]):
        r = rows[i]
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest()
        assert len(r.fingerprint.split()) == len(chains(a, odd)) and len(r.edited_fingerprint.split()) == len(chains(edited[i], odd))
        assert abs(r.near_edited - jaccard(chains(a, odd), chains(edited[i], odd))) < 1e-12
        assert abs(r.near_next - jaccard(chains(a, odd), chains(b, odd))) < 1e-12
    assert rows[600].fingerprint == rows[21].fingerprint and rows[500].fingerprint == rows[501].fingerprint == ""


def test_order_with_repeats_and_nulls(spark):
    docs = [(1, "one of the texts"), (1, "one of the texts"), (None, "no id in this"), (2, "two of the texts")]
    rows = ss.fingerprints(frame(spark, docs)).collect()
    assert len(rows) == 4
    assert sorted(r.near_next for r in rows if r.doc_id == 1)[-1] == 1.0
    single = ss.fingerprints(frame(spark, [(9, "abcdefgh")])).collect()
    assert single[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and single[0].near_next == 1.0
    assert ss.fingerprints(frame(spark, [])).count() == 0


def test_near_pairs_match_brute_force(spark):
    rng = random.Random(4)
    sets = {}
    for g in range(12):
        core = rng.sample(range(10_000), rng.randrange(3, 40))
        for _ in range(6):
            s = set(core)
            for _ in range(rng.randrange(4)):
                s.discard(rng.choice(core))
                s.add(rng.randrange(10_000))
            sets[len(sets)] = s
    sets[len(sets)] = set()
    sets[len(sets)] = {1}
    sets[len(sets)] = {1}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "doc_id long, signatures array<int>")
    for threshold in (0.5, 0.8, 1.0):
        got = {(r.a, r.b): r.likeness for r in ss.near_pairs(df, threshold).collect()}
        want = {(a, b): jaccard(sets[a], sets[b]) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b]}
        want = {k: v for k, v in want.items() if v >= threshold}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
