import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tempera.llm import slack_packing as sp

DOCS = "doc_id long, text string, length long, sequence_id string"


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(sp.default_tokenizer())
    t.encode_special_tokens = True
    return t


def _ids(reference, text):
    return np.asarray(reference.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["The.", "été", "İx", "ÀB,", "á", " ", " ", "\t", "<|endoftext|>", "it's", "x1,", "\x85", "ß."])).map("".join))
def test_word_ids_are_those_of_the_text(text):
    reference = Tokenizer.from_file(sp.default_tokenizer())
    reference.encode_special_tokens = True
    got = np.frombuffer(sp.word_ids(sp.default_tokenizer()).of(text), dtype="<u4")
    assert got.tolist() == reference.encode(text, add_special_tokens=False).ids


def _check(rows, docs, reference, window=sp.WINDOW):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, group in by_doc.items():
        texts = [t for i, t in docs if i == doc_id]
        expected = Counter()
        for t in texts:
            ids = _ids(reference, t)
            for s in range(0, len(ids), window):
                p = ids[s : s + window]
                expected[s, len(p), zlib.crc32(p.tobytes()), len(ids)] += 1
        assert Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in group) == expected
    assert set(by_doc) == {i for i, _ in docs}
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values(), default=0) <= window
    return sum(0 if n & (n - 1) == 0 else window - n for n in filled.values()), sum(filled.values())


def test_pack_edge_cases(spark, reference):
    long = "wort word, " * 30_000
    docs = [(1, None), (2, ""), (3, long), (4, "a b c"), (4, "a b c"), (4, "other"), (None, "no id"), (5, "<|endoftext|>")]
    docs += [(100 + i, "same text " * 40) for i in range(50)]
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in docs], DOCS)
    _check(sp.pack(df).collect(), docs, reference)
    assert sp.pack(df.limit(0)).count() == 0


def test_little_padding(spark, reference):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(["the", "of", "grammar"], k=rng.randrange(1, 1500)))) for i in range(400)]
    padding, tokens = _check(sp.pack(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs, reference)
    assert padding < 2 * sp.WINDOW and tokens > 100_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 40))
def test_closest_fill_matches_exhaustive_subset_sums(lengths, already):
    counts, window = Counter(lengths), 64
    room = window - already
    reach = {0}
    for n in lengths:
        reach |= {x + n for x in reach if x + n <= room}
    used = sp.closest_fill(dict(counts), sorted(counts), room, already)
    total = sum(n * k for n, k in used.items())
    assert all(k <= counts[n] for n, k in used.items())
    slack = {x: 0 if (already + x) & (already + x - 1) == 0 else room - x for x in reach}
    assert total in reach and slack[total] == min(slack.values())


def test_plan_places_every_piece_once():
    histogram = {n: 1 + n * 7 % 13 for n in range(1, 200)} | {150: 100_000}
    shares = sp.plan_windows(histogram, 512)
    for n, count in histogram.items():
        spans = sorted((s.first, s.last) for s in shares if s.length == n)
        assert spans[0][0] == 0 and spans[-1][1] == count
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
