import heapq
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tempera.llm import merge_dropout as md

PATH = md.default_model()
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
DOCS = "doc_id long, text string, ids string"
ODD = st.lists(st.sampled_from(["the ", " ", "  ", "\n", "▁", "\0", "été", "token", "123", "<s>", "ﬁ", "\t", "🙂", "ing "])).map("".join)


def _ids(text, doc_id=1, **kw):
    return np.frombuffer(md.encode_text(text, doc_id, PATH, **kw), "<u4").tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=50) | ODD)
def test_without_dropout_ids_are_the_library_s(text):
    text = text.replace("▁", "")
    assert _ids(text, dropout=0.0) == SP.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=50) | ODD, st.sampled_from([0.0, 0.1, 0.5, 1.0]), st.integers(-3, 3))
def test_every_segmentation_decodes_to_the_text(text, dropout, seed):
    ids = md.encode_text(text, 5, PATH, dropout=dropout, seed=seed)
    assert md.decode_ids(ids, PATH) == text


def test_dropout_varies_and_repeats():
    text = "international reconsideration of understanding " * 8
    plain = _ids(text, dropout=0.0)
    ways = {tuple(_ids(text, doc_id=d, dropout=0.2)) for d in range(20)}
    assert len(ways) > 10 and all(len(w) > len(plain) for w in ways)
    assert _ids(text, doc_id=3) == _ids(text, doc_id=3) != _ids(text, doc_id=3, seed=18)
    characters = _ids(text, dropout=1.0)
    assert len(characters) == len(text) + 1


def test_share_of_skipped_merges():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=2)) for _ in range(4000)]
    pieces = md._pieces(PATH)
    pairs = [w for w in words if w in pieces.rank]
    skipped = sum(len(pieces.segment(w, 0.3, key)) == 2 for key, w in enumerate(pairs))
    assert len(pairs) > 500 and abs(skipped / len(pairs) - 0.3) < 0.06


def test_frames(spark):
    docs = [(1, None), (2, ""), (3, "x" * 100_000), (4, "a b"), (4, "a b"), (None, "no id"), (7, "wort " * 30_000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], DOCS)
    got = md.decode(md.encode(df)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((i, t or "") for i, t in docs), key=repr)
    rows = md.round_trips(df).collect()
    assert all(r.lossless for r in rows) and len(rows) == len(docs)
    by = {(r.doc_id, r.ids_crc32) for r in rows if r.doc_id == 4}
    assert len(by) == 1
    assert md.encode(df.limit(0)).count() == md.round_trips(df.limit(0)).count() == 0


def test_every_occurrence_draws_for_itself():
    # Far more ways than four for one long word, each the agenda's own under the key of its place.
    word, n = " internationalisation", 3000
    pieces, keys = md._pieces(PATH), md.chunk_keys(n, 8, 17).tolist()
    ways = [tuple(pieces.ids(pieces.segment(word, 0.1, k))) for k in keys]
    assert len(set(ways)) > 20
    assert _ids((word * n)[1:], doc_id=8, dropout=0.1, seed=17) == [i for w in ways for i in w]


def test_merges_without_skips_are_remembered_not_drawn():
    text = "some words that repeat some words that repeat " * 30
    keys, chunks, pieces = md.chunk_keys(2000, 3, 5).tolist(), md._CHUNK.findall(" " + text), md._pieces(PATH)
    for dropout in (0.02, 0.5, 1.0):
        want = [i for c, k in zip(chunks, keys) for i in pieces.ids(pieces.segment(c, dropout, k))]
        assert _ids(text, doc_id=3, dropout=dropout, seed=5) == want


def naive(pieces, chunk, dropout, key):
    """Look at all neighbours anew before every merge; a candidate is the piece that two of them would be."""
    symbols = [(md.SPACE if c == " " else md.MARK if c == md.SPACE else c, i) for i, c in enumerate(chunk)]
    gone = set()
    while True:
        pairs = [(pieces.rank[a + b], i, a + b, k) for k, ((a, i), (b, _)) in enumerate(zip(symbols, symbols[1:])) if a + b in pieces.rank]
        pairs = [p for p in pairs if p[1:3] not in gone]
        if not pairs:
            return [s for s, _ in symbols]
        _, i, piece, k = min(pairs)
        h = (key + i * md._MIX[0] + pieces.id[piece] * md._MIX[1]) % 2**64
        h = (h ^ (h >> 30)) * md._MIX[1] % 2**64
        h = (h ^ (h >> 27)) * md._MIX[2] % 2**64
        if h ^ (h >> 31) < int(dropout * 2.0**64):
            gone.add((i, piece))
        else:
            symbols[k : k + 2] = [(piece, i)]


def test_ids_match_a_naive_agenda_whatever_is_remembered(monkeypatch):
    path = md.default_model()
    pieces = md._pieces(path)
    words = "the internationalisation of unbelievable été 12345 aaaaaaa ▁x unbelievable the the of".split()
    rng = random.Random(1)
    for remembered in (0, 3, 450_000):
        monkeypatch.setattr(md, "REMEMBERED", remembered)
        md._plain.cache_clear()
        for doc in range(40):
            text = " ".join(rng.choices(words, k=30))
            for dropout in (0.0, 0.1, 0.6, 1.0):
                chunks = md._CHUNK.findall(" " + text)
                keys = md.chunk_keys(len(chunks), doc, 5).tolist()
                want = [i for c, k in zip(chunks, keys) for i in pieces.ids(naive(pieces, c, dropout, k))]
                assert np.frombuffer(md.encode_text(text, doc, path, dropout, 5), "<u4").tolist() == want
    md._plain.cache_clear()


def test_new_words_are_not_merged_one_by_one(monkeypatch):
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 12))) for _ in range(3000))
    pieces, keys = md._pieces(PATH), md.chunk_keys(3000, 6, 5).tolist()
    want = [i for c, k in zip(md._CHUNK.findall(" " + text), keys) for i in pieces.ids(pieces.segment(c, 0.1, k))]
    agendas, heapify = [], heapq.heapify
    monkeypatch.setattr(heapq, "heapify", lambda agenda: agendas.append(1) or heapify(agenda))
    md._plain.cache_clear()
    assert _ids(text, doc_id=6, dropout=0.1, seed=5) == want
    assert not agendas
