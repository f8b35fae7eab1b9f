import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tempera.llm import edit_counts as ec

PATH = ec.default_tokenizer()
WHOLE = Tokenizer.from_file(PATH)
WHOLE.encode_special_tokens = True
ODD = st.lists(st.sampled_from(["the", " ", "  ", "\n", "\t", "été", "'ll", "'", "12", "!?", "<|endoftext|>", "🙂", " of"]), max_size=25).map("".join)


def full(text):
    return len(WHOLE.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(ODD | st.text(max_size=40), st.lists(st.tuples(st.integers(-2, 60), st.integers(-2, 60), ODD), max_size=5), st.sampled_from([1, 2, 64]))
def test_edits_match_a_full_count(text, edits, leaf):
    old, ec.LEAF = ec.LEAF, leaf
    try:
        tree = ec.CountTree(text, ec.pre_token_counts(PATH))
        assert tree.total == full(text)
        for start, end, put in edits:
            a = min(max(start, 0), len(text))
            b = min(max(end, a), len(text))
            text = text[:a] + put + text[b:]
            tree.replace(start, end, put)
            assert tree.text == text and tree.total == full(text)
            assert [n for leaf in tree.leaves for n in leaf[0]] == list(map(len, tree.memory.pattern.findall(text)))
    finally:
        ec.LEAF = old


def test_an_edit_reads_little_of_a_long_text():
    rng = random.Random(4)
    text = " ".join(rng.choices(["some", "words,", "of", "a", "long", "text."], k=60_000))
    tree = ec.CountTree(text, ec.pre_token_counts(PATH))
    for _ in range(50):
        at = rng.randrange(len(tree.text))
        tree.replace(at, at + rng.randrange(30), rng.choice(["", "x", "new words here", " "]))
    assert tree.read_again < 50 * 120
    assert tree.total == full(tree.text)


def test_frame(spark):
    docs = [
        (1, None, None, "clash"), (2, "", [(0, 5, "put in")], None), (3, "same text here", [(5, 9, None), (0, 0, "x ")], None),
        (3, "same text here", [(5, 9, None), (0, 0, "x ")], None), (None, "no id", [], None), (4, "a" * 50_000, [(10, 20, " ")], None),
    ]
    df = spark.createDataFrame(docs, f"doc_id long, text string, edits {ec.EDITS}, n_tokens string")
    got = sorted((tuple(r)[:4] for r in ec.edited_counts(df).collect()), key=repr)
    expected = []
    for doc_id, text, edits, _ in docs:
        after = text or ""
        for a, b, put in edits or ():
            after = after[:a] + (put or "") + after[max(a, b) :]
        expected.append((doc_id, full(text or ""), full(after), len(after)))
    assert got == sorted(expected, key=repr)
    assert ec.edited_counts(df.limit(0)).count() == 0


def test_query_matches_full_counts(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in ec.op7_edit_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("edits", ec.sample_edits()).collect()
    assert len(rows) == len(docs)
    for d in docs:
        text = d.text
        for e in d.edits:
            a, b = min(e.start, len(text)), min(e.end, len(text))
            text = text[:a] + e.put + text[max(a, b) :]
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].edited_tokens) == (full(d.text), full(text))
