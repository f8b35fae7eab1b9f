import re

import pytest
from .test_bayes_dedup import shingles
from .test_disclosure import base

import corpus_pipeline
from tempera.llm import rule_quality
from tempera.plans.staging import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs))
    return dict(out)


def test_quality_keeps_what_is_scored_good(spark, stages):
    docs, left = stages["documents"], stages["quality"]
    model = rule_quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in rule_quality.score_documents(docs, model).filter("q_score >= 0.5").collect()}
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == good
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()
    assert sum(r.doc_id in good for r in labels) >= 0.97 * len(labels)


def test_one_document_of_each_group_stays(stages):
    before, after = stages["quality"].collect(), stages["near_dedup"].collect()
    sets = {r.doc_id: shingles(r.text) for r in before}
    like = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    kept = {r.doc_id for r in after}
    for i, a in sets.items():
        smaller = [j for j, b in sets.items() if j < i and like(a, b)]
        assert (i in kept) == (not smaller) or any(like(sets[j], sets[k]) for j in smaller for k in sets if k < j)
    assert {r.doc_id: r.text for r in after}.items() <= {r.doc_id: r.text for r in before}.items()


def test_personal_data_is_gone(stages):
    before, after = {r.doc_id: r for r in stages["near_dedup"].collect()}, stages["personal_data"].collect()
    assert len(after) == len(before)
    for r in after:
        had = sum(base(before[r.doc_id].text).values(), [])
        assert r.n_chars == len(r.text) and (r.text == before[r.doc_id].text or had)
        assert not any(v in r.text for *_, v in had if not re.fullmatch(r"\W*", v))


def test_all_documents_are_packed(spark, stages):
    pieces = stages["packing"].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in stages["personal_data"].collect()}
    whole = {}
    for r in pieces:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert all(whole[r.doc_id] == r.doc_tokens for r in pieces)


def test_run_gives_the_rows_of_the_stages(spark, stages):
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32").collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages["packing"])


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _clean string, text_key long, q_score double"
    odd = [(None, None, None, None, None, "c", 1, 2.0), (1, None, "x", None, 0, None, None, None), (1, "", "x", None, 0, None, None, None)]
    odd += [(2, "mail a@b.cd now", None, None, 15, "c", 5, None)] * 2 + [(None, "mail a@b.cd now", None, None, 15, "c", 5, None)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for df in (plain,):
            kept = corpus_pipeline.near_dedup(spark, df, SF)
            assert kept.columns == df.columns
            assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == (
                sorted([(None, None), (None, "mail a@b.cd now"), (1, None), (2, "mail a@b.cd now")], key=repr) if rows else []
            ) or sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(None, None), (None, "mail a@b.cd now"), (1, ""), (2, "mail a@b.cd now")], key=repr)
            clean = corpus_pipeline.personal_data(spark, df, SF)
            assert clean.columns == df.columns
            assert sorted(repr(r.text) for r in clean.collect()) == (sorted(["None", "None", "''", *["'mail [EMAIL] now'"] * 3]) if rows else [])
            assert corpus_pipeline.packing(spark, kept, SF).count() == kept.count()


def test_near_copies_between_80_and_85_go(spark):
    # 100 shingles each; 90 in common make 90 / 110 = 0.818, 88 in common make 88 / 112 = 0.786.
    text = lambda own, n: " ".join([f"c{own // 10}x{i}" for i in range(n + 4)] + [f"o{own}x{i}" for i in range(100 - n)])
    docs = [(i, text(i, 90)) for i in (10, 11)] + [(i, text(i, 88)) for i in (20, 21)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SF).collect()) == [10, 20, 21]


def test_rows_that_share_an_id_keep_their_texts(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (1, " ".join(reversed(words))), (1, " ".join(words)), (2, " ".join(words)), (3, "quite another text than these"), (None, "a"), (None, "a")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
    assert left == sorted([rows[0], rows[1], rows[4], rows[5]], key=str)
