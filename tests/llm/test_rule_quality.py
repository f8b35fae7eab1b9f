import zlib

import pytest
from pyspark.sql import functions as F

from tempera.llm import rule_quality as rq

SF = "/root/testdata/sf0.01"


def test_statistics_of_odd_texts(spark):
    texts = [None, "", " \n ", "WORT!! WORT!!", "a | b | c", "x" * 200_000, "ein Wort, zwei.\nein Wort, zwei.", "№ 12 ½"]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)], "doc_id long, text string, q_words int, _q_x string")
    rows = rq.with_statistics(df.drop("q_words")).orderBy("doc_id").collect()
    for r in rows[:2]:
        assert all(r[f"q_{s}"] == 0 for s in rq.STATISTICS)
    assert rows[2].q_words == rows[2].q_symbol_share == 0
    assert rows[3].q_words == 2 and rows[3].q_shout_share == 2 and rows[3].q_distinct_share == 0.5
    assert rows[4].q_bar_share == pytest.approx(2 / 5)
    assert rows[5].q_word_chars == 200_000
    assert rows[6].q_distinct_line_share == 0.5 and rows[6].q_stop_share == pytest.approx(2 / 6)
    assert rows[0]["_q_x"] == "c"


def test_held_out_accuracy(spark):
    scored = rq.op4_rule_quality(spark, SF)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in scored.collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    labels = [x for x in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[x.doc_id].held_out]
    right = sum(rows[x.doc_id].predicted == x.quality for x in labels)
    kept = [rows[x.doc_id].predicted for x in labels if x.quality == 1]
    assert right / len(labels) > 0.97 and sum(kept) / len(kept) > 0.98


def test_compiled_rules_add_up(spark):
    model = rq.RuleModel(-1.0, (((("words", True, 3.0),), 2.0), ((("words", False, 1.0), ("odd_share", True, 0.0)), -0.5)))
    df = spark.createDataFrame([(1, "a"), (2, "a b"), (3, "a b c d"), (4, "a # b")], "doc_id long, text string")
    got = {r.doc_id: r.q_score for r in rq.score_documents(df, model).collect()}
    logistic = lambda x: 1 / (1 + 2.718281828459045**-x)
    assert got == pytest.approx({1: logistic(1.0), 2: logistic(0.5), 3: logistic(-1.5), 4: logistic(1.0)})


def test_few_or_no_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "x") for i in range(30)] + [(None, None, "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.q_score for r in rq.score_documents(docs, rq.fit(docs, labels)).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, None) for i in range(30)] + [(None, 0, None), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert all(r.q_score > 0.9 for r in rq.score_documents(docs, rq.fit(docs, one)).collect())
    assert rq.score_documents(docs.limit(0), rq.fit(docs.limit(0), one)).count() == 0


def test_held_out_labels_are_never_used(spark):
    docs = spark.createDataFrame([(i, "good text here." if i % 2 else "### ### ###") for i in range(300)], "doc_id long, text string")
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    wrong = labels.withColumn("quality", F.when(rq.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    assert rq.fit(docs, labels) == rq.fit(docs, wrong)


def test_the_model_does_not_depend_on_the_layout(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = rq.fit(docs, labels)
    assert model.rules and model == rq.fit(docs.repartition(7), labels.repartition(5)) == rq.fit(docs.orderBy("n_chars"), labels)
