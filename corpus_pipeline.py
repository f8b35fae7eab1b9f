"""From raw documents to packed training sequences, in stages that are written and read again in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempera.catalog.registry import table
from tempera.llm import bayes_dedup, disclosure, rule_quality, slack_packing
from tempera.plans.staging import materialize
from tempera.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least one half; an empty table stays empty."""
    ship_package(spark)
    model = rule_quality.fit(docs, table(spark, sf_dir, "labels"))
    return rule_quality.score_documents(docs, model).filter("q_score >= 0.5").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates.

    Rows that repeat a doc_id and its text (null is empty) stay once; rows of one doc_id with different texts all stay if that id does, as
    nothing tells which of them is meant. Rows without doc_id stay, one for each text.
    """
    ship_package(spark)
    kept = bayes_dedup.near_duplicates(docs, NEAR_PERCENT).filter("kept and doc_id is not null").select(F.col("doc_id").alias("_kept_id")).distinct()
    known = docs.join(kept, F.col("doc_id") == F.col("_kept_id"), "left_semi").withColumn(
        "_kept_text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    )
    known = known.dropDuplicates(["doc_id", "_kept_text"]).drop("_kept_text")
    return known.unionByName(docs.filter("doc_id is null").dropDuplicates(["text"]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced and revealing terms generalised or removed; n_chars follows."""
    ship_package(spark)
    kinds = [*disclosure.KINDS, "terms"]
    found = disclosure.personal_data(docs).filter(" or ".join(f"size({k}) > 0" for k in kinds))
    found = found.dropDuplicates(["doc_id", "text_key"]).withColumnRenamed("doc_id", "_found_id")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_found_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("text_key"))
    text = F.when(F.col("text_key").isNull(), F.col("text")).otherwise(disclosure.sanitised_text(F.col("text")))
    clean = docs.join(found, same, "left").withColumn("_clean", text)
    length = F.when(F.col("text_key").isNull(), F.col("n_chars")).otherwise(F.length("_clean").cast("long"))
    new = {"text": F.col("_clean").alias("text"), "n_chars": length.alias("n_chars")}
    return clean.select(*[new.get(c, F.col(c)) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    ship_package(spark)
    return slack_packing.pack(docs)


#: Near copies share at least so many hundredths of their word shingles; 85 is op8's own.
NEAR_PERCENT = 80

STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing)]

#: Tokenization and fitted scores have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
