"""Quality scores by a sparse ensemble of rules over text statistics.

Trees are grown on a bounded sample of labelled documents; every path from a root to a
node is a rule, a conjunction of comparisons of statistics. A logistic
regression with an absolute-value penalty keeps the rules that matter, and these are compiled
into one Column expression, so scoring is a single scan without Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempera.catalog.registry import table
from tempera.llm.catalog import llm_query
from tempera.llm.support import about, text_or_empty
from tempera.plans.staging import materialize

#: Most labelled rows a model is fitted on; drawn by hash of the id.
SAMPLE_ROWS = 20_000
TREES = 16
DEPTH = 4
PENALTY = 0.002

STATISTICS = (
    "words", "word_chars", "distinct_share", "upper_share", "digit_share", "symbol_share", "odd_share", "bar_share",
    "shout_share", "line_words", "distinct_line_share", "stop_share",
)


_HELPERS = tuple(f"_q_{x}" for x in ("text", "rest", "rest2", "rest3", "rest4", "words", "lines", "n"))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the statistics of the whole text, prefixed ``q_``; null and empty texts have 0 everywhere.

    Letters, digits and white space are taken away one after the other, so each pattern only
    meets what the ones before have left.
    """
    body = docs.withColumn("_q_text", text_or_empty(text))
    body = body.withColumns({
        "_q_rest": F.regexp_replace("_q_text", r"\p{Ll}+", ""),
        "_q_words": F.filter(F.split("_q_text", r"\s+"), lambda w: w != ""),
        "_q_lines": F.filter(F.split("_q_text", "\n"), lambda x: x != ""),
        "_q_n": F.length("_q_text"),
    })
    body = body.withColumn("_q_rest2", F.regexp_replace("_q_rest", r"[\p{Lu}\p{Lo}\p{Lt}\p{Lm}\p{M}]+", ""))
    body = body.withColumn("_q_rest3", F.regexp_replace("_q_rest2", r"\p{N}+", ""))
    body = body.withColumn("_q_rest4", F.regexp_replace("_q_rest3", r"\s+", ""))

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(part / F.when(whole > 0, whole), F.lit(0.0))

    n, words, lines = F.col("_q_n"), F.size("_q_words"), F.size("_q_lines")
    size = F.length
    solid = n - (size("_q_rest3") - size("_q_rest4"))
    values = {
        "words": words.cast("double"),
        "word_chars": share(solid, words),
        "distinct_share": share(F.size(F.array_distinct("_q_words")), words),
        "upper_share": share(size("_q_rest") - size("_q_rest2"), n),
        "digit_share": share(size("_q_rest2") - size("_q_rest3"), n),
        "symbol_share": share(size("_q_rest4"), n),
        "odd_share": share(size(F.regexp_replace("_q_rest4", "[.,;:'\"()-]+", "")), words),
        "bar_share": share(size("_q_rest4") - size(F.replace("_q_rest4", F.lit("|"), F.lit(""))), words),
        "shout_share": share(size("_q_rest4") - size(F.replace("_q_rest4", F.lit("!"), F.lit(""))), words),
        "line_words": share(words, lines),
        "distinct_line_share": share(F.size(F.array_distinct("_q_lines")), lines),
        "stop_share": share(size("_q_rest4") - size(F.replace("_q_rest4", F.lit("."), F.lit(""))), words),
    }
    body = body.withColumns({f"q_{k}": values[k].cast("double") for k in STATISTICS})
    return body.drop(*_HELPERS)


@dataclass(frozen=True)
class RuleModel:
    """bias + sum of the weights of the rules that hold; a rule is a tuple of (statistic, is <=, threshold)."""

    bias: float
    rules: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...]

    def score(self) -> Column:
        total = reduce(
            lambda a, b: a + b,
            [F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0)) for rule, weight in self.rules],
            F.lit(float(self.bias)),
        )
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule) -> Column:
    parts = [(F.col(f"q_{s}") <= t) if below else (F.col(f"q_{s}") > t) for s, below, t in rule]
    return reduce(lambda a, b: a & b, parts)


def _simplest(path: tuple) -> tuple:
    """One comparison per statistic and direction, in a fixed order, so that equal rules look equal."""
    best: dict[tuple[str, bool], float] = {}
    for s, below, t in path:
        old = best.get((s, below), t)
        best[s, below] = min(old, t) if below else max(old, t)
    return tuple(sorted((s, below, t) for (s, below), t in best.items()))


def tree_rules(forest) -> list[tuple]:
    """Distinct rules of all root-to-node paths of a fitted forest."""
    found: dict[tuple, None] = {}

    def walk(node, path: tuple) -> None:
        if path:
            found[_simplest(path)] = None
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            name, at = STATISTICS[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), path + ((name, True, at),))
            walk(node.rightChild(), path + ((name, False, at),))

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), ())
    return list(found)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH,
    penalty: float = PENALTY, seed: int = 11,
) -> RuleModel:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out third.

    The same rows give the same model, however they are partitioned. Labels that are null or not 0 or 1 are skipped; a
    document labelled twice counts with its smaller label. Without labels every score is 0.5; with labels of one kind it is near that label.
    """
    known = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("l_doc_id")).agg(F.min("quality").cast("double").alias("label"))
    )
    known = about(known, sample_rows, labels.count(), "l_doc_id")
    known = known.orderBy(F.xxhash64("l_doc_id"), "l_doc_id").limit(sample_rows)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(known), F.col("doc_id") == F.col("l_doc_id")  # at most sample_rows rows of two numbers
    )
    features = array_to_vector(F.array(*[f"q_{s}" for s in STATISTICS]))
    narrow = with_statistics(chosen).select("label", "l_doc_id", *[f"q_{s}" for s in STATISTICS])
    # A bounded sample in one task and one order, so that the model is a function of the rows and not of how they lie.
    ordered = narrow.repartition(1).sortWithinPartitions("l_doc_id", *[f"q_{s}" for s in STATISTICS])
    sample = materialize(ordered.drop("l_doc_id"), "quality-sample")
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return RuleModel(0.0 if not counts else 4.0 if 1.0 in counts else -4.0, ())
    data = sample.select("label", features.alias("features"))
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, subsamplingRate=0.7, seed=seed, featureSubsetStrategy="0.6", maxBins=64
    ).fit(data)
    rules = tree_rules(forest)
    if not rules:
        return RuleModel(0.0, ())
    flags = F.array(*[holds(r).cast("double") for r in rules])
    lasso = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=100).fit(
        sample.select("label", array_to_vector(flags).alias("features"))
    )
    weights = lasso.coefficients.toArray().tolist()
    return RuleModel(float(lasso.intercept), tuple((r, w) for r, w in zip(rules, weights) if w != 0.0))


def score_documents(docs: DataFrame, model: RuleModel) -> DataFrame:
    """All columns of ``docs`` with ``q_score`` (0 to 1) added."""
    scored = with_statistics(docs).withColumn("q_score", model.score())
    return scored.drop(*(f"q_{s}" for s in STATISTICS))


@llm_query("op4_rule_quality")
def op4_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels)
    scored = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("q_score").alias("score"),
        (F.col("q_score") >= 0.5).cast("int").alias("predicted"),
    )
