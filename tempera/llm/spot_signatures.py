"""Spot-signature fingerprints: chains of content words behind common words.

Every common word of a text is an anchor; the content words that follow it form a chain, and the
set of hashed (anchor, chain) signatures is the document's fingerprint. Two sets can
only be alike if their sizes are, so sets are compared within size partitions and a
comparison stops where the sizes rule the threshold out. DataFrame expressions only.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempera.catalog.registry import table
from tempera.llm.catalog import llm_query
from tempera.llm.support import shuffle_width, text_or_empty

#: Common words of four languages; their order and number only shape the fingerprint.
ANCHORS = tuple(
    "a an and are as at be by for from in is it of on or that the this to was with "
    "als auch auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au aux avec ce dans des du en est et la le les ne par pas pour que qui sur un une "
    "al con de del el los las no para por se su y".split()
)
#: One word form in so many, picked by hash, is an anchor too, so texts without common words have signatures.
ODD_ANCHORS = 16
CHAIN = 2
THRESHOLD = 0.8


def _anchor(word: Column) -> Column:
    return word.isin(*ANCHORS) | (F.pmod(F.xxhash64(word), F.lit(ODD_ANCHORS)) == 0)


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """Add the sorted distinct signatures of a text column; a text without words has none.

    Words are lower-cased runs of letters and digits. The start of the text is an anchor;
    chains skip other anchors and are shorter at the end of the text.
    """
    w, c = f"_{out}_words", f"_{out}_content"
    df = df.withColumn(w, F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    df = df.withColumn(c, F.filter(w, lambda x: ~_anchor(x)))
    places = F.filter(F.transform(w, lambda x, i: F.when(_anchor(x), i).otherwise(-1)), lambda i: i >= 0)

    # Before the k-th anchor stand `i` words, k of them anchors, so its chain begins at content word i - k.
    def chained(i: Column, k: Column) -> Column:
        return F.hash(F.get(w, i), *[F.get(c, i - k + j) for j in range(chain)])

    first = F.hash(F.lit("^"), *[F.get(c, F.lit(j)) for j in range(chain)])
    every = F.concat(F.transform(places, chained), F.array(first))
    signed = F.when(F.size(w) > 0, F.sort_array(F.array_distinct(every))).otherwise(F.array().cast("array<int>"))
    return df.withColumn(out, signed).drop(w, c)


def fingerprint(signatures: Column) -> Column:
    return F.array_join(signatures.cast("array<string>"), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; two empty sets are alike."""
    shared = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - shared
    return F.when(whole == 0, F.lit(1.0)).when(F.least(F.size(a), F.size(b)) == 0, F.lit(0.0)).otherwise(shared / whole)


def size_partition(size: Column, threshold: float = THRESHOLD) -> Column:
    """Partition of a set size; sets as alike as the threshold are in the same or in neighbouring partitions."""
    if threshold >= 1:
        return size.cast("int")
    return F.floor(F.log(size.cast("double")) / F.lit(math.log(1 / threshold)) + F.lit(1e-9)).cast("int")


def near_pairs(signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, likeness) of the pairs a < b with likeness >= threshold, from (doc_id, signatures) with unique doc_id.

    Sets meet in size partitions through an inverted index of their first signatures in one global order (rarest
    first): sets that are alike share one of them. Partners whose sizes rule the threshold out are not compared.
    """
    sets = signed.filter(F.size("signatures") > 0).withColumn("n", F.size("signatures"))
    counts = sets.select(F.explode("signatures").alias("s")).groupBy("s").agg(F.count("*").alias("df"))
    ranked = (
        sets.select("doc_id", "n", F.explode("signatures").alias("s")).join(counts, "s")
        .groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("r"))
    )
    prefix = F.slice("r", 1, (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    index = ranked.select("doc_id", "n", size_partition(F.col("n"), threshold).alias("part"), F.explode(prefix).alias("x"))
    index = index.select("doc_id", "n", "part", F.col("x.s").alias("s"))
    probe = index.select(
        F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"),
        F.col("part").alias("own"), "s",
    )
    fits = F.least("n", "n_b") >= F.greatest("n", "n_b") * threshold - 1e-9
    once = (F.col("own") != F.col("part")) | (F.col("doc_id") < F.col("b"))
    met = index.join(probe, ["part", "s"]).filter(fits & once & (F.col("doc_id") != F.col("b")))
    met = met.select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")).distinct()
    one = signed.select(F.col("doc_id").alias("a"), F.col("signatures").alias("_a"))
    two = signed.select(F.col("doc_id").alias("b"), F.col("signatures").alias("_b"))
    compared = met.join(one, "a").join(two, "b").withColumn("likeness", likeness(F.col("_a"), F.col("_b")))
    return compared.filter(F.col("likeness") >= threshold - 1e-12).select("a", "b", "likeness")


def with_next(docs: DataFrame, parts: int) -> tuple[DataFrame, Window]:
    """Documents by ranges of doc_id, with the first document of the next range behind each range.

    Returns (doc_id, text, _key, _part, _guest) and the window that orders a range. Guests only
    serve as the next document of a range's last one and have to be filtered out; the range after the last is the first.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    base = base.withColumn("_key", F.xxhash64("text"))
    points = [i / parts for i in range(1, parts)] or [0.5]
    bounds = base.agg(F.percentile_approx("doc_id", points, 20 * parts)).first()[0] or []
    splits = [-math.inf, *sorted({float(b) for b in bounds}), math.inf]
    dealt = base.withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308)))
    if len(splits) > 2:
        dealt = Bucketizer(splits=splits, inputCol="_id", outputCol="_part").transform(dealt)
    else:
        dealt = dealt.withColumn("_part", F.lit(0.0))
    dealt = dealt.withColumn("_part", F.col("_part").cast("int")).drop("_id")
    # One row a range: the first (doc_id, _key), and the range before.
    heads = dealt.groupBy("_part").agg(F.min(F.struct("doc_id", "_key")).alias("h"))
    order = Window.orderBy("_part")
    around = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("_part").over(order), F.last("_part").over(around))
    heads = heads.select(F.col("h.doc_id").alias("h_id"), F.col("h._key").alias("h_key"), before.alias("h_part"))
    guests = dealt.join(
        F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("_key") == F.col("h_key"))
    ).select("doc_id", "text", "_key", F.col("h_part").alias("_part"), F.lit(1).alias("_guest"))
    every = dealt.select("doc_id", "text", "_key", "_part", F.lit(0).alias("_guest")).unionByName(guests)
    return every, Window.partitionBy("_part").orderBy("_guest", F.asc_nulls_first("doc_id"), "_key")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document, of its edited text, and their likenesses.

    The edited text has the last quarter of its code points replaced by the first as many of the next
    document by doc_id. Null texts are empty. Rows are ordered by doc_id (null first) and a hash of the text, so rows that
    repeat follow each other; a single document is its own next one; an empty table gives
    no rows; other columns are ignored.
    """
    every, window = with_next(docs, shuffle_width(docs.sparkSession))
    following = every.withColumn("_next", F.lead("text").over(window)).withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("_next", F.lit(1), quarter)
    )
    following = following.withColumn("_edited", F.coalesce(edited, F.lit("")))
    signed = with_signatures(with_signatures(following, "text", "_sig"), "_edited", "_edited_sig")
    signed = signed.select(
        "doc_id", "_key", "_part", "_guest", "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), "_sig", "_edited_sig",
    )
    return signed.withColumn("_next_sig", F.lead("_sig").over(window)).filter("_guest = 0").select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("_sig")).alias("fingerprint"),
        fingerprint(F.col("_edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("_sig"), F.col("_edited_sig")).alias("near_edited"),
        likeness(F.col("_sig"), F.col("_next_sig")).alias("near_next"),
    )


@llm_query("op10_spot_signatures")
def op10_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
