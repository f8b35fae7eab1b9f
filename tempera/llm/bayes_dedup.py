"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets are one class and only its representative goes on.
Signatures are banded; the documents of a bucket are tied to its smallest id, and the
connected pieces of that graph hold every banded pair inside. A piece is split into
chunks of bounded size, and pairs of chunks are the units of work. In a unit, pairs that share
a band are compared one signature batch at a time and dropped as soon as the posterior
probability of reaching the threshold falls below the chosen miss probability; survivors
are counted on their full sets. Pairs already connected are not counted again, so a
unit emits fewer links than it has documents, however many pairs agree.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempera.catalog.registry import table
from tempera.llm.catalog import llm_query
from tempera.llm.graph import connected_components
from tempera.llm.support import id_and_text, shuffle_width
from tempera.plans.staging import materialize

SHINGLE_WORDS = 5
#: Link if PERCENT[0] * intersection >= PERCENT[1] * union; near_duplicates takes other thresholds than PERCENT[1].
PERCENT = (100, 85)
BANDS, BAND_ROWS = 30, 6
BATCH = 30
#: A pair at the threshold escapes the bands with probability (1 - 0.85**6)**30 < 1e-6, and the pruning with at most this.
MISS = 1e-6
CHUNK_ROWS = 768
CHUNK_SHINGLES = 1_000_000

SEED = 20_240_229


def _drawn(bands: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    factors = rng.integers(0, 2**31, bands * BAND_ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return factors[:, None], rng.integers(0, 2**32, bands * BAND_ROWS, dtype=np.uint32)[:, None]


@functools.cache
def _family(bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and addends of the hash functions of a signature."""
    return _drawn(bands, np.random.default_rng(SEED))


_rng = np.random.default_rng(SEED)
_drawn(BANDS, _rng)
_STEPS = _rng.integers(1, 2**63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_for(percent: int) -> int:
    """Fewest bands that a pair at the threshold escapes with probability below MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-((percent / PERCENT[0]) ** BAND_ROWS)))


SIGNED = "doc_id long, n_shingles long, set_key binary, signature binary"


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z count as a-z, words end at ASCII white space.

    A text of fewer words than a shingle has its whole sequence as the only one; no words, no shingles.
    """
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE_WORDS:
        return np.asarray([xxhash.xxh64_intdigest(b" ".join(words), 1)], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - SHINGLE_WORDS + 1
    out = np.zeros(n, np.uint64)
    for i, step in enumerate(_STEPS):
        out += h[i : i + n] * step
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """Minimum of every hash function over a set."""
    factors, addends = _family(bands)
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    best = np.full(bands * BAND_ROWS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 2048):
        h = x[None, i : i + 2048] * factors + addends
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(best, h.min(axis=1), out=best)
    return best


def _set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signed_documents(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """One row per document with its set size, set key and signature; key and signature are null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, signatures = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py())
                sizes.append(len(s))
                keys.append(_set_key(s) if len(s) else None)
                signatures.append(signature(s, bands).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "signature"],
            )

    return id_and_text(docs).mapInArrow(sign, SIGNED)


@functools.cache
def least_matches(seen: int, percent: int = PERCENT[1]) -> int:
    """Fewest equal signature places of ``seen`` that keep a pair.

    From a uniform prior, the similarity has a Beta posterior, and its chance to reach the
    threshold t is that of a binomial of ``seen`` + 1 trials at t not to exceed the matches.
    """
    t, chance = percent / PERCENT[0], 0.0
    for m in range(seen + 1):
        chance += math.comb(seen + 1, m) * t**m * (1 - t) ** (seen + 1 - m)
        if chance >= MISS:
            return m
    return seen


def surviving_pairs(
    sig: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int = PERCENT[1]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (left[i], right[j]) that share a band, fit in size and survive the batches; with their matches.

    ``left`` and ``right`` are row numbers; where they are the same rows, only i < j.
    """
    same = left is right
    n_bands = sig.shape[1] // BAND_ROWS
    bands = np.ascontiguousarray(sig).view(f"V{4 * BAND_ROWS}")
    codes = np.stack([np.unique(bands[:, b], return_inverse=True)[1] for b in range(n_bands)], axis=1).astype(np.int32)
    xs, ys, ms = [], [], []
    width = len(right)
    for i in range(0, len(left), max(1, 200_000 // max(1, width))):
        rows = left[i : i + max(1, 200_000 // max(1, width))]
        share = np.zeros((len(rows), width), dtype=bool)
        for b in range(n_bands):
            share |= codes[rows, b][:, None] == codes[right, b][None, :]
        small, large = np.minimum.outer(sizes[rows], sizes[right]), np.maximum.outer(sizes[rows], sizes[right])
        share &= PERCENT[0] * small >= percent * large
        if same:
            share &= np.arange(i, i + len(rows))[:, None] < np.arange(width)[None, :]
        x, y = np.nonzero(share)
        x, y = rows[x], right[y]
        matches = np.zeros(len(x), np.int32)
        for seen in range(0, sig.shape[1], BATCH):
            if not len(x):
                break
            matches += (sig[x, seen : seen + BATCH] == sig[y, seen : seen + BATCH]).sum(axis=1, dtype=np.int32)
            on = matches >= least_matches(min(seen + BATCH, sig.shape[1]), percent)
            x, y, matches = x[on], y[on], matches[on]
        xs.append(x)
        ys.append(y)
        ms.append(matches)
    return np.concatenate(xs or [np.zeros(0, int)]), np.concatenate(ys or [np.zeros(0, int)]), np.concatenate(ms or [np.zeros(0, int)])


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = b.searchsorted(a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return PERCENT[0] * both >= percent * (len(a) + len(b) - both)


def unit_links(
    nodes: list[int], texts: list[str], sizes: np.ndarray, sig: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int = PERCENT[1]
) -> list[tuple[int, int]]:
    """Exactly verified links that connect what the pairs of a unit connect."""
    x, y, matches = surviving_pairs(sig, sizes, left, right, percent)
    root, sets, links = list(range(len(nodes))), {}, []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def shingles(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_set(texts[i])
        return sets[i]

    for p in np.argsort(-matches, kind="stable"):
        i, j = int(x[p]), int(y[p])
        a, b = find(i), find(j)
        if a != b and _linked(shingles(i), shingles(j), percent):
            root[a] = b
            links.append((nodes[i], nodes[j]))
    return links


def _one_text_each(rows: list[tuple]) -> list[tuple]:
    """A doc_id that repeats joins with each of its texts; keep the one a signature was made from."""
    kept: dict[tuple, tuple] = {}
    for row in rows:
        key = (row[4], row[6])
        if key not in kept:
            kept[key] = row
        elif kept[key][7] != row[7] and signature(shingle_set(row[7]), len(row[6]) // (4 * BAND_ROWS)).tobytes() == row[6]:
            kept[key] = row
    return list(kept.values())


def _verify_units(units: DataFrame, percent: int) -> DataFrame:
    """Links of all units; the rows of a unit are neighbours in their partition."""

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = _one_text_each(rows)
        if len(rows) > 1:
            first = rows[0][2]
            nodes, texts = [r[4] for r in rows], [r[7] for r in rows]
            sizes = np.asarray([r[5] for r in rows], np.int64)
            sig = np.frombuffer(b"".join(r[6] for r in rows), np.uint32).reshape(len(rows), -1)
            chunk = np.asarray([r[3] for r in rows])
            whole = rows[0][1] == first
            left = np.arange(len(rows)) if whole else np.flatnonzero(chunk != first)
            links = unit_links(nodes, texts, sizes, sig, left, left if whole else np.flatnonzero(chunk == first), percent)
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[:3] != rows[0][:3]:
                    yield from flush(rows)
                    rows = []
                rows.append(row)
        yield from flush(rows)

    columns = ["piece", "low", "high", "chunk", "node", "n_shingles", "signature", "text"]
    return units.select(*columns).mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT[1]) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document.

    Sets whose intersection is at least ``percent`` hundredths of their union are linked.
    component_id is the smallest doc_id reachable over links, kept tells whether it is the document's own. Rows
    with one doc_id are one vertex. Documents without words are linked with nothing. A row without
    doc_id takes the component of documents with its shingles; it has none, and is kept, if
    there are no such. An empty table gives no rows; other columns are ignored.
    """
    width = shuffle_width(docs.sparkSession)
    n_bands = bands_for(percent)
    signed = materialize(signed_documents(docs, n_bands), "signed")
    worded = signed.filter("set_key is not null")
    classes = worded.groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    )
    classes = materialize(classes.filter("node is not null"), "classes")

    size = 4 * BAND_ROWS
    bands = classes.select(
        "node",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(n_bands - 1)),
                lambda b: F.xxhash64(b, F.substring("signature", b * size + 1, F.lit(size))),
            )
        ).alias("bucket"),
    )
    leaders = bands.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    ties = bands.join(leaders, "bucket").filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    pieces = materialize(connected_components(ties).withColumnRenamed("component", "piece"), "pieces")

    members = pieces.join(classes, "node")
    chunks = members.groupBy(F.col("piece").alias("p")).agg(
        F.greatest(F.ceil(F.count("*") / CHUNK_ROWS), F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES)).cast("int").alias("chunks")
    )
    texts = id_and_text(docs)
    units = (
        members.join(chunks, F.col("piece") == F.col("p"))
        .withColumn("chunk", F.pmod(F.xxhash64("node", "set_key"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "piece", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk",
            "node", "n_shingles", "signature",
        )
        .join(texts, F.col("node") == F.col("doc_id"))
        .repartition(width, "piece", "low", "high")
        .sortWithinPartitions("piece", "low", "high")
    )
    links = materialize(_verify_units(units, percent), "near-links")
    components = connected_components(links)
    classed = classes.select("set_key", "node").join(components, "node", "left").select(
        F.col("set_key").alias("c_key"), F.coalesce("component", "node").alias("c_component")
    )
    labelled = signed.join(classed, F.col("set_key") == F.col("c_key"), "left")
    component = F.coalesce("c_component", "doc_id")
    return labelled.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
    )


SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'),
    lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE_WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE_WORDS} + 2),
      lambda i: array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING {PERCENT[0]} * count(*) >= {PERCENT[1]} * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.y) AS component_id, s.doc_id = min(r.y) AS kept
FROM sets s JOIN reach r ON s.doc_id = r.x GROUP BY s.doc_id, len(s.s)
"""


@llm_query("op8_bayes_dedup", SQL)
def op8_bayes_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85)
