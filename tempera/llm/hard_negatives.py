"""Hard negatives by Four-Russians scoring: subset sums of anchors, indexed by bytes of candidate bits.

The integers of a candidate are cut into bit planes, eight dimensions to a byte. For every eight
dimensions of an anchor a table holds the sum of each of their 256 subsets, so one byte looks up eight products of
a plane; planes are added from the sign down, doubling in between, which gives full exact inner products. Anchors
and candidates are numbered by label and packed in blocks and shards of bounded size. A first pass scores the blocks
and shards that share a label and gives every anchor its positives; a second one scores all of them and keeps
the best negatives in each positive's range.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempera.catalog.registry import table
from tempera.llm.catalog import llm_query
from tempera.llm.support import numbered
from tempera.plans.staging import materialize

GROUP = 8
SHARD_ROWS, BLOCK_ANCHORS = 2048, 512
#: Blocks and shards that one task holds at a time.
BLOCKS_A_UNIT, SHARDS_A_UNIT = 2, 4
#: Anchors whose tables, and candidates whose sums, are in the cache at once.
CACHED_ANCHORS, CACHED_ROWS = 64, 1024
#: Keys of rows that do not count, for keys of 64 bits and for larger ones.
UNUSED = (-(1 << 63), -(1 << 90))
HITS = "dims int, block int, anchor int, slot int, vec_id long, score long"


def prepared(vectors: DataFrame, scale: float = 256.0, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, dims, v: floor(scale * x) of every component, x as double.

    Rows with a null id, label, vector or component, or with a component that is not finite, are left out.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(column).alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform("x", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    return rows.select("vec_id", "label", F.size("x").alias("dims"), whole.alias("v"))


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def bit_planes(v: np.ndarray) -> np.ndarray:
    """Bytes [plane, group of dimensions, row] of the two's complement of integers [row, dimension].

    There are as many planes as the largest number needs; the last one is the sign.
    """
    top = max(int(v.max(initial=0)), -1 - int(v.min(initial=0)))
    planes = [np.packbits(((v >> j) & 1).astype(np.uint8), axis=1, bitorder="little").T for j in range(min(top.bit_length(), 63))]
    sign = np.packbits((v < 0).astype(np.uint8), axis=1, bitorder="little").T
    return np.ascontiguousarray(np.stack([*planes, sign]))


def subset_sums(anchors: np.ndarray, dtype) -> np.ndarray:
    """[group, byte, anchor]: for each eight dimensions the sum of every subset of their components."""
    n, dims = anchors.shape
    groups = -(-dims // GROUP)
    padded = np.zeros((n, groups * GROUP), dtype=dtype)
    padded[:, :dims] = anchors
    sums = np.zeros((groups, 1 << GROUP, n), dtype=dtype)
    for d in range(GROUP):
        sums[:, 1 << d : 2 << d] = sums[:, : 1 << d] + padded[:, d::GROUP].T[:, None, :]
    return sums


def scores(anchors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Exact inner products [anchor, row] of whole numbers with the rows behind ``planes``."""
    depth, groups, rows = planes.shape
    bound = int(np.abs(anchors.astype(object)).sum(axis=1).max(initial=0)) << depth
    dtype = np.int32 if bound < 2**31 else np.int64 if bound < 2**62 else object
    out = np.zeros((len(anchors), rows), dtype=dtype)
    for a in range(0, len(anchors), CACHED_ANCHORS):
        sums = subset_sums(anchors[a : a + CACHED_ANCHORS], dtype)
        for lo in range(0, rows, CACHED_ROWS):
            index = planes[:, :, lo : lo + CACHED_ROWS].astype(np.intp)
            total = np.zeros((index.shape[2], sums.shape[2]), dtype=dtype)
            for j in reversed(range(depth)):
                if j < depth - 1:
                    total += total
                found = np.zeros_like(total)
                for g in range(groups):
                    found += np.take(sums[g], index[j, g], axis=0)
                total = total + found if j < depth - 1 else -found
            out[a : a + CACHED_ANCHORS, lo : lo + CACHED_ROWS] = total.T
    if dtype is object and out.size and max(int(out.max()), -1 - int(out.min())) >= 2**63:
        raise OverflowError("an inner product does not fit 64 bits")
    return out


def _sorted_keys(score: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, int]:
    """Per anchor, ascending: score * n + (n - 1 - row), so that ties put the earlier row last; and n."""
    n = score.shape[1]
    large = score.dtype == object or int(np.abs(score).max(initial=0)) >= 2**62 // max(1, n)
    key = score.astype(object if large else np.int64) * n + np.arange(n - 1, -1, -1)
    key[~usable] = UNUSED[large]
    return np.sort(key, axis=1), n


def _best(keys: np.ndarray, n: int, ids: np.ndarray, most: int, low: int | None = None, high: int | None = None) -> list[tuple[int, int]]:
    """(id, score) of the best ``most`` of an anchor's sorted keys, between the bounds if there are any."""
    end = len(keys) if high is None else int(np.searchsorted(keys, (high + 1) * n))
    out = []
    for key in keys[max(0, end - most) : end][::-1].tolist():
        score, back = divmod(key, n)
        if key in UNUSED or (low is not None and score < low):
            break
        out.append((int(ids[n - 1 - back]), score))
    return out


def _packed(rows: DataFrame, size: int, unit: int, planes: bool, name: str) -> DataFrame:
    """Rows packed, at most ``size`` together, by label number: dims, part, unit, labels, data."""

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["vec_id"], kind="stable")
        v = np.stack(rows["v"].to_numpy()).astype(np.int64) if key[0] else np.zeros((len(rows), 0), np.int64)
        label = rows["label"].to_numpy()
        data = _pack(ids=rows["vec_id"].to_numpy(), labels=label, v=bit_planes(v) if planes else v)
        return pd.DataFrame({"dims": [key[0]], "part": [key[1]], "unit": [key[1] // unit], "labels": [np.unique(label)], "data": [data]})

    hashed = rows.withColumn("_mix", F.xxhash64("vec_id"))
    placed = numbered(hashed, "dims", "label", "_mix", "vec_id", label=name).withColumn("_part", F.floor(F.col("_n") / size).cast("int"))
    packed = placed.select("vec_id", "label", "dims", "v", "_part").groupBy("dims", "_part")
    return materialize(packed.applyInPandas(pack, "dims int, part int, unit int, labels array<long>, data binary"), f"{name}-packed")


def _thinned(hits: list[tuple], most: int) -> list[tuple]:
    """The best ``most`` of each (anchor, slot)."""
    out, last, n = [], None, 0
    for h in sorted(hits, key=lambda h: (h[0], h[1], -h[3], h[2])):
        n = n + 1 if h[:2] == last else 1
        last = h[:2]
        if n <= most:
            out.append(h)
    return out


def alike(block: dict, shards: list[dict], most: int) -> list[tuple]:
    """(anchor, 0, id, score) of the best rows with the anchor's label."""
    hits = []
    for shard in shards:
        if not len(np.intersect1d(block["labels"], shard["labels"])):
            continue
        usable = (block["labels"][:, None] == shard["labels"]) & (block["ids"][:, None] != shard["ids"])
        keys, n = _sorted_keys(scores(block["v"], shard["v"]), usable)
        for a in np.flatnonzero(usable.any(axis=1)).tolist():
            hits += [(a, 0, *h) for h in _best(keys[a], n, shard["ids"], most)]
    return _thinned(hits, most)


def unlike(block: dict, shards: list[dict], most: int) -> list[tuple]:
    """(anchor, slot, id, score) of the best rows of other labels inside the range of each positive's slot."""
    hits = []
    ranges = [(int(a), int(slot), int(lo), int(hi)) for a, slot, lo, hi in block["ranges"] if lo <= hi]
    for shard in shards:
        usable = (block["labels"][:, None] != shard["labels"]) & (block["ids"][:, None] != shard["ids"])
        if not ranges or not usable.any():
            continue
        keys, n = _sorted_keys(scores(block["v"], shard["v"]), usable)
        for a, slot, lo, hi in ranges:
            hits += [(a, slot, *h) for h in _best(keys[a], n, shard["ids"], most, lo, hi)]
    return _thinned(hits, most)


def _meet(blocks: DataFrame, shards: DataFrame, units: DataFrame, work, most: int) -> DataFrame:
    """``work`` of every block with the shards of each unit (dims, b_unit, s_unit)."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = [_unpack(d) for d in right["data"]]
        out = []
        for dims, part, data, ranges in zip(left["dims"], left["part"], left["data"], left["ranges"]):
            wanted = [tuple(r.values()) for r in ranges]
            out += [(dims, part, *h) for h in work(_unpack(data) | {"ranges": wanted}, held, most)]
        names = ["dims", "block", "anchor", "slot", "vec_id", "score"]
        return pd.DataFrame(out, columns=names) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in names})

    keys = ["dims", "b_unit", "s_unit"]
    left = blocks.withColumnRenamed("unit", "b_unit").join(units, ["dims", "b_unit"]).select(*keys, "part", "data", "ranges")
    right = shards.withColumnRenamed("unit", "s_unit").join(units, ["dims", "s_unit"]).select(*keys, "data")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, HITS)


def _number(packed: DataFrame) -> DataFrame:
    """The ids of packed anchors by their place: dims, block, anchor, anchor_id."""

    def ids(batches):
        for batch in batches:
            for dims, part, data in zip(batch["dims"], batch["part"], batch["data"]):
                found = _unpack(data)["ids"]
                yield pd.DataFrame({"dims": dims, "block": part, "anchor": np.arange(len(found)), "anchor_id": found})

    return packed.select("dims", "part", "data").mapInPandas(ids, "dims int, block int, anchor int, anchor_id long")


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    shard_rows: int = SHARD_ROWS, block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Both frames are (vec_id, label, dims, v) as ``prepared`` makes them. An anchor's positives are its best
    ``positives`` rows of its label; a positive's negatives are the best ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Ties go to the smaller id.
    Rows with the anchor's own id are neither, nor are rows of another dimension. Rows that repeat
    an id count as often as they occur, as do anchors, whose results then repeat. Anchors without
    a positive, and positives without a negative, give no rows; an empty side gives none. Scores must fit 64 bits.
    """
    shards = _packed(vectors, shard_rows, SHARDS_A_UNIT, True, "shards")
    blocks = _packed(anchors, block_anchors, BLOCKS_A_UNIT, False, "blocks")
    b_units = blocks.select("dims", F.col("unit").alias("b_unit"), F.explode("labels").alias("label")).distinct()
    s_units = shards.select("dims", F.col("unit").alias("s_unit"), F.explode("labels").alias("label")).distinct()
    same = b_units.join(s_units, ["dims", "label"]).select("dims", "b_unit", "s_unit").distinct()
    place = ["dims", "block", "anchor"]
    unranged = blocks.withColumn("ranges", F.array().cast("array<struct<anchor:int,slot:int,lo:bigint,hi:bigint>>"))
    best = Window.partitionBy(*place).orderBy(F.desc("score"), "vec_id")
    found = _meet(unranged, shards, same, alike, positives).withColumn("slot", F.row_number().over(best)).filter(F.col("slot") <= positives)
    found = materialize(found, "positives")
    # Exact: score / 100 and the rest are scaled apart, so that no product leaves 64 bits.
    rest = F.pmod("score", F.lit(100))
    whole = F.expr("(score - pmod(score, 100)) div 100")
    lo, hi = whole * low + F.ceil(rest * low / 100), whole * high + F.floor(rest * high / 100)
    ranges = found.groupBy("dims", F.col("block").alias("part")).agg(F.collect_list(F.struct("anchor", "slot", lo.alias("lo"), hi.alias("hi"))).alias("ranges"))
    # Every block meets every shard: a stated query set against all rows, in blocks.
    last = shards.agg(F.max("unit")).first()[0]
    every = blocks.select("dims", F.col("unit").alias("b_unit")).distinct()
    every = every.withColumn("s_unit", F.explode(F.sequence(F.lit(0), F.lit(last)))) if last is not None else same
    fit = _meet(blocks.join(ranges, ["dims", "part"]), shards, every, unlike, negatives)
    order = Window.partitionBy(*place, "slot").orderBy(F.desc("score"), "vec_id")
    fit = fit.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    known = found.select(*place, "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return fit.join(known, [*place, "slot"]).join(_number(blocks), place).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""


@llm_query("op11_hard_negatives", SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = prepared(rows.select("vec_id", "embedding", moved.alias("label")))
    return hard_negatives(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
