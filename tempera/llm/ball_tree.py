"""Exact top-k inner-product search: a ball tree per shard, searched by branch and bound.

Rows are dealt over shards of bounded size by a hash of their id. A shard is one packed
row: its vectors in leaf order and, level by level, the balls around them. Queries
come in packed blocks. A block meets a shard in one pass: balls are kept while
q.c + |q|r can still reach a query's k-th score, and a leaf is opened by one matrix product for
all queries of the block that it may serve; what it holds may raise their scores. All queries search
one pilot shard first; the k-th scores found there are the starting bar in every other shard. A task holds a
group of shards against a group of blocks, and a block's bars go on from shard to shard.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempera.catalog.registry import table
from tempera.llm.catalog import llm_query
from tempera.plans.staging import materialize

SHARD_ROWS = 4096
LEAF_ROWS = 64
BLOCK_QUERIES = 512
#: Blocks and shards that one task holds at a time.
BLOCKS_A_UNIT, SHARDS_A_UNIT = 16, 16
#: Parts of a shuffle at most.
MOST_PARTS = 10_000
#: Rows found, by query of a block, before the best are picked from them, and for a block at least.
ROOM, LEAST_ROOM = 16, 4096
#: Room for rounding in a bound; scores themselves are exact integers.
SLACK = 1e-9
EXACT32, EXACT = 2**24, 2**53
LOWEST, HIGHEST = -(2**63), 2**63 - 1

HITS = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: float = 64.0) -> DataFrame:
    """vec_id, dims, v: floor(scale * x) of every component; rows with a null id, vector or component, or with a
    component that is not finite, are left out."""
    sound = F.forall(
        column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    return (
        vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias(column))
        .filter(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & sound)
        .select(
            "vec_id",
            F.size(column).alias("dims"),
            F.transform(column, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"),
        )
    )


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def _compact(m: np.ndarray) -> np.ndarray:
    """Integers in the smallest type that holds them."""
    top = int(np.abs(m).max()) if m.size else 0
    return m.astype(np.int8 if top < 2**7 else np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64)


def build_tree(ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """A balanced ball tree: 2**depth leaves of equal size (give or take one), balls of all levels from the root on."""
    x = vectors.astype(np.float64)
    depth = max(0, math.ceil(math.log2(max(1, len(ids)) / leaf_rows)))
    order, cuts = np.arange(len(ids)), [0, len(ids)]
    centers, radii = [], []
    for level in range(depth + 1):
        following = [0]
        for a, b in zip(cuts, cuts[1:]):
            rows = x[order[a:b]]
            center = rows.mean(axis=0) if b > a else np.zeros(x.shape[1])
            away = ((rows - center) ** 2).sum(axis=1) if b > a else np.zeros(1)
            centers.append(center)
            radii.append(math.sqrt(away.max()))
            if level < depth:
                if b > a:
                    far = rows[away.argmax()]
                    other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
                    order[a:b] = order[a:b][np.argsort(rows @ (other - far), kind="stable")]
                following += [(a + b) // 2, b]
        if level < depth:
            cuts = following
    norms = np.sqrt((x[order] ** 2).sum(axis=1))
    return {
        "ids": ids[order], "vectors": _compact(vectors[order]), "cuts": np.asarray(cuts),
        "centers": np.asarray(centers), "radii": np.asarray(radii),
        "tops": np.asarray([norms[a:b].max(initial=0) for a, b in zip(cuts, cuts[1:])]),
    }


class Shard:
    """A tree with what its search needs beside it."""

    def __init__(self, tree: dict[str, np.ndarray]):
        self.ids, self.vectors, self.cuts, self.tops = tree["ids"], tree["vectors"], tree["cuts"], tree["tops"]
        self.centers, self.radii = tree["centers"], tree["radii"]
        self.away = np.sqrt((self.centers**2).sum(axis=1))
        self.x32 = self.vectors.astype(np.float32)


class Block:
    """Queries, the k best (score, id) found for each so far, and its bar: what any other row must reach.

    A row reaches the bar with a larger score, or with the same one and no larger id. ``bar`` is LOWEST until there is one.
    """

    def __init__(self, packed: dict[str, np.ndarray], k: int):
        self.qids, self.q, self.bar, self.tie, self.k = packed["ids"], packed["q"], packed["bar"], packed["tie"], k
        self.qf, self.q32 = self.q.astype(np.float64), self.q.astype(np.float32)
        self.norm = np.sqrt((self.qf**2).sum(axis=1))
        self.row, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.room = max(LEAST_ROOM, ROOM * len(self.qids))
        self._found: list[tuple[np.ndarray, ...]] = []
        self._rows = 0
        self._limit()

    def _limit(self) -> None:
        self.limit = np.where(self.bar > LOWEST, self.bar, -np.inf)
        self.limit32 = self.limit.astype(np.float32)

    def offer(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self._found.append((row, score, ids))
        self._rows += len(row)
        if self._rows >= self.room:
            self.settle()

    def settle(self) -> None:
        """Pick the best of what was found, and raise the bars."""
        if not self._found:
            return
        row, score, ids = (np.concatenate(x) for x in zip(*self._found))
        self._found, self._rows = [], 0
        bar = self.bar[row]
        fit = np.flatnonzero((ids != self.qids[row]) & ((score > bar) | ((score == bar) & (ids <= self.tie[row]))))
        row, score, ids = (np.concatenate([x, y[fit]]) for x, y in ((self.row, row), (self.score, score), (self.ids, ids)))
        # Ascending by the bitwise complement is descending by score, also for the lowest number.
        order = np.lexsort((ids, ~score, row))
        row, score, ids = row[order], score[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(self.qids)))[row]
        last = place == self.k - 1
        self.bar[row[last]], self.tie[row[last]] = score[last], ids[last]
        self.row, self.score, self.ids = (x[place < self.k] for x in (row, score, ids))
        self._limit()


def _reached(shard: Shard, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Leaves that some query must open, and [leaf, query] the bounds; -inf where the leaf is out of reach."""
    depth = (len(shard.cuts) - 1).bit_length() - 1
    nodes, live = np.zeros(1, np.int64), np.ones((1, len(block.qids)), dtype=bool)
    for level in range(depth + 1):
        if level:
            nodes, live = np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([live, live])
        at = nodes + (1 << level) - 1
        bound = shard.centers[at] @ block.qf.T + shard.radii[at][:, None] * block.norm
        bound += SLACK * (1.0 + np.abs(bound) + shard.away[at][:, None] * block.norm)
        live &= bound >= block.limit
        some = live.any(axis=1)
        if not some.all():
            nodes, live, bound = nodes[some], live[some], bound[some]
    bound[~live] = -np.inf
    return nodes, bound


def _dot(shard: Shard, lo: int, hi: int, block: Block, rows: np.ndarray, kind: type) -> np.ndarray:
    """Integer inner products [row of the shard, query], exact if numbers of this kind hold them."""
    if kind is np.float32:
        return shard.x32[lo:hi] @ (block.q32 if len(rows) == len(block.qids) else block.q32[rows]).T
    if kind is np.float64:
        return shard.vectors[lo:hi].astype(np.float64) @ block.qf[rows].T
    exact = shard.vectors[lo:hi].astype(object) @ block.q[rows].astype(object).T
    if (np.abs(exact) >= 2**63).any():
        raise OverflowError("an inner product does not fit 64 bits")
    return exact.astype(np.int64)


def _open(shard: Shard, leaf: int, block: Block, rows: np.ndarray) -> None:
    """Offer the block what the leaf holds for the queries ``rows``."""
    lo, hi = shard.cuts[leaf], shard.cuts[leaf + 1]
    # No partial sum is larger than the product of the norms.
    top = block.norm[rows] * shard.tops[leaf] * (1.0 + SLACK)
    kinds = [(rows, np.float32)]
    if top.max() >= EXACT32:
        kinds = [(rows[top < EXACT32], np.float32), (rows[(top >= EXACT32) & (top < EXACT)], np.float64), (rows[top >= EXACT], object)]
    for some, kind in kinds:
        if not len(some):
            continue
        s = _dot(shard, lo, hi, block, some, kind)
        found = np.flatnonzero(s >= (block.limit32 if kind is np.float32 else block.limit)[some])
        if len(found):
            place, row = np.divmod(found, len(some))
            block.offer(some[row], s.ravel()[found].astype(np.int64), shard.ids[lo:hi][place])


def search_tree(shard: Shard, block: Block) -> None:
    """Give the block the rows of a shard that are among the k best of one of its queries.

    Queries without a bar open their best leaf first. Then the leaves follow by their best bound, each for all queries
    that can still gain from it.
    """
    leaves, bound = _reached(shard, block)
    new = np.flatnonzero(block.bar == LOWEST)
    if len(leaves) and len(new):
        best = bound[:, new].argmax(axis=0)
        for n in np.unique(best):
            rows = new[best == n]
            _open(shard, leaves[n], block, rows)
            bound[n, rows] = -np.inf
        block.settle()
    for n in np.argsort(-bound.max(axis=1), kind="stable") if len(leaves) else ():
        rows = np.flatnonzero((bound[n] >= block.limit) & (bound[n] > -np.inf))
        if len(rows):
            _open(shard, leaves[n], block, rows)


def shard_trees(vectors: DataFrame, shards: int) -> DataFrame:
    """One packed tree per (dims, shard)."""

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(rows["v"].to_numpy()).astype(np.int64) if key[0] else np.zeros((len(rows), 0), np.int64)
        tree = build_tree(rows["vec_id"].to_numpy(), v)
        return pd.DataFrame({"dims": [key[0]], "shard": [key[1]], "tree": [_pack(**tree)]})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dims", "shard").applyInPandas(build, "dims int, shard int, tree binary")


def query_blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """Queries packed into blocks; each starts without a bar."""

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(rows["v"].to_numpy()).astype(np.int64) if key[0] else np.zeros((len(rows), 0), np.int64)
        none = {"bar": np.full(len(rows), LOWEST), "tie": np.full(len(rows), HIGHEST)}
        packed = _pack(ids=rows["vec_id"].to_numpy(), q=_compact(v), **none)
        return pd.DataFrame({"dims": [key[0]], "block": [key[1]], "queries": [packed]})

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dims", "block").applyInPandas(build, "dims int, block int, queries binary")


def _meet(blocks: DataFrame, trees: DataFrame, b_units: int, s_units: int, work, schema: str) -> DataFrame:
    """``work`` of the blocks and the trees of every pair of units: blocks of b_unit, trees of s_unit."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return work(left, [Shard(_unpack(t)) for t in right["tree"]] if len(left) else [])

    keys = ["dims", "b_unit", "s_unit"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Twice as many parts as pairs, so that few parts get several.
    parts = min(2 * b_units * s_units, MOST_PARTS)
    left = blocks.withColumn("s_unit", every(s_units)).select(*keys, "block", "queries").repartition(parts, *keys)
    right = trees.withColumn("b_unit", every(b_units)).select(*keys, "tree").repartition(parts, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema)


def _searched(queries: bytes, shards: list[Shard], k: int) -> Block:
    block = Block(_unpack(queries), k)
    for shard in shards:
        search_tree(shard, block)
    block.settle()
    return block


def _pilot(blocks: DataFrame, trees: DataFrame, b_units: int, k: int) -> DataFrame:
    """Blocks again, now with the k-th scores of the pilot shards as bars."""

    def search(left: pd.DataFrame, shards: list[Shard]) -> pd.DataFrame:
        found = [_searched(q, shards, k) for q in left["queries"]]
        packed = [_pack(ids=b.qids, q=b.q, bar=b.bar, tie=b.tie) for b in found]
        return pd.DataFrame({"dims": left["dims"], "b_unit": left["b_unit"], "block": left["block"], "queries": packed})

    return _meet(blocks, trees, b_units, 1, search, "dims int, b_unit int, block int, queries binary")


def _search(blocks: DataFrame, trees: DataFrame, b_units: int, s_units: int, k: int) -> DataFrame:
    def search(left: pd.DataFrame, shards: list[Shard]) -> pd.DataFrame:
        found = [_searched(q, shards, k) for q in left["queries"]]
        columns = ([b.qids[b.row] for b in found], [b.ids for b in found], [b.score for b in found])
        none = [np.zeros(0, np.int64)]
        return pd.DataFrame({c: np.concatenate(x or none) for c, x in zip(("query_id", "vec_id", "score"), columns)})

    return _meet(blocks, trees, b_units, s_units, search, HITS)


def exact_top_k(
    vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of every query among all rows.

    Both frames are (vec_id, dims, v) as ``quantized`` makes them. Candidates with the query's own id are left
    out, as are vectors of another dimension; ties go to the smaller id; rows that repeat an
    id count as often as they occur; an empty side gives no rows. Inner products must fit 64 bits.
    """
    rows, asked = vectors.count(), queries.count()
    shards, blocks = max(1, -(-rows // shard_rows)), max(1, -(-asked // block_queries))
    s_units, b_units = -(-shards // SHARDS_A_UNIT), -(-blocks // BLOCKS_A_UNIT)
    trees = materialize(shard_trees(vectors, shards), "trees")
    packed = materialize(query_blocks(queries, blocks), "blocks")
    packed = packed.withColumn("b_unit", F.floor(F.col("block") / BLOCKS_A_UNIT).cast("int"))
    pilot = trees.join(trees.groupBy("dims").agg(F.min("shard").alias("shard")), ["dims", "shard"])
    barred = materialize(_pilot(packed, pilot.withColumn("s_unit", F.lit(0)), b_units, k), "barred")
    # Every block meets every shard: a stated query set against all rows, in groups of blocks and shards.
    dealt = trees.withColumn("s_unit", F.floor(F.col("shard") / SHARDS_A_UNIT).cast("int"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        _search(barred, dealt, b_units, s_units, k).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id)::INTEGER AS rank,
       c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id
WHERE q.vec_id % 20 = 0 QUALIFY rank <= 20
"""


@llm_query("op9_exact_top_k", SQL)
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(table(spark, sf_dir, "embeddings"))
    return exact_top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)
