"""Merkle manifest of a dataset, with inclusion proofs fetched as octopus multiproofs.

Every row is a leaf, every group (a source) a tree in which three neighbours have one parent, and the roots of the
groups are the leaves of one more tree. Leaves are numbered in order and packed in pieces of bounded size, whatever
group they belong to. A piece folds what lies whole inside it; nodes at its edges go up, 64 pieces together,
until every tree has its root. For proofs a piece lists the smallest set of node coordinates that its own leaves cannot give,
fetches them once, derives the inner nodes all its leaves share, and spells out each leaf's proof by itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempera.catalog.registry import table
from tempera.llm.catalog import llm_query
from tempera.llm.support import numbered
from tempera.plans.staging import materialize

FAN = 3
#: Leaves of a piece, and pieces (or groups of them) whose edges are joined in one task.
PIECE_LEAVES, JOINED = 4096, 64
#: About so many pieces ask for one copy of a node.
ASKING = 64

NODES = "unit long, tree long, n long, level int, place long, digest binary, derived boolean, open boolean, root boolean"
#: Digests in hex; as bytes until a query turns them to text.
SPELLED = {
    "doc_id": pa.int64(), "leaf": pa.binary(), "subroot": pa.binary(), "root": pa.binary(), "proof": pa.binary(), "shape": pa.string(),
    "folded_root": pa.binary(),
}
PROOFS = ", ".join(f"{c} {'long' if t == pa.int64() else 'string' if t == pa.string() else 'binary'}" for c, t in SPELLED.items())


def digest(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def width(n: int, level: int) -> int:
    return -(-n // FAN**level)


def fold_run(n: int, a: int, digests: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(level, place, digest) of what a run of neighbouring leaves from ``a`` on leaves open: nodes whose parent needs
    nodes outside the run, and the root if the run is a whole tree."""
    b, level = a + len(digests), 0
    while True:
        count = width(n, level)
        lo = -(-a // FAN) * FAN
        hi = b if b == count else b // FAN * FAN
        whole = lo < hi and count > 1
        for i in [*range(a, min(lo, b)), *range(max(hi, lo), b)] if whole else range(a, b):
            yield level, i, digests[i - a]
        if not whole:
            return
        inside = digests[lo - a : hi - a]
        digests = [digest(b"".join(inside[k : k + FAN])) for k in range(0, len(inside), FAN)]
        a, b, level = lo // FAN, -(-hi // FAN), level + 1


def join_open(n: int, nodes: dict[int, dict[int, bytes]]) -> tuple[list[tuple[int, int, bytes]], set[tuple[int, int]]]:
    """Parents that follow from open nodes ({level: {place: digest}}, extended here), and the coordinates still open."""
    derived, left, level, top = [], set(), 0, height(n)
    while level <= top:
        here, count = nodes.get(level, {}), width(n, level)
        for g in sorted({i // FAN for i in here}):
            members = range(FAN * g, min(count, FAN * g + FAN))
            if level < top and all(i in here for i in members):
                parent = digest(b"".join(here[i] for i in members))
                nodes.setdefault(level + 1, {})[g] = parent
                derived.append((level + 1, g, parent))
            else:
                left |= {(level, i) for i in members if i in here}
        level += 1
    return derived, left


def missing(n: int, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Coordinates (level, place) that the leaves from ``a`` up to ``b`` need for their proofs and cannot derive."""
    for level in range(height(n)):
        lo, hi = a // FAN * FAN, min(width(n, level), -(-b // FAN) * FAN)
        yield from ((level, i) for i in [*range(lo, a), *range(b, hi)])
        a, b = lo // FAN, -(-hi // FAN)


def salts(level: Column) -> Column:
    """Copies of a node: one for every so many pieces under its parent."""
    return (F.lit(1) + F.floor(F.pow(F.lit(float(FAN)), level + 1) / F.lit(float(PIECE_LEAVES * ASKING)))).cast("long")


def run_paths(n: int, a: int, digests: list[bytes], fetched: dict, above: list[tuple[bytes, bytes]]):
    """(root, paths): the tree's root and each leaf's [(siblings left of it, right of it)], level by level, then ``above``."""
    b, layers = a + len(digests), []
    for level in range(height(n)):
        lo, hi = a // FAN * FAN, min(width(n, level), -(-b // FAN) * FAN)
        row = [*(fetched[level, i] for i in range(lo, a)), *digests, *(fetched[level, i] for i in range(b, hi))]
        layers.append((lo, row))
        digests = [digest(b"".join(row[k : k + FAN])) for k in range(0, len(row), FAN)]
        a, b = lo // FAN, -(-hi // FAN)
    paths, start = [above] * len(digests), a
    for lo, row in reversed(layers):
        below = []
        for k, _ in enumerate(row):
            first = k - k % FAN
            step = (b"".join(row[first:k]), b"".join(row[k + 1 : first + FAN]))
            below.append([step, *paths[(lo + k) // FAN - start]])
        paths, start = below, lo
    return digests[0], paths, start


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def _cut(blob: bytes) -> list[bytes]:
    text = blob.hex().encode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def _pieces(rows: DataFrame, name: str) -> DataFrame:
    """unit, keys, leaves, claimed: numbered leaves packed ``PIECE_LEAVES`` together, in order."""

    def pack(key, t):
        t = t.sort_by("_n")
        blobs = {to: pa.array([b"".join(t[c].to_pylist())], pa.binary()) for c, to in (("leaf", "leaves"), ("claimed", "claimed"))}
        keys = pa.array([t["doc_id"].to_pylist()], pa.list_(pa.int64()))
        return pa.table({"unit": pa.array([key[0].as_py()], pa.int64()), "keys": keys, **blobs})

    placed = rows.select("doc_id", "leaf", "claimed", "_n", F.floor(F.col("_n") / PIECE_LEAVES).cast("long").alias("unit"))
    packed = placed.groupBy("unit").applyInArrow(pack, "unit long, keys array<long>, leaves binary, claimed binary")
    return materialize(packed, f"{name}-pieces")


def _runs(trees: DataFrame, *more: str) -> DataFrame:
    """(unit, runs): the trees (tree, first, n) that a piece holds leaves of, in order, and the places of these leaves."""
    first, last = F.floor(F.col("first") / PIECE_LEAVES), F.floor((F.col("first") + F.col("n") - 1) / PIECE_LEAVES)
    spread = trees.withColumn("unit", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    a = F.greatest(F.lit(0), F.col("unit") * PIECE_LEAVES - F.col("first"))
    b = F.least(F.col("n"), (F.col("unit") + 1) * PIECE_LEAVES - F.col("first"))
    run = F.struct("tree", "n", a.cast("long").alias("a"), b.cast("long").alias("b"), *more)
    return spread.groupBy("unit").agg(F.sort_array(F.collect_list(run)).alias("runs"))


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"unit": pa.int64(), "tree": pa.int64(), "n": pa.int64(), "level": pa.int32(), "place": pa.int64(), "digest": pa.binary(), "derived": pa.bool_(), "open": pa.bool_(), "root": pa.bool_()}
    return pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds.items())})


def _nodes(pieces: DataFrame, runs: DataFrame, count: int, name: str) -> DataFrame:
    """(tree, level, place, digest, root) of all nodes that some piece cannot derive alone, and of the roots."""

    def fold_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, blob, held in zip(*(batch[c].to_pylist() for c in ("unit", "leaves", "runs"))):
                digests, at, out = _cut(blob), 0, []
                for r in held:
                    part, at = digests[at : at + r["b"] - r["a"]], at + r["b"] - r["a"]
                    top = height(r["n"])
                    out += [(unit, r["tree"], r["n"], level, i, d, True, level < top, level == top) for level, i, d in fold_run(r["n"], r["a"], part)]
                yield _records(out)

    def join(key, t):
        trees: dict = defaultdict(lambda: defaultdict(dict))
        for tree, n, level, i, d in zip(*(t[c].to_pylist() for c in ("tree", "n", "level", "place", "digest"))):
            trees[tree, n][level][i] = d
        out, unit = [], key[0].as_py()
        for (tree, n), nodes in trees.items():
            derived, left = join_open(n, nodes)
            new, top = {(level, i) for level, i, _ in derived}, height(n)
            out += [(unit, tree, n, level, i, d, True, (level, i) in left and level < top, level == top) for level, i, d in derived]
            out += [(unit, tree, n, level, i, nodes[level][i], False, True, False) for level, i in sorted(left - new)]
        return pa.Table.from_batches([_records(out)])

    layer = pieces.select("unit", "leaves").join(runs, "unit").mapInArrow(fold_pieces, NODES)
    layers = [materialize(layer, f"{name}-nodes")]
    while count > 1:
        count = -(-count // JOINED)
        up = layers[-1].filter("open").withColumn("unit", F.expr(f"unit div {JOINED}"))
        layers.append(materialize(up.groupBy("unit").applyInArrow(join, NODES), f"{name}-nodes"))
    found = [x.filter("derived").select("tree", "level", "place", "digest", "root") for x in layers]
    return reduce(DataFrame.unionByName, found)


def _fetched(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(unit, nodes): the digests of the coordinates that each piece is missing."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = [
                (unit, r["tree"], level, i)
                for unit, held in zip(batch["unit"].to_pylist(), batch["runs"].to_pylist())
                for r in held for level, i in missing(r["n"], r["a"], r["b"])
            ]
            kinds = {"unit": pa.int64(), "tree": pa.int64(), "level": pa.int32(), "place": pa.int64()}
            yield pa.RecordBatch.from_pydict({k: pa.array([w[i] for w in wanted], t) for i, (k, t) in enumerate(kinds.items())})

    asked = runs.mapInArrow(ask, "unit long, tree long, level int, place long").withColumn("salt", F.pmod("unit", salts(F.col("level"))))
    copies = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts(F.col("level")) - 1)))
    met = asked.join(copies, ["tree", "level", "place", "salt"])
    return met.groupBy("unit").agg(F.collect_list(F.struct("tree", "level", "place", "digest")).alias("nodes"))


def _spelled(pieces: DataFrame, runs: DataFrame, fetched: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, path, folded_root of every leaf, from pieces with their runs and fetched nodes.

    A run may bring the ``path`` above its tree and the ``root`` there.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, leaves, claimed, held, nodes in zip(*(batch[c].to_pylist() for c in ("keys", "leaves", "claimed", "runs", "nodes"))):
                known: dict = defaultdict(dict)
                for x in nodes or []:
                    known[x["tree"]][x["level"], x["place"]] = x["digest"]
                digests, others, at = _cut(leaves), _cut(claimed), 0
                out: dict[str, list] = {c: [] for c in SPELLED}
                for r in held:
                    end = at + r["b"] - r["a"]
                    above = [(x["left"], x["right"]) for x in r["path"]]
                    top, paths, start = run_paths(r["n"], r["a"], digests[at:end], known[r["tree"]], above)
                    paths = paths[r["a"] - start :][: end - at]
                    out["doc_id"] += keys[at:end]
                    out["subroot"] += [top] * (end - at)
                    out["root"] += [r["root"] or top] * (end - at)
                    out["proof"] += [b"".join([y for x in path for y in x]) for path in paths]
                    out["shape"] += [" ".join([f"{len(x) // 64}{len(y) // 64}" for x, y in path]) for path in paths]
                    out["folded_root"] += [fold(h, path) for h, path in zip(others[at:end], paths)]
                    at = end
                out["leaf"] = digests
                yield pa.RecordBatch.from_pydict({c: pa.array(out[c], t) for c, t in SPELLED.items()})

    whole = pieces.join(runs, "unit").join(fetched, "unit", "left").select("keys", "leaves", "claimed", "runs", "nodes")
    return whole.mapInArrow(spell, PROOFS)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proofs of the upper tree as [(left, right)] per level, for the groups' own proofs to go on with."""
    for batch in batches:
        paths = []
        for proof, shape in zip(batch["proof"].to_pylist(), batch["shape"].to_pylist()):
            path, at = [], 0
            for left, right in ((64 * int(x[0]), 64 * int(x[1])) for x in shape.split()):
                path.append({"left": proof[at : at + left], "right": proof[at + left : at + left + right]})
                at += left + right
            paths.append(path)
        step = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
        yield pa.RecordBatch.from_pydict({"tree": batch["doc_id"], "root": batch["root"], "path": pa.array(paths, step)})


def proofs(leaves: DataFrame) -> DataFrame:
    """One row per leaf of (grp, doc_id, leaf, claimed): doc_id, leaf, subroot, root, proof, shape, folded_root.

    ``leaf`` is the digest (32 bytes) the manifest is built of; ``claimed`` is the one to be checked, null if it is the same.
    Results are hex digests: ``proof`` holds the siblings from the leaf up to the root, ``shape`` how many stand left and right
    of the path on each level, ``folded_root`` what the claimed leaf gives with them. Groups are ordered by name, null first;
    leaves by doc_id, null first, then by digest, so repeated rows are leaves of their own, next to each other. A lone
    leaf is its tree's root; an empty table gives no rows.
    """
    whole = leaves.select("grp", "doc_id", "leaf", F.coalesce("claimed", "leaf").alias("claimed"))
    rows = numbered(whole, "grp", "doc_id", "leaf", label="merkle")
    groups = numbered(rows.groupBy("grp").agg(F.min("_n").alias("first"), F.count("*").alias("n")), "grp", label="groups")
    trees = materialize(groups.select(F.col("_n").alias("tree"), "first", "n"), "trees")
    size, wide = trees.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    none = {"root": F.lit(None).cast("binary"), "path": F.array().cast("array<struct<left:binary,right:binary>>")}

    pieces, runs = _pieces(rows, "leaf"), materialize(_runs(trees.withColumns(none), "root", "path"), "runs")
    nodes = materialize(_nodes(pieces, runs, -(-size // PIECE_LEAVES), "leaf"), "nodes")
    subroots = nodes.filter("root").select(F.col("tree").alias("doc_id"), F.unhex(F.decode("digest", "UTF-8")).alias("leaf"), F.col("tree").alias("_n"))

    # The roots of the groups are the leaves of one more tree.
    one = leaves.sparkSession.range(1).select(*(F.lit(x).cast("long").alias(c) for c, x in (("tree", 0), ("first", 0), ("n", wide)))).filter("n > 0")
    upper, upper_runs = _pieces(subroots.withColumn("claimed", F.col("leaf")), "group"), materialize(_runs(one.withColumns(none), "root", "path"), "group-runs")
    upper_nodes = materialize(_nodes(upper, upper_runs, -(-wide // PIECE_LEAVES), "group"), "group-nodes")
    above = _spelled(upper, upper_runs, _fetched(upper_runs, upper_nodes)).select("doc_id", "root", "proof", "shape")
    above = materialize(above.mapInArrow(_steps, "tree long, root binary, path array<struct<left:binary,right:binary>>"), "group-proofs")
    return _spelled(pieces, _runs(trees.join(above, "tree"), "root", "path"), _fetched(runs, nodes))


def field(value: Column) -> Column:
    """A value as it is digested: `-` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Proofs of all documents; where ``tampered`` holds, the claimed leaf is that of the text without line ends.

    Null and repeated doc_ids, null sources and texts of any length are leaves like all others; other columns are ignored.
    """
    docs = docs.select(*COLUMNS, (F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))).alias("_tampered"))
    others = [F.col(c) for c in COLUMNS[:-1]]
    claimed = F.when(F.col("_tampered"), leaf_digest(*others, F.translate("text", "\n", "")))
    return proofs(
        docs.select(
            F.col("source").cast("string").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"),
            leaf_digest(*others, F.col("text")).alias("leaf"), claimed.alias("claimed"),
        )
    )


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{}"))
SQL = f"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
d AS (
  SELECT row_number() OVER () AS k, doc_id, source, lang, n_chars, text, replace(text, chr(10), '') AS flat,
         xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
             lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]), 4294967295::BIGINT), 4294967295) % 2 = 0 AS tampered
  FROM documents, crc),
leaf AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM (
    SELECT k, doc_id, source, sha256({_LEAF.replace("{}", "text")}) AS h,
           CASE WHEN tampered THEN sha256({_LEAF.replace("{}", "flat")}) ELSE sha256({_LEAF.replace("{}", "text")}) END AS claimed
    FROM d)),
node AS (
  SELECT 0 AS lev, source, i, h, count(*) OVER (PARTITION BY source) AS m FROM leaf
  UNION ALL
  SELECT lev + 1, source, i // 3, sha256(string_agg(h, '' ORDER BY i)), (m + 2) // 3 FROM node WHERE m > 1 GROUP BY lev, source, i // 3, m),
sub AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM node WHERE m = 1),
top AS (
  SELECT 0 AS lev, i, h, (SELECT count(*) FROM sub) AS m FROM sub
  UNION ALL
  SELECT lev + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (m + 2) // 3 FROM top WHERE m > 1 GROUP BY lev, i // 3, m),
fam AS (SELECT lev, source, i // 3 AS p, list(h ORDER BY i) AS hs FROM node WHERE m > 1 GROUP BY ALL),
top_fam AS (SELECT lev, i // 3 AS p, list(h ORDER BY i) AS hs FROM top WHERE m > 1 GROUP BY ALL),
walk AS (
  SELECT k, source, 0 AS lev, i, '' AS proof, claimed AS folded FROM leaf
  UNION ALL
  SELECT w.k, w.source, w.lev + 1, w.i // 3, w.proof || array_to_string(hs[1:w.i % 3] || hs[w.i % 3 + 2:], ''),
         sha256(array_to_string(hs[1:w.i % 3] || [w.folded] || hs[w.i % 3 + 2:], ''))
  FROM walk w JOIN fam f ON f.lev = w.lev AND f.p = w.i // 3 AND f.source IS NOT DISTINCT FROM w.source),
done AS (SELECT k, source, proof, folded FROM walk QUALIFY lev = max(lev) OVER (PARTITION BY k)),
climb AS (
  SELECT k, 0 AS lev, sub.i, proof, folded FROM done JOIN sub ON sub.source IS NOT DISTINCT FROM done.source
  UNION ALL
  SELECT w.k, w.lev + 1, w.i // 3, w.proof || array_to_string(hs[1:w.i % 3] || hs[w.i % 3 + 2:], ''),
         sha256(array_to_string(hs[1:w.i % 3] || [w.folded] || hs[w.i % 3 + 2:], ''))
  FROM climb w JOIN top_fam f ON f.lev = w.lev AND f.p = w.i // 3),
final AS (SELECT k, proof, folded FROM climb QUALIFY lev = max(lev) OVER (PARTITION BY k))
SELECT doc_id, leaf.h AS leaf, sub.h AS subroot, (SELECT h FROM top WHERE m = 1) AS root, sha256(proof) AS proof_sha256,
       folded AS folded_root, folded = (SELECT h FROM top WHERE m = 1) AS verified
FROM leaf JOIN final USING (k) JOIN sub ON sub.source IS NOT DISTINCT FROM leaf.source
"""


@llm_query("op12_merkle_manifest", SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = {c: F.decode(c, "UTF-8").alias(c) for c in ("leaf", "subroot", "root", "folded_root")}
    return manifest(table(spark, sf_dir, "documents"), tampered).select(
        "doc_id", text["leaf"], text["subroot"], text["root"], F.sha2("proof", 256).alias("proof_sha256"), text["folded_root"],
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
