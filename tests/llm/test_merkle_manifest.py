import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tempera.llm import merkle_manifest as mm

DOCS = "doc_id long, text string, source string, lang string, n_chars long, leaf string, tree int"


def h(s):
    return sha256(s.encode()).hexdigest()


def leaf(doc_id, text, source, lang, n_chars):
    values = (doc_id, source, lang, n_chars, text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """(root, [(left, right) per level] per leaf) of a list of digests."""
    level, at, paths = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for path, i in zip(paths, at):
            g = i - i % 3
            path.append(("".join(level[g:i]), "".join(level[i + 1 : g + 3])))
        level = [h("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], paths


def brute(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d[2], []).append(d)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    rows, subs = [], []
    for s in order:
        ranked = sorted(((d[0] is not None, d[0] or 0, leaf(*d), d) for d in groups[s]), key=lambda x: x[:3])
        sub, paths = tree([x[2] for x in ranked])
        subs.append(sub)
        rows += [(len(subs) - 1, x[2], x[3], path) for x, path in zip(ranked, paths)]
    root, tops = tree(subs)
    out = []
    for g, digest, d, path in rows:
        path = path + tops[g]
        bad = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 and d[1] is not None
        folded = leaf(d[0], d[1].replace("\n", ""), *d[2:]) if bad else digest
        for left, right in path:
            folded = h(left + folded + right)
        out.append((d[0], digest, subs[g], root, "".join(x + y for x, y in path), folded))
    return sorted(out, key=str)


def found(spark, docs):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS)
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = mm.manifest(df, bad).collect()
    hexes = [(r.doc_id, *(bytes(r[c]).decode() for c in ("leaf", "subroot", "root", "proof", "folded_root"))) for r in rows]
    for r in rows:
        assert sum(map(int, r["shape"].replace(" ", ""))) * 64 == len(r["proof"])
    return sorted(hexes, key=str)


@pytest.mark.parametrize("leaves, joined", [(4096, 64), (5, 2), (1, 3)])
def test_matches_brute_force(spark, monkeypatch, leaves, joined):
    monkeypatch.setattr(mm, "PIECE_LEAVES", leaves)
    monkeypatch.setattr(mm, "JOINED", joined)
    rng = random.Random(leaves)
    sources = ["hot"] * 30 + ["é", "z", "a", "", None, "Z", "🙂", "￿"]
    docs = [(i, rng.choice(["a\nb", "text", "é🙂\n", "", None, "\n"]), rng.choice(sources), rng.choice(["en", None]), rng.choice([0, 5, None])) for i in range(80)]
    docs += [(None, "no id", "hot", "en", 1)] * 2 + [(7, "same\nid", "hot", "en", 1)] * 5 + [(7, "other", "hot", None, None)]
    docs += [(900, "long\n" * 50_000, "lone", "en", 3), (-4, "x\ny", "a", "en", 3)]
    assert found(spark, docs) == brute(docs)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 31])
def test_every_height(spark, monkeypatch, n):
    monkeypatch.setattr(mm, "PIECE_LEAVES", 4)
    monkeypatch.setattr(mm, "JOINED", 2)
    docs = [(i, f"t{i}", "s", "en", i) for i in range(n)]
    assert found(spark, docs) == brute(docs)


def test_empty(spark):
    assert found(spark, []) == []


def test_pieces_ask_for_no_node_they_can_derive():
    for n in range(1, 60):
        for a in range(n):
            for b in range(a + 1, n + 1):
                wanted = list(mm.missing(n, a, b))
                assert len(wanted) == len(set(wanted)) <= 4 * mm.height(n)
                for level, i in wanted:
                    assert (i + 1) * 3**level <= a or i * 3**level >= b
