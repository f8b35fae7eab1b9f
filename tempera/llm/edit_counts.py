"""Token counts that follow edits without counting the text anew.

A document is a row of pre-tokens, whose token counts add up. Leaves of a segment tree hold runs of them,
inner nodes the sums of characters and tokens. An edit re-reads pre-tokens from the last one that
could have seen the changed text up to the first old boundary behind it, puts the new ones into the
leaves, and adds the difference along the paths to the root.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempera.catalog.registry import table
from tempera.llm.catalog import llm_query
from tempera.llm.support import text_or_empty

LEAF = 64
#: Pre-tokens a worker remembers with their counts; further ones are encoded anew. Changes no result.
REMEMBERED = 800_000

# Fixed value: the pre-tokenization pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

EDITS = "array<struct<start:int,end:int,put:string>>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PreTokenCounts(dict):
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, token: str) -> int:
        n = len(self._tokenizer.encode_batch_fast([token], add_special_tokens=False)[0].ids)
        if len(self) < REMEMBERED and len(token) <= 64:
            self[token] = n
        return n


@functools.cache
def pre_token_counts(path: str) -> PreTokenCounts:
    return PreTokenCounts(path)


class CountTree:
    """Token count of a text under edits."""

    def __init__(self, text: str, counts: PreTokenCounts):
        self.text, self.memory = text, counts
        #: Characters read again by edits so far.
        self.read_again = 0
        tokens = counts.pattern.findall(text)
        self._build(list(map(len, tokens)), list(map(counts.__getitem__, tokens)))

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lengths), LEAF)] or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (a, b) in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(a), sum(b)
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _set_leaf(self, i: int, lengths: list[int], counts: list[int]) -> None:
        self.leaves[i] = (lengths, counts)
        node = self.width + i
        chars, tokens = sum(lengths) - self.chars[node], sum(counts) - self.tokens[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node >>= 1

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf over a character place, and the place where it starts; the last leaf for the end of the text."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return min(node - self.width, len(self.leaves) - 1), start

    def replace(self, start: int, end: int, put: str) -> None:
        """Replace the characters from ``start`` up to ``end``; places beyond the text mean its end."""
        size = len(self.text)
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        new = self.text[:start] + put + self.text[end:]
        # A pre-token depends on at most two characters behind it, so those that end two before the edit stay.
        first, at = self._leaf_at(max(0, start - 2))
        while first and at + 2 > start:
            first -= 1
            at -= self.chars[self.width + first]
        keep, begin = 0, at
        for n in self.leaves[first][0]:
            if begin + n + 2 > start:
                break
            begin, keep = begin + n, keep + 1
        lengths, counts = self.leaves[first][0][:keep], self.leaves[first][1][:keep]
        last, old, k, shift = first, begin, keep, len(put) - (end - start)
        place, match = begin, self.memory.pattern.match
        while True:
            # Old boundaries up to where the reading stands.
            while old < place - shift and last < len(self.leaves):
                if k < len(self.leaves[last][0]):
                    old, k = old + self.leaves[last][0][k], k + 1
                else:
                    last, k = last + 1, 0
            if place >= start + len(put) and old == place - shift:
                break
            if place >= len(new):
                break
            token = match(new, place)[0]
            lengths.append(len(token))
            counts.append(self.memory[token])
            place += len(token)
        self.read_again += place - begin
        self.text = new
        if last < len(self.leaves):
            lengths += self.leaves[last][0][k:]
            counts += self.leaves[last][1][k:]
        if len(lengths) > 4 * LEAF:
            before = [x for leaf in self.leaves[:first] for x in zip(*leaf)]
            after = [x for leaf in self.leaves[last + 1 :] for x in zip(*leaf)]
            every = [*before, *zip(lengths, counts), *after]
            self._build([a for a, _ in every], [b for _, b in every])
            return
        for i in range(first + 1, min(last + 1, len(self.leaves))):
            self._set_leaf(i, [], [])
        self._set_leaf(first, lengths, counts)


def edited_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Counts before and after the edits of each document: (doc_id, text, edits) gives
    doc_id, n_tokens, edited_tokens, edited_chars, chars_read_again.

    Edits are applied one after the other to the text as it stands then. Null texts are empty, null edits none, and a
    null replacement deletes; a null doc_id stays null; rows that repeat are counted as often
    as they occur; an empty table gives no rows; other columns are ignored.
    """
    path = tokenizer or default_tokenizer()
    names = ("doc_id", "n_tokens", "edited_tokens", "edited_chars", "chars_read_again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = pre_token_counts(path)
        for batch in batches:
            rows = []
            for doc_id, text, edits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                tree = CountTree(text.as_py(), counts)
                before = tree.total
                for e in edits.as_py() or ():
                    if e is not None:
                        tree.replace(e["start"] or 0, e["end"] or 0, e["put"] or "")
                rows.append((doc_id, before, tree.total, len(tree.text), tree.read_again))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(names))

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.col("edits").cast(EDITS).alias("edits"))
    return narrow.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def sample_edits(n: int = 3) -> Column:
    """Deterministic edits: replace, delete and insert some 20 characters at places that a hash of the id picks."""
    length = F.length(text_or_empty())

    def one(i: int) -> Column:
        at = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(i)), F.greatest(length, F.lit(1)).cast("long")).cast("int")
        width = F.lit((20, 17, 0)[i % 3])
        put = F.substring(text_or_empty(), F.lit(1), F.lit((20, 0, 23)[i % 3]))
        return F.struct(at.alias("start"), (at + width).alias("end"), put.alias("put"))

    return F.array(*[one(i) for i in range(n)])


@llm_query("op7_edit_counts")
def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(table(spark, sf_dir, "documents").select("doc_id", "text", sample_edits().alias("edits")))
