"""Minimum-bin-slack packing of tokenized documents into fixed windows.

A document is cut into full windows and one remainder, so the whole problem is a
multiset of lengths 1..window: a histogram of bounded size, however many
documents there are. Window after window, a bitset subset-sum program over the
remaining lengths finds the multiset that fills the window closest to capacity;
backtracking yields how many pieces of each length it takes, and the multiset is
repeated as long as every count allows. Pieces get a number among those of
their length (counted per (length, salt), so one very common length is spread
over all tasks) and the number picks the sequence and the place in it.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempera.catalog.registry import table
from tempera.llm.catalog import llm_query
from tempera.llm.support import id_and_text, shuffle_width
from tempera.plans.staging import materialize

WINDOW = 2048
END_OF_DOCUMENT = 1
#: Words a worker remembers with their ids, and as many plain forms; further ones are encoded anew. Changes no result.
REMEMBERED_WORDS = 600_000
#: Letters whose lower case is one letter, with at most one full stop or comma behind.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Ids of a word as little-endian bytes.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its words in a row. It also lower-cases, and it parts letters from a full stop
    or comma behind them, so the plain form of a word is what has to be encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._plain: dict[str, bytes] = {}

    def _encode(self, word: str) -> bytes:
        ids = self._tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def _plain_ids(self, word: str) -> bytes:
        out = self._plain.get(word)
        if out is None:
            out = self._encode(word)
            if len(self._plain) < REMEMBERED_WORDS and len(word) <= 64:
                self._plain[word] = out
        return out

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if m := _PLAIN.fullmatch(text):
            out = self._plain_ids(m[1].lower())
            if m[2]:
                out += self._plain_ids(m[2])
        else:
            out = self._encode(text)
        if len(self) < REMEMBERED_WORDS and len(word) <= 64:
            self[word] = out
        return out

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode("utf-8").split()))


@functools.cache
def word_ids(path: str) -> WordIds:
    """One memory for all tasks of a worker process."""
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end: int = END_OF_DOCUMENT) -> DataFrame:
    """One row per piece: full windows of a document and its remainder, with the CRC of the piece's ids."""
    path, tail = tokenizer or default_tokenizer(), np.asarray([end], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.of(text.as_py()) + tail
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return id_and_text(docs).mapInArrow(cut, PIECES)


@dataclass(frozen=True)
class Share:
    """Pieces first..last-1 of a length: `per` of them in each sequence from `sequence` on, from `offset` there."""

    length: int
    first: int
    last: int
    per: int
    sequence: int
    offset: int


def closest_fill(counts: dict[int, int], order: list[int], room: int, already: int) -> dict[int, int]:
    """Counts per length whose sum leaves the least slack in ``room``.

    ``already`` tokens are in the window; a sum that makes the window a power of two
    leaves no slack either, and is taken if the window can't be filled to the brim.
    """
    bits, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in order:
        left, k = counts.get(length, 0), 1
        while left > 0 and length <= room:
            k = min(k, left)
            if k * length > room:
                break
            steps.append((length, k, bits))
            bits |= (bits << (k * length)) & mask
            left, k = left - k, 2 * k
        if bits >> room & 1:
            break
    at = bits.bit_length() - 1
    if at < room:
        powers = [p - already for p in (1 << i for i in range(40)) if already <= p <= already + room]
        at = max((p for p in powers if bits >> p & 1), default=at)
    used: dict[int, int] = {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= k * length
    return used


def plan_windows(histogram: dict[int, int], window: int = WINDOW) -> list[Share]:
    """Windows for a histogram of lengths: the largest remaining piece opens one, the closest fill completes it."""
    counts = {n: c for n, c in histogram.items() if c}
    given = dict.fromkeys(counts, 0)
    order = sorted(counts, key=lambda n: -counts[n])
    shares, sequence = [], 0
    for largest in sorted(counts, reverse=True):
        while counts[largest]:
            counts[largest] -= 1
            used = closest_fill(counts, order, window - largest, largest)
            counts[largest] += 1
            used[largest] = used.get(largest, 0) + 1
            times = min(counts[n] // k for n, k in used.items())
            offset = 0
            for n, k in used.items():
                shares.append(Share(n, given[n], given[n] + times * k, k, sequence, offset))
                given[n] += times * k
                counts[n] -= times * k
                offset += n * k
            sequence += times
    return shares


def pack_pieces(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Give every piece (length at most ``window``) its sequence and offset."""
    spark, salts = pieces.sparkSession, shuffle_width(pieces.sparkSession)
    pieces = materialize(pieces, "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    shares = [(s.length, s.first, s.last, s.per, s.sequence, s.offset) for s in plan_windows(histogram, window)]
    plan = spark.createDataFrame(shares, "p_length long, first long, last long, per long, base long, place long")
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    before = (
        salted.groupBy("length", "_salt")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
        .select("length", "_salt", "_before")
    )
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = (
        salted.withColumn("_within", F.row_number().over(within) - 1)
        .join(before, ["length", "_salt"])
        .withColumn("_rank", F.col("_before") + F.col("_within"))
    )
    # At most log2(pieces of a length) shares a length and `window` lengths: bounded by the parameter.
    chosen = numbered.join(
        F.broadcast(plan),
        (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("last")),
    )
    k = F.col("_rank") - F.col("first")
    return chosen.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.expr("(_rank - first) div per")).alias("sequence_id"),
        (F.col("place") + F.pmod(k, F.col("per")) * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end: int = END_OF_DOCUMENT) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most ``window`` tokens.

    Null or empty texts are the closing id alone; a null doc_id stays null; repeated rows
    are packed as often as they occur; an empty table gives no rows; other columns are
    ignored; texts of any length are cut into windows. Strings of special tokens in a
    text are ordinary text.
    """
    return pack_pieces(token_pieces(docs, tokenizer, window, end), window)


@llm_query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))



