"""SentencePiece BPE with seeded merge dropout, and lossless decoding.

A text is cut before each run of spaces (no piece goes on from a letter into a space), and every
chunk is merged by an agenda: best piece first, leftmost on ties. A candidate is skipped if a keyed hash of
(seed, document, position, place, piece) falls below the dropout share, so every occurrence of a word is segmented by draws
of its own. As a draw is the same whenever it is made, a candidate draws when its two neighbours first meet and a skipped one
is not put on the agenda. Chunks of many texts are merged side by side, in each step the best candidate of every one, so the
cost of a chunk does not depend on whether it was met before.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tempera.catalog.registry import table
from tempera.llm.catalog import llm_query
from tempera.llm.support import id_and_text

DROPOUT = 0.1
SEED = 17
#: Characters that a worker holds in arrays at once (the name is older; tests set it); longer texts go on piecewise. Changes no result.
REMEMBERED = 1 << 20
#: Longer chunks are merged one by one: a step looks at all places of a chunk.
LONGEST = 64
#: Chunks of about one length that are merged side by side.
BESIDE = 4096

# The space mark, and multipliers of a 64-bit mixing function.
SPACE = "▁"
#: Stands for a space mark in the text while merging: two characters, so it equals no single one and is no piece.
MARK = SPACE + "\0"
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_MASK = (1 << 64) - 1
_CHUNK = re.compile(r" *[^ ]+| +")
_START = re.compile(r"(?<=[^ ]) ")

ENCODED = "doc_id long, ids array<int>"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _draw(key: int, place: int, piece: int) -> int:
    h = (key + place * _MIX[0] + piece * _MIX[1]) & _MASK
    h = ((h ^ (h >> 30)) * _MIX[1]) & _MASK
    h = ((h ^ (h >> 27)) * _MIX[2]) & _MASK
    return h ^ (h >> 31)


class Pieces:
    """Vocabulary of a model file: ids and ranks by piece, bytes by id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.id: dict[str, int] = {}
        #: Smaller merges first.
        self.rank: dict[str, float] = {}
        self.raw: list[bytes] = []
        self.byte = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.id[piece], self.rank[piece] = i, -model.get_score(i)
                self.raw.append(piece.replace(SPACE, " ").encode("utf-8"))

    def segment(self, chunk: str, dropout: float = 0.0, key: int = 0) -> list[str]:
        """Pieces of a chunk whose spaces are plain, with the candidates skipped whose draws under the key are below the share.

        A space mark in the chunk is a symbol of its own that never merges.
        """
        symbols = [SPACE if c == " " else MARK if c == SPACE else c for c in chunk]
        n, rank, limit = len(symbols), self.rank, int(dropout * 2.0**64)
        agenda = []
        for i in range(n - 1):
            piece = symbols[i] + symbols[i + 1]
            if piece in rank:
                agenda.append((rank[piece], i, piece))
        heapq.heapify(agenda)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            own, j = symbols[i], right[i]
            if not own or j >= n or own + symbols[j] != piece:
                continue
            if limit and _draw(key, i, self.id[piece]) < limit:
                continue
            symbols[i], symbols[j] = piece, ""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                wider = piece + symbols[k]
                if wider in rank:
                    heapq.heappush(agenda, (rank[wider], i, wider))
            j = left[i]
            if j >= 0:
                wider = symbols[j] + piece
                if wider in rank:
                    heapq.heappush(agenda, (rank[wider], j, wider))
        return [s for s in symbols if s]

    def ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.id.get(p)
            if i is None:
                out += [self.byte[b] for b in (SPACE if p == MARK else p).encode("utf-8")]
            else:
                out.append(i)
        return out


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX[1])
        h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX[2])
    return h ^ (h >> np.uint64(31))


class Neighbours:
    """Symbols as numbers (a piece is its id, other characters follow), and what two neighbouring ones merge into, as arrays."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, len(pieces.raw)
        self.number = dict(pieces.id)
        for c in sorted({c for piece in pieces.rank for c in piece}):
            self.number.setdefault(c, len(self.number) + self.known)
        #: Any other character, and what stands beyond the ends of a chunk: merges with nothing.
        self.other = self.known + len(self.number)
        self.of_code = np.full(0x110000, self.other, np.int32)
        for symbol, n in self.number.items():
            if len(symbol) == 1:
                self.of_code[ord(symbol)] = n
        self.of_code[ord(" ")], self.of_code[ord(SPACE)] = self.number.get(SPACE, self.other), self.other
        order = np.zeros(self.known, np.int64)
        order[list(pieces.id.values())] = np.unique([pieces.rank[p] for p in pieces.id], return_inverse=True)[1]
        #: Smaller merges first; a place in the chunk is added to it.
        self.order = order * LONGEST
        pairs = [
            (self.number[p[:i]] << 20 | self.number[p[i:]], n)
            for p, n in pieces.id.items()
            for i in range(1, len(p))
            if p[:i] in self.number and p[i:] in self.number
        ]
        # A table with free slots: (left, right, piece) in the first slot from that of its hash on that no other pair has.
        self.shift = 64 - max(4, (4 * len(pairs)).bit_length())
        self.slots = np.full(1 << (64 - self.shift), -1, np.int64)
        for pair, n in pairs:
            at = ((pair * _MIX[0]) & _MASK) >> self.shift
            while self.slots[at] >= 0:
                at = (at + 1) % len(self.slots)
            self.slots[at] = pair << 20 | n

    def piece(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols merge into; negative if none."""
        pair = (left << 20) | right
        with np.errstate(over="ignore"):
            at = ((pair.view(np.uint64) * np.uint64(_MIX[0])) >> np.uint64(self.shift)).view(np.int64)
        entry = self.slots[at]
        apart = np.flatnonzero((entry >= 0) & (entry >> 20 != pair))
        while len(apart):
            at[apart] = (at[apart] + 1) % len(self.slots)
            entry[apart] = again = self.slots[at[apart]]
            apart = apart[(again >= 0) & (again >> 20 != pair[apart])]
        return np.where(entry >= 0, entry & 0xFFFFF, -1)

    def merge(self, symbols: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray, limit: int) -> None:
        """Merge all chunks in place: a merged symbol stands where it starts, places inside it become negative."""
        for c in np.flatnonzero(lengths > LONGEST).tolist():
            mine = slice(starts[c], starts[c] + lengths[c])
            place, text = starts[c], codes[mine].tobytes().decode("utf-32-le")
            symbols[mine] = -1
            for s in self.pieces.segment(text, limit / 2.0**64, int(keys[c])):
                symbols[place] = self.number.get(s, self.other)
                place += 1 if s == MARK else len(s)
        chunks = np.flatnonzero((lengths > 1) & (lengths <= LONGEST))
        chunks = chunks[np.argsort(lengths[chunks].astype(np.uint8), kind="stable")]
        sizes = lengths[chunks]
        at = 0
        while at < len(chunks):
            # Few chunks of a length: longer ones join them, up to an eighth longer.
            to = min(at + BESIDE, int(np.searchsorted(sizes, sizes[at] + sizes[at] // 8, "right")))
            self._beside(symbols, starts[chunks[at:to]], sizes[at:to], keys[chunks[at:to]], limit)
            at = to

    def _beside(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray, limit: int) -> None:
        """Merge chunks side by side: a column each, a row for each place, and a row beyond either end."""
        n, high = len(starts), int(lengths[-1])
        places = starts + np.arange(high)[:, None]
        inside = np.arange(high)[:, None] < lengths
        own = np.full((high + 2, n), self.other, np.int64)
        own[:high][inside] = symbols[places[inside]]
        none = np.iinfo(np.int32).max
        turn = np.full((high + 2, n), none, np.int32)
        cells = np.arange((high + 2) * n)
        right, left = cells + n, cells - n
        left[:n] += (high + 2) * n  # the last row stands for what is before the first
        piece = np.zeros((high + 2) * n, np.int64)
        flat, due = own.ravel(), turn.ravel()

        def meet(at: np.ndarray, a: np.ndarray, b: np.ndarray, of: np.ndarray) -> None:
            """Put what the neighbours a and b merge into on the agenda, unless its draw is to skip it."""
            new = self.piece(a, b)
            due[at] = none
            some = np.flatnonzero(new >= 0)
            if limit and len(some):
                with np.errstate(over="ignore"):
                    draws = (at[some] // n).astype(np.uint64) * np.uint64(_MIX[0]) + new[some].astype(np.uint64) * np.uint64(_MIX[1])
                    some = some[_mixed(keys[of[some]] + draws) >= np.uint64(min(limit, _MASK))] if limit <= _MASK else some[:0]
            at, new = at[some], new[some]
            piece[at] = new
            due[at] = self.order[new] + at // n

        first = cells[: (high - 1) * n]
        meet(first, flat[first], flat[first + n], first % n)
        while True:
            best = turn[:high].min(axis=0)
            column = np.flatnonzero(best < none)
            if not len(column):
                break
            i = (best[column] % LONGEST) * n + column
            j = right[i]
            k, h, new = right[j], left[i], piece[i]
            flat[i], flat[j], due[j] = new, -1, none
            right[i], left[k] = k, i
            before, behind = flat[h], flat[k]
            meet(np.concatenate([i, h]), np.concatenate([new, before]), np.concatenate([behind, new]), np.concatenate([column, column]))
        symbols[places[inside]] = own[:high][inside]

    def ids(self, symbols: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of merged symbols, and how many of them come before each place (and in all)."""
        width = (symbols >= 0).astype(np.int64)
        bare = np.flatnonzero(symbols >= self.known)
        chars, which = np.unique(codes[bare], return_inverse=True)
        raw = [(SPACE if c == " " else c).encode("utf-8") for c in map(chr, chars.tolist())]
        width[bare] = np.array([len(r) for r in raw], np.int64)[which] if raw else 0
        before = np.r_[0, np.cumsum(width)]
        out = np.zeros(before[-1], "<u4")
        whole = np.flatnonzero((symbols >= 0) & (symbols < self.known))
        out[before[whole]] = symbols[whole]
        byte = np.array([[self.pieces.byte[b] for b in r.ljust(4, b"\0")] for r in raw], np.int64).reshape(-1, 4)
        for b in range(4):
            some = width[bare] > b
            out[before[bare[some]] + b] = byte[which[some], b]
        return out, before


@functools.cache
def _pieces(path: str) -> Pieces:
    return Pieces(path)


@functools.cache
def _plain(path: str) -> Neighbours:
    return Neighbours(_pieces(path))


def chunk_keys(n: int, doc_id: int | None, seed: int) -> np.ndarray:
    """A key for each of the n chunks of a document."""
    return _keys(np.full(n, _start(doc_id, seed), np.uint64), np.arange(1, n + 1))


def _start(doc_id: int | None, seed: int) -> int:
    return xxhash.xxh64_intdigest(str(doc_id).encode(), seed & _MASK)


def _keys(start: np.ndarray, number: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(start + number.astype(np.uint64) * np.uint64(_MIX[0]))


def _parts(texts: Sequence[str]) -> Iterator[list[tuple[int, str]]]:
    """Lists of (number of a text, piece of it that starts with a chunk) of about REMEMBERED characters."""
    held, room = [], REMEMBERED
    for n, text in enumerate(texts):
        text, at = " " + text if text else "", 0
        while at < len(text):
            cut = _START.search(text, at + max(1, room)) if len(text) - at > room else None
            end = cut.start() if cut else len(text)
            held.append((n, text[at:end]))
            room -= end - at
            at = end
            if room <= 0:
                yield held
                held, room = [], REMEMBERED
    if held:
        yield held


def encode_texts(texts: Sequence[str], doc_ids: Sequence[int | None], path: str, dropout: float = DROPOUT, seed: int = SEED) -> list[bytes]:
    """Ids of each text as little-endian 32-bit words; an empty text has none."""
    known, limit = _plain(path), int(dropout * 2.0**64)
    out: list[list[bytes]] = [[] for _ in texts]
    chunks_before = [0] * len(texts)
    for held in _parts(texts):
        codes = np.frombuffer("".join([part for _, part in held]).encode("utf-32-le"), "<u4")
        bounds = np.cumsum([0, *(len(part) for _, part in held)])
        space = codes == 32
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[bounds[:-1]] = True
        starts = np.flatnonzero(opens)
        lengths = np.diff(starts, append=len(codes))
        first = np.searchsorted(starts, bounds)
        counts = np.diff(first)
        begun = np.array([chunks_before[n] for n, _ in held]) - first[:-1] + 1
        key = np.array([_start(doc_ids[n], seed) for n, _ in held], np.uint64)
        keys = _keys(np.repeat(key, counts), np.arange(len(starts)) + np.repeat(begun, counts))
        symbols = known.of_code[codes]
        known.merge(symbols, codes, starts, lengths, keys, limit)
        ids, before = known.ids(symbols, codes)
        for (n, _), a, b, count in zip(held, before[bounds[:-1]].tolist(), before[bounds[1:]].tolist(), counts.tolist()):
            out[n].append(ids[a:b].tobytes())
            chunks_before[n] += count
    return [b"".join(x) for x in out]


def encode_text(text: str, doc_id: int | None, path: str, dropout: float = DROPOUT, seed: int = SEED) -> bytes:
    """Ids of a text as little-endian 32-bit words; an empty text has none."""
    return encode_texts([text], [doc_id], path, dropout, seed)[0]


def decode_ids(ids: bytes, path: str) -> str:
    """The text of ids; the space put in front of a text is taken off again."""
    raw = _pieces(path).raw
    return b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8")[1:]


def encode(docs: DataFrame, model: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, ids) of every document.

    Null and empty texts have no ids; a null doc_id stays null; rows that repeat are encoded alike; an empty table
    gives no rows; other columns are ignored. Characters without a piece become bytes, and so does a
    space mark that stands in the text, so every text decodes to itself.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                ids = encode_texts(some.column(1).to_pylist(), some.column(0).to_pylist(), path, dropout, seed)
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                flat = np.frombuffer(b"".join(ids), "<i4")
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([some.column(0), lists], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(np.asarray(x.as_py() or [], "<u4").tobytes(), path) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, model: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and whether the ids decode to the text, without handing the ids on."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                texts = some.column(1).to_pylist()
                ids = encode_texts(texts, some.column(0).to_pylist(), path, dropout, seed)
                counts, crcs = [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids]
                same = [decode_ids(x, path) == t for x, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())],
                    names=["doc_id", "n_pieces", "ids_crc32", "lossless"],
                )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")


@llm_query("op3_merge_dropout")
def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"))
