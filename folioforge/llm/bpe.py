"""Byte-level BPE encoding and decoding by a rank file.

Texts are split by the tokenizer's pattern. The distinct words of a batch are byte arrays whose merges are folded all at once:
a matrix has a word's pieces in each row, every step finds each word's lowest-ranked adjacent pair (the first of equals) in a
hash table of ranks and merges it, until no word has a ranked pair left. A worker keeps what it has folded, up to KEPT words of at
most MATRIX_BYTES. Texts are looked at in slices of about SLICE_BYTES, and only the new words of a slice are held as strings.
Decoding concatenates the pieces of the ids.

Defined cases: a null text is the empty text, with no ids; unpaired surrogates cannot occur in a Spark string; repeated rows
are encoded each; an empty table gives an empty result; other columns are kept out of the way and not read.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.arrowtools import binary_column, bytes_of, ranges, released
from folioforge.llm.wordhash import mixed

#: Words that a worker remembers before it starts afresh.
KEPT = 100_000
#: Bytes of a slice's texts or ids, about, and its rows at most.
SLICE_BYTES, SLICE_ROWS = 1_000_000, 512
#: Longer words are merged one by one, with a heap.
MATRIX_BYTES = 48
_NONE = np.int32(2**31 - 1)


class RankTable:
    """Ranks of adjacent pieces in an open-addressing table, and the pieces of the ids."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= 1 << 20:
            raise ValueError("ranks from 2^20 on do not fit a pair's key")
        self.pieces = ranks
        pairs, values = array("q"), array("i")
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 20 | right)
                    values.append(rank)
        keys, values = np.array(pairs, np.int64), np.array(values, np.int32)
        bits = max(4, int(np.ceil(np.log2(len(pairs) * 4 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, _NONE, np.int32)
        left = np.arange(len(keys))
        slots = self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[left[free]]
            placed = self.keys[slots] == keys[left]
            self.ranks[slots[placed]] = values[left[placed]]
            left, slots = left[~placed], (slots[~placed] + 1) & self.mask
        size = max(ranks.values()) + 1
        lengths = np.zeros(size, np.int64)
        for piece, rank in ranks.items():
            lengths[rank] = len(piece)
        self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths
        self.bytes = np.zeros(int(lengths.sum()), np.uint8)
        for piece, rank in ranks.items():
            self.bytes[self.starts[rank] : self.starts[rank] + len(piece)] = np.frombuffer(piece, np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.view(np.uint64)) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or _NONE; negative ids have none."""
        keys = left.astype(np.int64) << 20 | right
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.ranks[slots], _NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & self.mask
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        out[(left < 0) | (right < 0)] = _NONE
        return out

    def fold(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids: list = [None] * len(words)
        for low, high in ((0, 8), (8, 16), (16, 28), (28, MATRIX_BYTES)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for at in range(0, len(rows), 1 << 14):
                part = rows[at : at + (1 << 14)]
                for row, got in zip(part.tolist(), self._fold_matrix([words[i] for i in part], high)):
                    ids[row] = got
        for row in np.flatnonzero(sizes > MATRIX_BYTES):
            ids[row] = self._fold_long(words[row])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return flat, np.fromiter(map(len, ids), np.int64, len(ids))

    def _fold_matrix(self, words: list[bytes], width: int) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.full((len(words), width + 2), -1, np.int32)
        ids[:, :width] = np.where(np.arange(width) < sizes[:, None], self.single[data], -1)
        best = np.full((len(words), width + 1), _NONE, np.int32)
        best[:, : width - 1] = self.of(ids[:, : width - 1].ravel(), ids[:, 1:width].ravel()).reshape(len(words), -1)
        columns = np.arange(width + 1)
        active = np.arange(len(words))
        while True:
            where = best[active].argmin(axis=1)
            lowest = best[active, where]
            going = lowest != _NONE
            active, where, lowest = active[going], where[going], lowest[going]
            if not len(active):
                break
            shift = columns[None, :] > where[:, None]
            part = ids[active]
            part[:, :-1] = np.where(shift, part[:, 1:], part[:, :-1])
            part[np.arange(len(active)), where] = lowest
            ids[active] = part
            ranks = best[active]
            ranks[:, :-1] = np.where(shift[:, :-1], ranks[:, 1:], ranks[:, :-1])
            rows = np.arange(len(active))
            ranks[rows, where] = self.of(part[rows, where], part[rows, where + 1])
            inner = where > 0
            ranks[rows[inner], where[inner] - 1] = self.of(part[rows[inner], where[inner] - 1], part[rows[inner], where[inner]])
            best[active] = ranks
        counts = (ids >= 0).sum(axis=1)
        flat = ids[ids >= 0]
        return np.split(flat, np.cumsum(counts)[:-1])

    def _fold_long(self, word: bytes) -> np.ndarray:
        """The same merges for one long word: a heap of (rank, place) over a linked list. A pair is named by the bytes from its place on."""
        pieces = self.single[np.frombuffer(word, np.uint8)].tolist()
        n, rank_of = len(pieces), self.pieces.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if pieces[i] < 0 or j >= n or rank_of(word[i : after[j]]) != rank:
                continue
            pieces[i], pieces[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank_of(word[i : after[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank_of(word[before[i] : after[i]])) is not None:
                heapq.heappush(heap, (r, before[i]))
        return np.array([p for p in pieces if p >= 0], np.int32)


class _Words(dict):
    """Word to number; new words are numbered as they are asked for. A number is not given twice, even if its word is deleted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.given = 0

    def __missing__(self, word: str) -> int:
        number = self[word] = self.given
        self.given += 1
        self.new.append(word)
        return number


def read_ranks(path: str) -> dict[bytes, int]:
    """Of a rank file: lines of a piece in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Spark bounds a batch by its bytes; this bounds the arrays that are made of one by the bytes of a column, but for a row that is longer."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            most = (ends[at - 1] if at else 0) + SLICE_BYTES
            to = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(ends, most, side="right"))))
            yield batch.slice(at, to - at)
            at = to


_TABLES: dict = {}


def _table(shared) -> RankTable:
    """One table per worker and vocabulary."""
    key = getattr(shared, "_path", None) or id(shared)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = RankTable(shared.value)
    return _TABLES[key]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids: unsigned 32-bit little-endian numbers one after another."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary file

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()  # what other operators left in this worker
        table, split = _table(shared), regex.compile(pattern).findall
        words, flat = _Words(), np.zeros(0, np.int32)
        starts = sizes = np.zeros(0, np.int64)
        for batch in _sliced(batches, 1):
            if words.given > KEPT or len(flat) > 16 * KEPT:
                words, flat, starts, sizes = _Words(), flat[:0], starts[:0], sizes[:0]
            found = [np.fromiter(map(words.__getitem__, split(text)), np.int64) if text else starts[:0] for text in batch.column(1).to_pylist()]
            per_text = np.fromiter(map(len, found), np.int64, len(found))
            numbers = np.concatenate(found)
            del found
            if words.new:
                ids, lengths = table.fold([w.encode() for w in words.new])
                for word in words.new:
                    if len(word) > MATRIX_BYTES:
                        del words[word]
                words.new.clear()
                starts = np.concatenate([starts, len(flat) + np.cumsum(lengths) - lengths])
                sizes, flat = np.concatenate([sizes, lengths]), np.concatenate([flat, ids])
            lengths = sizes[numbers]
            ids = flat[ranges(starts[numbers], lengths)].astype("<u4")
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(per_text)]
            counts = np.diff(np.concatenate([[0], ends]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), binary_column(ids.view(np.uint8), counts * 4)], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(make, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """encoded (doc_id, n_tokens, ids) with `decoded`, the bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shared)
        for batch in _sliced(batches, 2):
            data, lengths = bytes_of(batch.column(2))
            ids = np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
            sizes = table.lengths[ids]
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(lengths // 4)]
            out = table.bytes[ranges(table.starts[ids], sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, binary_column(out, np.diff(np.concatenate([[0], ends])))], ["doc_id", "n_tokens", "ids", "decoded"])

    rows = encoded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(make, "doc_id long, n_tokens long, ids binary, decoded binary")
