"""What a worker holds while it encodes is bounded by bytes, and its ids stay those of plain merges."""

from __future__ import annotations

import random
import tracemalloc
from types import SimpleNamespace
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest

from folioforge.llm import bpe

RANKS = {bytes([b]): b for b in range(256)} | {p: 256 + i for i, p in enumerate((b"ab", b"abab", b"ba", b"aab", b"cab", b"abc", b"bb", b"aa", b"aaaa"))}


def _plain(word: bytes) -> list[int]:
    pieces = [bytes([b]) for b in word]
    while True:
        pairs = [(RANKS[x + y], i) for i, (x, y) in enumerate(zip(pieces, pieces[1:])) if x + y in RANKS]
        if not pairs:
            return [RANKS[p] for p in pieces]
        at = min(pairs)[1]
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]


@pytest.fixture
def make(monkeypatch):
    monkeypatch.setattr(bpe, "F", MagicMock())
    docs = MagicMock()
    docs.sparkSession.sparkContext.broadcast.return_value = SimpleNamespace(value=RANKS)
    bpe.encode(docs, RANKS, r"[a-z0-9]+| ")
    return docs.select.return_value.mapInArrow.call_args[0][0]


def _batch(texts: list[str | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


def test_ids_are_those_of_plain_merges_when_words_are_forgotten(make, monkeypatch):
    draw = random.Random(5)
    words = ["".join(draw.choices("abc", k=draw.choice((1, 5, 30, 48, 49, 200)))) for _ in range(150)]
    texts = [None, "", *[" ".join(draw.choices(words, k=9)) for _ in range(120)], " ".join(words)]
    monkeypatch.setattr(bpe, "KEPT", 20)
    monkeypatch.setattr(bpe, "SLICE_BYTES", 3_000, raising=False)
    got = [np.frombuffer(x, "<u4").tolist() for out in make(iter([_batch(texts)])) for x in out.column(2).to_pylist()]
    merged = {w: _plain(w.encode()) for w in [*words, " "]}
    parts = [" ".join((t or "").split(" ")).replace(" ", "\0 \0").split("\0") if t else [] for t in texts]
    assert got == [[i for part in one for i in merged[part]] for one in parts]


def test_memory_follows_the_bytes_of_a_slice(make):
    texts = [" ".join(f"w{row * 3000 + i}" for i in range(3000)) for row in range(100)]
    batch = _batch(texts)
    del texts
    tokens = sum(sum(out.column(1).to_pylist()) for out in make(iter([batch.slice(0, 1)])))
    assert tokens > 0
    tracemalloc.start()
    rows = sum(len(out) for out in make(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 100
    assert peak < 90_000_000, peak
