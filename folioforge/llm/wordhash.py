"""Word and shingle hashes of whole texts, for batches of texts at a time, with NumPy.

Words are runs of other bytes than white space, A-Z lower-cased. A word's hash is a polynomial over a random byte table with
the place in the word as exponent, finished by a mixer, so that it does not depend on where the word stands.
"""

from __future__ import annotations

import numpy as np

from folioforge.llm.common import UPPER

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(4096, np.uint64)
_POWERS[1:] = np.cumprod(np.full(4095, _BASE, np.uint64))
#: Bytes hashed at once; a longer text is cut at white space.
PIECE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words, and where they start."""
    buf = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[buf]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    at = np.flatnonzero(inside)
    place = np.arange(len(at), dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    values = _TABLE[buf[at]] * _POWERS[place & 4095]
    if lengths.max() > 4096:
        values = values * (np.uint64(2) * (place >> 12).astype(np.uint64) + np.uint64(1))
    sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
    return mixed(sums + lengths.astype(np.uint64) * _BASE), starts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts one after another, and how many each text has."""
    found, counts = [], np.zeros(len(texts), np.int64)
    group: list[bytes] = []
    first = size = 0

    def flush(until: int) -> None:
        nonlocal first, size
        if group:
            hashes, starts = _hash_piece(b" ".join(group).translate(_LOWER))
            bounds = np.cumsum([0] + [len(x) + 1 for x in group])
            counts[first:until] = np.diff(np.searchsorted(starts, bounds))
            found.append(hashes)
            group.clear()
        first, size = until, 0

    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > PIECE:
            flush(i)
            for piece in _cut(data):
                hashes, _ = _hash_piece(piece.translate(_LOWER))
                found.append(hashes)
                counts[i] += len(hashes)
            first = i + 1
            continue
        if size + len(data) > PIECE:
            flush(i)
        group.append(data)
        size += len(data) + 1
    flush(len(texts))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), counts


def _cut(data: bytes):
    """Pieces of about PIECE bytes that end at white space; a word is never cut."""
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            while end < len(data) and not _SPACE[data[end]]:
                end += 1
        yield data[at:end]
        at = end


def shingle_hashes(words: np.ndarray, counts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle: n words each, or all words of a text that has fewer; none without words."""
    owner = np.repeat(np.arange(len(counts)), counts)
    total = len(words)
    starts = np.cumsum(counts) - counts
    mult = mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    if total >= n:
        whole = total - n + 1
        sums = np.zeros(whole, np.uint64)
        for k in range(n):
            sums += words[k : k + whole] * mult[k]
        full = owner[:whole] == owner[n - 1 :]
        hashes, owners = mixed(sums[full]), owner[:whole][full]
    else:
        hashes, owners = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = counts[short] > k
            extra[has] += words[starts[short][has] + k] * mult[k]
        extra = mixed(extra + counts[short].astype(np.uint64) * _BASE)
        hashes, owners = np.concatenate([hashes, extra]), np.concatenate([owners, short])
    return hashes, owners


def distinct(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once per text, in order of text and hash."""
    if not len(hashes):
        return hashes, owners
    if np.any(owners[1:] < owners[:-1]):
        order = np.argsort(owners, kind="stable")
        hashes, owners = hashes[order], owners[order]
    hashes = hashes.copy()
    bounds = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(hashes)]
    for a, b in zip(bounds, bounds[1:]):
        hashes[a:b].sort()
    new = np.empty(len(hashes), bool)
    new[0] = True
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[new], owners[new]
