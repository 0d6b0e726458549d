"""Media columns: payloads as content-defined chunks in a deduplicated store, and features computed from what is read back.

A payload is a text's UTF-8 bytes, filled up with bytes 0 to a positive multiple of 64; its samples are 8-bit. A rolling gear hash
(a byte table, shifted by one per byte, so that it spans 32 bytes) cuts it where its top bits are 0, at least MIN_CHUNK and at
most MAX_CHUNK bytes after the last cut. A chunk is stored as a zlib frame under its SHA-256.

1. The chunks' digests are counted (64 bits of each). Those that occur more than once make a bitmap, which is broadcast (see rowfilter).
2. Chunks are joined to the bitmap where they are cut. A payload's row in the store is the ordered list of its chunks' digests with the
   frames of those that occur nowhere else; those never move. Frames of the other chunks go, once per digest, to the table of
   shared chunks, and their places to the table of references.
3. Reading joins the references to the shared chunks by digest (hot digests by a broadcast of bounded size, as there are fewer than
   HOT of them), brings a payload's parts together in order, and verifies each chunk against its digest and each payload against its
   SHA-256. A payload without shared chunks is read from its row alone.

Equal texts are one payload, by their SHA-256. The stored form of a payload is its frames in order, each behind its length in 4
little-endian bytes.

Defined cases: a null text is the empty text, whose payload is 64 bytes 0; a very long text is many chunks of one payload; repeated rows
share one payload; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import dropped, text_of, written
from folioforge.llm.rowfilter import bitmap, hot_join, marked

UNIT = 64
#: Well below the usual text, so that passages that texts share are chunks of their own: 1 KB on average.
MIN_CHUNK, MAX_CHUNK = 256, 8192
#: Top bits of the gear hash that are 0 at a cut: one place in 1024.
CUT_BITS = 10
#: Level of the frames.
LEVEL = 6
#: Payloads that a task remembers before it starts afresh, so as not to store copies again.
KEPT = 200_000
_GEAR = np.random.default_rng(4711).integers(0, 2**32, 256, dtype=np.uint32)


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8")
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


def gear_cuts(data: bytes) -> list[int]:
    """The ends of the chunks of one payload."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # h[i] sums the last 2k bytes, each shifted by its age
        shifted = h[:-k] << np.uint32(k)
        h[k:] += shifted
    places = (np.flatnonzero(h < np.uint32(1 << (32 - CUT_BITS))) + 1).tolist()
    cuts, last = [], 0
    for p in [*places, n]:
        while p - last > MAX_CHUNK:
            last += MAX_CHUNK
            cuts.append(last)
        if p - last >= MIN_CHUNK and p < n:
            cuts.append(p)
            last = p
    if last < n:
        cuts.append(n)
    return cuts


def _pieces(text: str | None) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Place, how many chunks there are, digest and bytes of each chunk."""
    data, start = payload_of(text), 0
    cuts = gear_cuts(data)
    for place, end in enumerate(cuts):
        piece = data[start:end]
        yield place, len(cuts), hashlib.sha256(piece).digest(), piece
        start = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """64 bits of every chunk's digest."""
    for batch in batches:
        found = [digest[:8] for text in batch.column(1).to_pylist() for _, _, digest, _ in _pieces(text)]
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(found), "<i8"))], ["h"])


CHUNK = "payload binary, place int, of int, digest binary, piece binary, h long"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every chunk of the payloads that the task has not had yet."""
    done: set[bytes] = set()
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key in done:
                continue
            if len(done) >= KEPT:
                done.clear()
            done.add(key)
            for place, of, digest, piece in _pieces(text):
                rows.append((key, place, of, digest, piece))
                size += len(piece)
                if size > 8_000_000:
                    yield _chunk_batch(rows)
                    rows, size = [], 0
        yield _chunk_batch(rows)


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows)] or [[]] * 5
    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    h = pa.array(np.frombuffer(b"".join(d[:8] for d in columns[3]), "<i8"))
    return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, kinds)], h], [x.split()[0] for x in CHUNK.split(", ")])


#: kind 0: a payload's digests, and the lengths (0 where shared) and bytes of its own frames; 1: a shared chunk, by its digest; 2: a
#: reference of a payload to a shared chunk.
PART = "kind int, payload binary, place int, digest binary, lengths binary, frames binary"
OWN, SHARED, REFERENCE = 0, 1, 2


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks in order, with `shared`: the rows of the store."""
    seen: set[bytes] = set()
    open_: list = [None, [], [], []]

    def closed() -> list[tuple]:
        key, digests, lengths, frames = open_
        return [] if key is None else [(OWN, key, -1, b"".join(digests), np.array(lengths, "<u4").tobytes(), b"".join(frames))]

    for batch in batches:
        rows: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("payload", "place", "digest", "piece", "shared")]
        for key, place, digest, piece, shared in zip(*columns):
            if place == 0:
                rows += closed()
                open_[:] = key, [], [], []
            if shared:
                rows.append((REFERENCE, key, place, digest, None, None))
                if digest not in seen:
                    rows.append((SHARED, None, None, digest, None, zlib.compress(piece, LEVEL)))
                    if len(seen) >= KEPT:
                        seen.clear()
                    seen.add(digest)
            frame = b"" if shared else zlib.compress(piece, LEVEL)
            open_[1].append(digest)
            open_[2].append(len(frame))
            open_[3].append(frame)
        yield _part_batch(rows)
    yield _part_batch(closed())


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    kinds = (pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in PART.split(", ")])


def feature_of(data: bytes) -> str:
    """Of 8-bit samples: chunk-independent figures, in whole numbers."""
    samples = np.frombuffer(data, np.uint8).astype(np.int64)
    counts = np.bincount(samples, minlength=256)
    rises = int(np.count_nonzero(np.diff(samples) > 0))
    energy = int((samples * samples).sum()) // len(samples)
    return f"n={len(samples)};mean={int(samples.sum()) * 1000 // len(samples)};energy={energy};rises={rises};kinds={int((counts > 0).sum())};mode={int(counts.argmax())}"


FEATURES = "payload binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_chunks int, feature string, verified boolean"


def _figures(key: bytes, digests: bytes, lengths: bytes, own: bytes, shared: dict[int, bytes]) -> tuple:
    """A payload's figures, from the bytes read back."""
    whole, media, size, sound, at = [], hashlib.sha256(), 0, True, 0
    for place, length in enumerate(np.frombuffer(lengths, "<u4").tolist()):
        frame = own[at : at + length] if length else shared[place]
        at += length
        piece = zlib.decompress(frame)
        sound = sound and hashlib.sha256(piece).digest() == digests[32 * place : 32 * place + 32]
        whole.append(piece)
        media.update(len(frame).to_bytes(4, "little"))
        media.update(frame)
        size += 4 + len(frame)
    data = b"".join(whole)
    return (key, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), size, media.hexdigest(), len(whole), feature_of(data), sound)


def _figure_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 9
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in FEATURES.split(", ")])


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of payloads whose frames are all their own."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("payload", "digest", "lengths", "frames")]
        yield _figure_batch([_figures(*x, {}) for x in zip(*columns)])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of payload and place: a payload's own row, perhaps more than once, then its shared chunks."""
    held: list = [None, None, {}]

    def closed() -> list[tuple]:
        return [] if held[0] is None else [_figures(held[0], *held[1], held[2])]

    for batch in batches:
        rows: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("payload", "place", "digest", "lengths", "frames")]
        for key, place, digest, lengths, frames in zip(*columns):
            if key != held[0]:
                rows += closed()
                held[:] = key, None, {}
            if place < 0:
                held[1] = digest, lengths, frames
            else:
                held[2][place] = frames
        yield _figure_batch(rows)
    yield _figure_batch(closed())


class ChunkStore:
    """Payloads as ordered lists of digests with their own frames, the shared chunks under their digests, and references to these."""

    def __init__(self, payloads: DataFrame, chunks: DataFrame, references: DataFrame):
        self.payloads, self.chunks, self.references = payloads, chunks, references

    @classmethod
    def of(cls, docs: DataFrame) -> ChunkStore:
        text = text_of()
        rows = docs.select(F.unhex(F.sha2(text, 256)).alias("payload"), text.alias("text"))
        repeated = written(rows.mapInArrow(_counted, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"), "media-repeated")
        found = rows.mapInArrow(_chunked, CHUNK)
        dealt = marked(found, F.col("h"), bitmap(repeated, repeated.count()), "shared").select("payload", "place", "digest", "piece", "shared")
        parts = written(dealt.mapInArrow(_stored, PART), "media-store", ["kind"])
        chunks = parts.where(F.col("kind") == SHARED).groupBy("digest").agg(F.first("frames").alias("frames"))
        references = parts.where(F.col("kind") == REFERENCE).select("payload", "place", "digest").distinct()
        made = cls(parts.where(F.col("kind") == OWN).drop("kind", "place"), written(chunks, "media-shared"), written(references, "media-references"))
        # Both tables hold now what these parts of the store held.
        dropped(docs.sparkSession, [f for f in parts.inputFiles() if f"/kind={SHARED}/" in f or f"/kind={REFERENCE}/" in f])
        return made

    def read(self) -> DataFrame:
        """A row per payload, rebuilt from the store."""
        lacking = F.exists(F.sequence(F.lit(0), F.shiftright(F.length("lengths"), 2) - 1), lambda i: F.hex(F.substring(F.col("lengths"), i * 4 + 1, F.lit(4))) == "00000000")
        rows = self.payloads.withColumn("lacking", lacking)
        alone = rows.where("not lacking").drop("lacking").mapInArrow(_alone, FEATURES)
        own = rows.where("lacking").select("payload", F.lit(-1).alias("place"), "digest", "lengths", "frames")
        shared = hot_join(self.references, self.chunks, "digest", self.references.count())
        shared = shared.select("payload", "place", "digest", F.lit(None).cast("binary").alias("lengths"), "frames")
        parts = own.unionByName(shared).repartition("payload").sortWithinPartitions("payload", "place")
        return alone.unionByName(parts.mapInArrow(_together, FEATURES))


def media_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and the figures of the payload as stored and read back."""
    figures = written(ChunkStore.of(docs).read(), "media")
    text = text_of()
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("payload"))
    return hot_join(rows, figures, "payload", rows.count()).drop("payload")
