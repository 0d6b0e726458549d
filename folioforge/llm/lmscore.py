"""LM scoring by cross-entropy difference of matched target and background bigram models over one vocabulary.

The target is the documents labelled of good quality, the background unlabelled documents; the larger side is thinned by hash until
both have as many words. The vocabulary is every word of all documents, named by a 64-bit hash, so it grows with the corpus; text
starts have a name of their own. Documents lie in blocks of about BLOCK_WORDS words, as places in the block's sorted distinct words.
A block sends each of its distinct bigrams and words once to the fragment of its key (by hash), with its counts in both models and how
often the word ends a document: a word is a predecessor everywhere else, so that predecessors need no keys of their own. The fragment
sums the counts of all blocks and sends them back to the blocks that asked, where the documents are scored. So
neither a vocabulary nor an n-gram table is broadcast or reaches the driver, and what travels is a block's distinct keys and not all
of its words. A model document's own counts of bigrams, words and predecessors are taken out while it is scored.

Defined cases: a null text or one without words has 0 words, losses of 0 and score 0; a null doc_id has no label; repeated rows are scored
each and count each; labels of one doc_id are averaged (good from 0.5 on); without labelled rows both models are uniform and scores
are 0; very long texts are hashed whole; an empty table gives an empty result; other columns are not read. Losses are rounded to 6 places.
A document that occurs twice in the background has its own counts taken out once, so that its copy still vouches for it; copies are
scored like any other text and are not told apart from frequent language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.arrowtools import restored, squeezed
from folioforge.llm.common import written
from folioforge.llm.wordhash import mixed, word_hashes

#: Smoothing counts at least this many words and 1, and all words of the corpus where they are more; no word is left out.
LEAST_WORDS = 65_535
MAX_WORDS = LEAST_WORDS  # the name that tests use
#: Words per block, at the end of the row that reaches them: a task holds some arrays of that many numbers.
BLOCK_WORDS = 2_000_000
#: Words per fragment; fewer distinct keys reach it. The number of fragments (a power of two) follows the words.
FRAGMENT_WORDS = 3_000_000
#: Draws that thin the larger side are whole numbers under this.
DRAWS = 1 << 30
#: Weight of the bigram model against the word model.
BIGRAM = 0.7
TARGET, BACKGROUND, NEITHER = 1, 2, 0
#: The name of a text start, and what parts the keys of words and of the text start from those of bigrams. Only words' keys are odd.
START = np.uint64(0x5851F42D4C957F2D)
OF_WORD, OF_START = np.uint64(0x14057B7EF767814F), np.uint64(0x2545F4914F6CDD1D)


BLOCK = "block long, doc_ids array<long>, good binary, draws binary, lengths binary, n_names long, names binary, words binary, n_words long, good_words long, other_words long"


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id, good (1, 0, or -1 without a label), draw and text, some documents to each block."""
    task, made = TaskContext.get().partitionId(), 0

    def block(held: list[tuple]) -> pa.RecordBatch:
        doc_ids = [x for part in held for x in part[0].to_pylist()]
        good, draws, n = (np.concatenate([part[i] for part in held]) for i in (1, 2, 3))
        names, words = np.unique(np.concatenate([part[4] for part in held]), return_inverse=True)
        numbers = [int(x) for x in (n.sum(), n[good == 1].sum(), n[good == -1].sum())]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([task << 32 | made]),
                pa.array([doc_ids], pa.list_(pa.int64())),
                *[pa.array([x.tobytes()], pa.binary()) for x in (good.astype(np.int8), draws.astype(np.uint32), n.astype(np.uint32))],
                pa.array([len(names)]),
                pa.array([squeezed(np.diff(names, prepend=np.uint64(0)), "<u8")], pa.binary()),
                pa.array([squeezed(words)], pa.binary()),
                *[pa.array([x]) for x in numbers],
            ],
            [x.split()[0] for x in BLOCK.split(", ")],
        )

    held, size = [], 0
    for whole in batches:
        for at in range(0, len(whole), 32):
            batch = whole.slice(at, 32)
            words, n = word_hashes(batch.column("text").to_pylist())
            held.append((batch.column("doc_id"), batch.column("good").to_numpy(), batch.column("draw").to_numpy(), n, words))
            size += len(words)
            if size >= BLOCK_WORDS:
                yield block(held)
                held, size, made = [], 0, made + 1
    if held:
        yield block(held)


class _Documents:
    """One block's documents: the owner of every word, and each document's role in the models."""

    def __init__(self, row: dict, limits: tuple[float, float]):
        self.doc_ids = row["doc_ids"]
        self.lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
        good, draws = np.frombuffer(row["good"], np.int8), np.frombuffer(row["draws"], np.uint32)
        self.roles = np.where((good == 1) & (draws < limits[0]), TARGET, np.where((good == -1) & (draws < limits[1]), BACKGROUND, NEITHER))
        self.owner = np.repeat(np.arange(len(self.lengths), dtype=np.int64), self.lengths)
        self.names = np.append(np.cumsum(restored(row["names"], row["n_names"], "<u8"), dtype=np.uint64), START)
        self.after = restored(row["words"], int(self.lengths.sum()))
        self.before = np.empty_like(self.after)
        self.before[1:] = self.after[:-1]
        ends = np.cumsum(self.lengths)[self.lengths > 0]
        self.first, self.last = ends - self.lengths[self.lengths > 0], ends - 1
        self.before[self.first] = len(self.names) - 1

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The keys of the distinct bigrams, words and the text start in order, and where among them those of every bigram, word and
        predecessor are."""
        if not len(self.after):
            none = np.zeros(0, np.int32)
            return np.zeros(0, np.uint64), none, none, none
        size = np.uint64(len(self.names))
        pairs, place = np.unique(self.before * size + self.after, return_inverse=True)
        two = mixed(mixed(self.names[pairs // size]) + self.names[pairs % size]) & ~np.uint64(1)
        one = np.append(mixed(self.names[:-1] + OF_WORD) | np.uint64(1), mixed(START + OF_START) & ~np.uint64(1))
        keys = np.concatenate([two, one])
        order = np.argsort(keys)
        moved = np.empty(len(order), np.int32)
        moved[order] = np.arange(len(order), dtype=np.int32)
        one_at = moved[len(two) :]
        return keys[order], moved[: len(two)][place], one_at[self.after], one_at[self.before]

    def counts(self, keys: np.ndarray, places: list[np.ndarray], role: int) -> tuple[np.ndarray, np.ndarray]:
        """How often every key occurs in one model, and how often it ends a document there."""
        inside = self.roles[self.owner] == role
        place, word_place, head_place = places
        whole = np.bincount(place[inside], minlength=len(keys)) + np.bincount(word_place[inside], minlength=len(keys))
        whole += np.bincount(head_place[self.first[inside[self.first]]], minlength=len(keys))
        return whole, np.bincount(word_place[self.last[inside[self.last]]], minlength=len(keys))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


ASKED = "block long, fragment int, k int, keys binary, target binary, background binary, target_ends binary, background_ends binary"
#: The ends are those of the words among the keys, n_words of them.
COUNTED = (
    "block long, fragment int, k int, n_words int, target binary, background binary, target_ends binary, background_ends binary, "
    "kinds long, target_words long, background_words long"
)


def _asked(bits: int, limits: tuple[float, float]):
    """Per block and fragment: the block's distinct keys and their counts in both models."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            docs = _Documents(row, limits)
            keys, *places = docs.keys()
            if not len(keys):
                continue
            fragments = (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
            counts, ends = zip(*[docs.counts(keys, places, r) for r in (TARGET, BACKGROUND)])
            is_word = (keys & np.uint64(1)).astype(bool)
            starts = np.flatnonzero(np.append(True, fragments[1:] != fragments[:-1]))
            spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(spans), row["block"], np.int64)),
                    pa.array(fragments[starts]),
                    pa.array([e - s for s, e in spans], pa.int32()),
                    pa.array([squeezed(np.diff(keys[s:e], prepend=np.uint64(0)), "<u8") for s, e in spans], pa.binary()),
                    *[pa.array([squeezed(c[s:e]) for s, e in spans], pa.binary()) for c in counts],
                    *[pa.array([squeezed(c[s:e][is_word[s:e]]) for s, e in spans], pa.binary()) for c in ends],
                ],
                [x.split()[0] for x in ASKED.split(", ")],
            )

    return make


def _counted(table: pa.Table) -> pa.Table:
    """Of one fragment: each block's keys again, now with the counts of all blocks; and how many words the fragment has and counts."""
    sizes = table["k"].to_pylist()
    keys = np.concatenate([np.cumsum(restored(x, k, "<u8"), dtype=np.uint64) for x, k in zip(table["keys"].to_pylist(), sizes)])
    asked_words = (keys & np.uint64(1)).astype(bool)
    kinds, place = np.unique(keys, return_inverse=True)
    del keys
    is_word = (kinds & np.uint64(1)).astype(bool)
    spans = [(e - k, e) for e, k in zip(np.cumsum(sizes).tolist(), sizes)]
    n_words = [int(asked_words[s:e].sum()) for s, e in spans]
    out, out_ends, totals = [], [], [int(is_word.sum())]
    for name in ("target", "background"):
        parts = np.concatenate([restored(x, k) for x, k in zip(table[name].to_pylist(), sizes)])
        whole = np.bincount(place, parts, minlength=len(kinds))
        totals.append(int(whole[is_word].sum()))
        whole = whole[place]
        out.append(pa.array([squeezed(whole[s:e]) for s, e in spans], pa.binary()))
        parts = np.concatenate([restored(x, k) for x, k in zip(table[f"{name}_ends"].to_pylist(), n_words)])
        whole = np.bincount(place[asked_words], parts, minlength=len(kinds))[place]
        out_ends.append(pa.array([squeezed(whole[s:e][asked_words[s:e]]) for s, e in spans], pa.binary()))
    totals = [pa.array(np.full(len(sizes), x, np.int64)) for x in totals]
    columns = [table["block"], table["fragment"], table["k"], pa.array(n_words, pa.int32()), *out, *out_ends, *totals]
    return pa.table(columns, [x.split()[0] for x in COUNTED.split(", ")])


SCORED = "doc_id long, n_words long, target_loss double, background_loss double"


def _own(owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How often every word's key occurs in its document."""
    key = owner << 32 | place
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    runs = np.diff(np.append(new, len(order))).astype(np.int32)
    own = np.empty(len(order), np.int32)
    own[order] = np.repeat(runs, runs)
    return own


def _scored(limits: tuple[float, float], vocabulary: int, totals: dict[int, int]):
    def make(blocks: pa.Table, counted: pa.Table) -> pa.Table:
        parts: list[pa.Table] = []
        counted = counted.sort_by("fragment")
        sizes, n_words = counted["k"].to_pylist(), counted["n_words"].to_pylist()
        for row in _rows(blocks.to_batches()):
            docs = _Documents(row, limits)
            keys, place, word_place, head_place = docs.keys()
            if sum(sizes) != len(keys):
                raise RuntimeError("a block's keys did not all come back")
            is_word = (keys & np.uint64(1)).astype(bool)
            own, own_word, own_head = (_own(docs.owner, x) for x in (place, word_place, head_place))
            role = docs.roles[docs.owner]
            losses = []
            for r, name in ((TARGET, "target"), (BACKGROUND, "background")):
                counts = np.concatenate([np.zeros(0, np.uint32), *[restored(x, k) for x, k in zip(counted[name].to_pylist(), sizes)]]).astype(np.int64)
                heads = counts.copy()
                heads[is_word] -= np.concatenate([np.zeros(0, np.uint32), *[restored(x, k) for x, k in zip(counted[f"{name}_ends"].to_pylist(), n_words)]])
                inside = role == r
                word = counts[word_place] - inside * own_word + 1.0
                word /= totals[r] + vocabulary
                head = heads[head_place] - inside * own_head
                pair = np.where(head > 0, (counts[place] - inside * own) / np.maximum(head, 1), word)
                loss = -np.log(BIGRAM * pair + (1 - BIGRAM) * word)
                losses.append(np.bincount(docs.owner, loss, minlength=len(docs.lengths)) / np.maximum(docs.lengths, 1))
            parts.append(pa.table({"doc_id": pa.array(docs.doc_ids, pa.int64()), "n_words": pa.array(docs.lengths), "target_loss": losses[0], "background_loss": losses[1]}))
        return pa.concat_tables(parts)

    return make


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss (nats per word), score: their difference, lower is more like the target."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))
    good = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    # Labels grow with the documents: the same shuffled join at every size, where AQE can split a hot doc_id.
    rows = rows.join(good.hint("merge"), rows["doc_id"] == good["of"], "left")
    rows = rows.select("doc_id", F.coalesce("good", F.lit(-1)).alias("good"), F.pmod(F.xxhash64("row"), F.lit(DRAWS)).alias("draw"), "text")
    blocks = written(rows.mapInArrow(_blocked, BLOCK), "lm-blocks")
    sums = blocks.agg(F.sum("good_words"), F.sum("other_words"), F.sum("n_words")).first()
    target, other, total = (int(x or 0) for x in sums)
    least = min(target, other)
    limits = (least / target * DRAWS if target else 0.0, least / other * DRAWS if other else 0.0)
    bits = min(20, int(np.ceil(np.log2(max(1, total / FRAGMENT_WORDS)))))
    asked = blocks.mapInArrow(_asked(bits, limits), ASKED)
    answers = written(asked.groupBy("fragment").applyInArrow(_counted, COUNTED), "lm-counts")
    sums = answers.groupBy("fragment").agg(*[F.first(c).alias(c) for c in ("kinds", "target_words", "background_words")])
    kinds, *totals = (int(x or 0) for x in sums.agg(F.sum("kinds"), F.sum("target_words"), F.sum("background_words")).first())
    scored = blocks.groupBy("block").cogroup(answers.drop("kinds", "target_words", "background_words").groupBy("block")).applyInArrow(
        _scored(limits, max(LEAST_WORDS + 1, kinds), dict(zip((TARGET, BACKGROUND), totals))), SCORED
    )
    t, b = F.round("target_loss", 6), F.round("background_loss", 6)
    return scored.select("doc_id", "n_words", t.alias("target_loss"), b.alias("background_loss"), F.round(t - b, 6).alias("score"))
