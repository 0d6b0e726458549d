"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are at most MAX_EXAMPLES labelled rows, those with the smallest hashes; the rows with crc32(doc_id) mod FOLDS = 0 are never
among them. Terms are whole words, lower-cased. All words whose share among the toxic examples differs upward by a chi-square
of MIN_CHI2 or more span the vectors; their number is not capped, and is bounded by the words of the examples. Document frequencies are
counted over all documents.

Per term the index keeps the examples' weights in blocks with each block's largest. A query takes blocks in order of
their bounds and stops when no bound reaches its k-th best cosine, so that its k nearest are exact. Their votes are weighted by
the cosine, and a logistic curve fitted to the examples' own leave-one-out votes makes scores of them. A text without any
of the terms gets the rate of toxic examples among those without. A text that is itself an example has no vote in its own score, nor
have its copies among the examples, so that a score depends on the text and on what other texts are labelled.

Defined cases: a null or empty text has no terms; a null label is no label and repeated labels of a doc_id are averaged (toxic
from 0.5 on); a null doc_id has no label and is held out if crc32('') mod FOLDS = 0, which it is; without toxic examples every
score is 0; equal cosines go by the example's doc_id; very long texts are counted whole; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import text_of, written
from folioforge.llm.rowfilter import staying

MAX_EXAMPLES = 8192
MIN_CHI2 = 25.0
FOLDS = 5
NEIGHBOURS = 15
BLOCK = 64
LETTERS = r"\p{L}+"
#: Scores that a worker remembers before it starts afresh.
KEPT = 300_000


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def examples_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the rows to learn from: at most MAX_EXAMPLES."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES)


def select_terms(docs: DataFrame, examples: DataFrame) -> list[str]:
    """The terms that set toxic examples apart."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text_of()).alias("text")).join(F.broadcast(examples), "doc_id")
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0)))
    terms = texts.select("toxic", F.explode(words).alias("term"))
    counts = terms.groupBy("term").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    total = examples.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    toxic, n = float(total[0] or 0), float(total[1])
    if toxic == 0 or toxic == n:
        return []
    a, b = F.col("a"), F.col("b")
    ratio = (a * (n - toxic - b) - b * (toxic - a)) ** 2 * n / (toxic * (n - toxic) * (a + b) * F.greatest(F.lit(0.5), n - a - b))
    best = counts.where((a + b >= 4) & (a / toxic > b / (n - toxic))).withColumn("chi2", ratio).where(F.col("chi2") >= MIN_CHI2)
    return [r["term"] for r in best.orderBy("term").collect()]  # some words of the examples


def row_of() -> Column:
    """The SHA-256 of the text, null as empty: rows of one text have one score."""
    return F.unhex(F.sha2(text_of(), 256))


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, row (see row_of), terms (numbers in `terms`), counts: of the whole texts."""
    numbers = {t: i for i, t in enumerate(terms)}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(LETTERS).findall
        for batch in batches:
            out_terms, out_counts = [], []
            for text in batch.column(2).to_pylist():
                found = Counter(numbers[word] for word in split(text.lower()) if word in numbers) if text and numbers else Counter()
                order = sorted(found)
                out_terms.append(order)
                out_counts.append([found[t] for t in order])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out_terms, pa.list_(pa.int32())), pa.array(out_counts, pa.list_(pa.int32()))], ["doc_id", "row", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_of().alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(make, "doc_id long, row binary, terms array<int>, counts array<int>")


class BlockMaxIndex:
    """Term by term the examples' weights, in blocks, and the largest weight of each block."""

    def __init__(self, ids: list[int], toxic: list[int], vectors: list[dict[int, float]], idf: np.ndarray, rows: list[bytes] | None = None):
        order = sorted(range(len(ids)), key=lambda i: (min(vectors[i]), ids[i]))  # alike examples in one block
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.toxic = np.array([toxic[i] for i in order], np.float64)
        self.places: dict[bytes, list[int]] = {}
        for place, i in enumerate(order):
            self.places.setdefault(rows[i] if rows else str(ids[i]).encode(), []).append(place)
        self.idf, n = idf, len(order)
        self.blocks = -(-n // BLOCK) if n else 0
        self.weights = np.zeros((len(idf), self.blocks * BLOCK))
        for place, i in enumerate(order):
            for t, w in self.unit(vectors[i]).items():
                self.weights[t, place] = w
        self.most = self.weights.reshape(len(idf), self.blocks, BLOCK).max(axis=2) if n else np.zeros((len(idf), 0))
        self.curve = (0.0, 0.0)

    def unit(self, counts: dict[int, float]) -> dict[int, float]:
        weights = {t: (1 + np.log(c)) * self.idf[t] for t, c in counts.items()}
        norm = np.sqrt(sum(w * w for w in weights.values()))
        return {t: w / norm for t, w in weights.items()}

    def nearest(self, counts: dict[int, float], k: int, without: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples but those at some places, nearest first."""
        query = self.unit(counts)
        terms = np.fromiter(query, np.int64, len(query))
        q = np.fromiter(query.values(), np.float64, len(query))
        bounds = q @ self.most[terms]
        order = np.argsort(-bounds, kind="stable")
        places, cosines, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        at = 0
        while at < len(order) and bounds[order[at]] > 0 and bounds[order[at]] >= least - 1e-12:
            step = order[at : at + 8]
            step = step[(bounds[step] > 0) & (bounds[step] >= least - 1e-12)]
            rows = (step[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            scores = q @ self.weights[np.ix_(terms, rows)]
            keep = scores > 0
            if len(without):
                keep &= ~np.isin(rows, without)
            places, cosines = np.concatenate([places, rows[keep]]), np.concatenate([cosines, scores[keep]])
            best = np.lexsort((self.ids[places], -np.round(cosines, 12)))[:k]
            places, cosines = places[best], cosines[best]
            least = cosines[-1] if len(cosines) == k else 0.0
            at += 8
        return places, cosines

    def vote(self, places: np.ndarray, cosines: np.ndarray, prior: float) -> float:
        """Share of toxic among the neighbours by cosine; the prior counts as half a neighbour."""
        return float((cosines @ self.toxic[places] + 0.5 * prior) / (cosines.sum() + 0.5))

    def calibrate(self, vectors: list[tuple[bytes, dict[int, float]]], prior: float) -> None:
        """A logistic curve over the logit of the votes that each example's text gets from the others."""
        x, y = [], []
        for row, counts in vectors:
            own = self.places[row]
            x.append(_logit(self.vote(*self.nearest(counts, NEIGHBOURS, own), prior)))
            y.append(self.toxic[own].mean())
        x, y = np.array(x), np.array(y)
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps with a weak pull to (1, 0)
            p = 1 / (1 + np.exp(-(a * x + b)))
            w = p * (1 - p)
            g = np.array([((y - p) * x).sum() - (a - 1), (y - p).sum() - b])
            h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
            step = np.linalg.solve(h, g)
            a, b = a + step[0], b + step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.curve = (float(max(a, 1e-3)), float(b))

    def score(self, vote: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * _logit(vote) + b))))


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and the evidence: neighbour_ids, cosines, neighbour_toxic."""
    return _scored(docs, labels).drop("row")


def _scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    examples = written(examples_of(docs, labels), "toxic-examples")
    terms = select_terms(docs, examples)
    rows = written(term_counts(docs, terms), "toxic-terms")
    n = rows.count()
    idf = np.ones(len(terms))
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term
        idf[r["t"]] = np.log((1 + n) / (1 + r["count"])) + 1
    known = rows.join(F.broadcast(examples), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min(F.struct("terms", "counts", "row")).alias("v")).orderBy("doc_id").collect()  # MAX_EXAMPLES rows at most
    vectors = [(bytes(r["v"]["row"]), dict(zip(r["v"]["terms"], r["v"]["counts"]))) for r in known]
    seen = [i for i, (_, v) in enumerate(vectors) if v]
    toxic = [r["toxic"] for r in known]
    plain = [toxic[i] for i, (_, v) in enumerate(vectors) if not v]
    prior = sum(toxic) / len(toxic) if toxic else 0.0
    bare = (sum(plain) + prior) / (len(plain) + 1)
    index = BlockMaxIndex([known[i]["doc_id"] for i in seen], [toxic[i] for i in seen], [vectors[i][1] for i in seen], idf, [vectors[i][0] for i in seen])
    if seen:
        index.calibrate([vectors[i] for i in seen], prior)
    shared = spark.sparkContext.broadcast(index)  # the terms by MAX_EXAMPLES weights at most
    schema = "doc_id long, row binary, score double, neighbour_ids array<long>, cosines array<double>, neighbour_toxic array<int>"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, done = shared.value, {}
        for batch in batches:
            scores, ids, cosines, votes = [], [], [], []
            if len(done) > KEPT:
                done.clear()
            for row, t, c in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)]):
                own = index.places.get(row, ())
                key = (tuple(t), tuple(c), row if own else None)
                if key not in done:
                    places, cos = index.nearest(dict(zip(t, c)), NEIGHBOURS, own) if t and index.blocks else (np.zeros(0, np.int64), np.zeros(0))
                    value = index.score(index.vote(places, cos, prior)) if len(places) else bare
                    done[key] = (round(value, 9), index.ids[places].tolist(), np.round(cos, 9).tolist(), index.toxic[places].astype(int).tolist())
                for out, value in zip((scores, ids, cosines, votes), done[key]):
                    out.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(ids, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64())), pa.array(votes, pa.list_(pa.int32()))],
                ["doc_id", "row", "score", "neighbour_ids", "cosines", "neighbour_toxic"],
            )

    scored = rows.mapInArrow(make, schema)
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", "row", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), "neighbour_ids", "cosines", "neighbour_toxic")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score 0.5 or more. The score is of the text, so each row goes or stays by its own text, whether its
    doc_id is null, repeated or neither. Texts are not moved (see rowfilter); other columns stay with their row."""
    verdicts = _scored(docs, labels).groupBy("row").agg((F.max("predicted") < 1).alias("stays"))
    return staying(docs, [row_of()], verdicts)
