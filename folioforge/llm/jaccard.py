"""Jaccard join of word n-gram sets by vertical partitioning.

1. Rows with the same text are one text. One pass over the texts hashes each one's n-grams, in blocks of texts of about BLOCK_TEXT bytes.
   The n-gram space is cut into fragments (ranges of the hash), whose number follows the input, and a block sends each fragment one
   segment: its n-grams in order and which of the block's texts has each. So a segment is as long as the block makes it, and not
   shorter per text the more fragments there are.
2. A fragment counts in how many texts each of its n-grams occurs and keeps those of at least two. The global order is by that
   frequency, rare first, then by hash. What is left goes back to the blocks. Texts with the same set are one node.
3. A node can only have partners if enough of its n-grams are shared. Of such a node the first n-grams in the global order (as
   many as one of them must be common with any partner) are posted.
4. Candidates are made without pairing off whole groups: each node first meets one hub of its posting lists, then in each round
   more hubs, members of the list's largest component by then, and only nodes that are still in different components are paired
   one by one, under the length and position bounds. Rounds only save work: the last one pairs all that they left.
5. Candidates are verified by vertical partitioning again: the global order is cut into CHECK_FRAGMENTS fragments, each of which counts
   the partial overlap of each pair, and a pair's partial counts are summed. Their number is the same at every size of input;
   what grows is the number of buckets that pairs are dealt to, and a node's n-grams travel once to each bucket that has pairs of it.
   Links are exact for the sets of hashes.
6. Components come from star contraction.

Defined cases: a null text has an empty set; without words the set is empty, linked with nothing; with fewer words than n the whole
sequence is the one n-gram; rows with the same doc_id are rows of one document each; a null doc_id links like any other and
is never a component's name unless all are null; very long texts are hashed whole, each in a block of its own; an empty table gives an empty
result; other columns are not read. N-grams are counted by 64-bit hashes, and compared by 58 bits of them and their frequency class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.arrowtools import binary_column, bytes_of, released, restored, squeezed
from folioforge.llm.common import text_of, written
from folioforge.llm.components import components
from folioforge.llm.rowfilter import hot_join, staying
from folioforge.llm.wordhash import distinct, mixed, shingle_hashes, word_hashes

#: Bytes of text per fragment, and the most fragments (a power of two).
FRAGMENT_TEXT = 20_000_000
MAX_BITS = 18
#: Bytes and rows of a block of texts, about.
BLOCK_TEXT, BLOCK_ROWS = 8_000_000, 60_000
#: Hubs that a node meets per round before the nodes of different components are paired one by one.
HUBS = (1, 12)
#: Fragments of the global order in which candidates are verified (a power of two), and bytes of n-grams per bucket of pairs.
CHECK_BITS = 1
BUCKET_BYTES = 16_000_000
#: Bits of the frequency class in front of an n-gram's hash.
LEVEL_BITS = 6


#: A segment, or the head row of a block (k texts: digests, nodes as keys, sizes as owners), dealt to a fragment like a segment.
SEGMENT = "block long, head boolean, fragment int, k int, keys binary, owners binary, digests binary"


def _segments(bits: int, n: int):
    def flush(block: int, digests: list[bytes], hashes: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        size, keys = np.concatenate(sizes), np.concatenate(hashes)
        owners = np.repeat(np.arange(len(size), dtype=np.uint32), size)
        sums = np.zeros(len(size), np.uint64)
        np.add.at(sums, owners, mixed(keys ^ np.uint64(0x5851F42D4C957F2D)))
        nodes = mixed(sums + mixed(size.astype(np.uint64)))
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        fragments = (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
        starts = np.flatnonzero(np.append(True, fragments[1:] != fragments[:-1])) if len(keys) else np.zeros(0, np.int64)
        ends = [*starts[1:].tolist(), len(keys)] if len(keys) else []
        spans = list(zip(starts.tolist(), ends))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(1 + len(spans), block)),
                pa.array([True] + [False] * len(spans)),
                pa.array([block % (1 << bits), *fragments[starts].tolist()], pa.int32()),
                pa.array([len(size), *[e - s for s, e in spans]], pa.int32()),
                pa.array([nodes.tobytes(), *[squeezed(np.diff(keys[s:e], prepend=np.uint64(0)), "<u8") for s, e in spans]], pa.binary()),
                pa.array([size.astype("<u4").tobytes(), *[squeezed(owners[s:e]) for s, e in spans]], pa.binary()),
                pa.array([b"".join(digests)] + [None] * len(spans), pa.binary()),
            ],
            [x.split()[0] for x in SEGMENT.split(", ")],
        )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size, digests, hashes, sizes = TaskContext.get().partitionId() << 32, 0, [], [], []
        for whole in batches:
            for at in range(0, len(whole), 32):
                texts = whole.column(1).slice(at, 32).to_pylist()
                words, counts = word_hashes(texts)
                found, owners = distinct(*shingle_hashes(words, counts, n))
                digests += whole.column(0).slice(at, 32).to_pylist()
                hashes.append(found)
                sizes.append(np.bincount(owners, minlength=len(texts)).astype(np.int64))
                size += sum(len(t) for t in texts)
                if size >= BLOCK_TEXT or len(digests) >= BLOCK_ROWS:
                    yield flush(made, digests, hashes, sizes)
                    made, size, digests, hashes, sizes = made + 1, 0, [], [], []
        if digests:
            yield flush(made, digests, hashes, sizes)
        del digests, hashes, sizes
        released()

    return make


def _shared(table: pa.Table) -> pa.Table:
    """Of one fragment: the head rows, and each block's n-grams that another text has too, with their frequency class in front."""
    is_head = table["head"].to_numpy(zero_copy_only=False)
    heads, rest = table.filter(pa.array(is_head)), table.filter(pa.array(~is_head))
    if not len(rest):
        return heads
    sizes = rest["k"].to_pylist()
    keys = np.concatenate([np.cumsum(restored(x, k, "<u8"), dtype=np.uint64) for x, k in zip(rest["keys"].to_pylist(), sizes)])
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    counts = np.diff(np.append(np.flatnonzero(new), len(keys)))
    frequency = np.empty(len(keys), np.int64)
    frequency[order] = np.repeat(counts, counts)
    del order, ranked, new
    ends = np.cumsum(sizes)
    out = []
    for block, end, k, owners in zip(rest["block"].to_pylist(), ends.tolist(), sizes, rest["owners"].to_pylist()):
        keep = frequency[end - k : end] > 1
        if not keep.any():
            continue
        level = np.minimum(2**LEVEL_BITS - 1, np.floor(2 * np.log2(frequency[end - k : end][keep]))).astype(np.uint64)
        found = (level << np.uint64(64 - LEVEL_BITS)) | (keys[end - k : end][keep] >> np.uint64(LEVEL_BITS))
        out.append((block, False, 0, int(keep.sum()), found.tobytes(), squeezed(restored(owners, k)[keep]), None))
    columns = list(zip(*out)) or [()] * 7
    made = pa.table([pa.array(c, f.type) for c, f in zip(columns, table.schema)], table.schema.names)
    return pa.concat_tables([heads.cast(made.schema), made])


CANDIDATE = "block long, node long, n int, tokens binary"


def _candidates(percent: int):
    def make(table: pa.Table) -> pa.Table:
        """Of one block: its texts' shared n-grams in the global order, where there are enough of them."""
        rows = table.to_pylist()
        head = next(r for r in rows if r["head"])
        rest = [r for r in rows if not r["head"]]
        nodes, sizes = np.frombuffer(head["keys"], np.int64), np.frombuffer(head["owners"], "<u4").astype(np.int64)
        keys = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r["keys"], np.uint64) for r in rest]])
        owners = np.concatenate([np.zeros(0, np.uint32), *[restored(r["owners"], r["k"]) for r in rest]]).astype(np.int64)
        shared = np.bincount(owners, minlength=len(nodes))
        _, first = np.unique(nodes, return_index=True)  # a block's texts with one set
        passes = (shared > 0) & (100 * shared >= percent * sizes) & np.isin(np.arange(len(nodes)), first)
        keep = passes[owners]
        keys, owners = keys[keep], owners[keep]
        flat = keys[np.lexsort((keys, owners))]
        tokens = binary_column(flat.view(np.uint8), shared[passes] * 8)
        return pa.table([np.full(int(passes.sum()), head["block"]), nodes[passes], sizes[passes].astype(np.int32), tokens], [x.split()[0] for x in CANDIDATE.split(", ")])

    return make


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Head rows as a row per text."""
    for batch in batches:
        for row in batch.to_pylist():
            digests = [row["digests"][at : at + 32] for at in range(0, len(row["digests"]), 32)]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), np.frombuffer(row["keys"], np.int64), np.frombuffer(row["owners"], "<u4").astype(np.int32)], ["digest", "node", "n"])


def _postings(percent: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy().astype(np.int64)
            data, lengths = bytes_of(batch.column(2))
            keys = np.frombuffer(data.tobytes(), np.int64)
            shared = lengths // 8
            first = np.minimum(shared, shared - -(-percent * sizes // 100) + 1)
            at = np.repeat(np.cumsum(shared) - shared, first) + np.arange(first.sum()) - np.repeat(np.cumsum(first) - first, first)
            place = np.arange(first.sum()) - np.repeat(np.cumsum(first) - first, first) + np.repeat(sizes - shared, first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at]), pa.array(np.repeat(batch.column(0).to_numpy(), first)), pa.array(np.repeat(sizes, first).astype(np.int32)), pa.array(place.astype(np.int32))],
                ["token", "node", "n", "place"],
            )

    return make


def _split(bits: int):
    """Each node's n-grams by fragment of the global order, which is dealt out by hash: rows of bucket, node, tokens with the fragment."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, lengths = bytes_of(batch.column(2))
            keys = np.frombuffer(data.tobytes(), np.uint64)
            owner = np.repeat(np.arange(len(batch)), lengths // 8)
            fragment = (mixed(keys) >> np.uint64(64 - bits)).astype(np.int64)
            order = np.lexsort((keys, fragment, owner))
            keys, owner, fragment = keys[order], owner[order], fragment[order]
            starts = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (fragment[1:] != fragment[:-1]))) if len(keys) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(fragment[starts].astype(np.int32)),
                    pa.array(buckets[owner[starts]]),
                    pa.array(nodes[owner[starts]]),
                    binary_column(keys.view(np.uint8), np.diff(np.append(starts, len(keys))) * 8),
                ],
                ["fragment", "bucket", "node", "tokens"],
            )

    return make


def _overlaps(segments: pa.Table, pairs: pa.Table) -> pa.Table:
    """The partial overlap of each pair of one bucket in one fragment."""
    data, lengths = bytes_of(segments["tokens"])
    keys = np.frombuffer(data.tobytes(), np.uint64)
    ends = np.cumsum(lengths // 8)
    where = {node: (e - s, e) for node, s, e in zip(segments["node"].to_pylist(), (lengths // 8).tolist(), ends.tolist())}
    a, b, counts = pairs["a"].to_pylist(), pairs["b"].to_pylist(), np.zeros(len(pairs), np.int32)
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = where.get(x), where.get(y)
        if x and y:
            both = np.concatenate((keys[x[0] : x[1]], keys[y[0] : y[1]]))
            both.sort()
            counts[i] = np.count_nonzero(both[1:] == both[:-1])
    some = pa.array(counts > 0)
    return pa.table({"a": pairs["a"], "b": pairs["b"], "na": pairs["na"], "nb": pairs["nb"], "part": pa.array(counts)}).filter(some)


class NearSets:
    def __init__(self, docs: DataFrame, n: int = 5, percent: int = 75):
        self.percent, self.spark = percent, docs.sparkSession
        text = text_of()
        light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
        light = written(light, "near-rows")
        size, rows = light.agg(F.sum("bytes"), F.count(F.lit(1))).first()
        bits = min(MAX_BITS, max(0, int(np.ceil(np.log2(max(1, (size or 0) / FRAGMENT_TEXT))))))
        # One row of each text, by doc_id; of repeated rows one.
        per = light.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("k"))
        top = per.groupBy("digest").agg(F.max(F.struct("doc_id")).alias("top"), F.count(F.lit(1)).alias("ids"))
        more = written(per.join(top.hint("merge"), "digest").where("ids > 1 or k > 1").select("digest", "doc_id", F.struct("doc_id").eqNullSafe(F.col("top")).alias("stays"), (F.col("k") > 1).alias("once")), "near-copies")
        lone = per.join(more.select("digest", "doc_id").hint("merge"), (per["digest"] == more["digest"]) & per["doc_id"].eqNullSafe(more["doc_id"]), "left_anti").select("digest", "doc_id", F.lit(True).alias("stays"), F.lit(False).alias("once"))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
        texts = staying(texts, [F.col("digest"), F.col("doc_id")], lone.unionByName(more.withColumn("once", F.col("once") & F.col("stays"))))
        segments = texts.select("digest", "text").mapInArrow(_segments(bits, n), SEGMENT)
        shared = written(segments.groupBy("fragment").applyInArrow(_shared, SEGMENT), "near-shared")
        heads = shared.where("head").mapInArrow(_members, "digest binary, node long, n int")
        self.members = hot_join(light.select("doc_id", "digest"), heads, "digest", rows).select("doc_id", "node", "n")
        found = written(shared.groupBy("block").applyInArrow(_candidates(percent), CANDIDATE), "near-candidates")
        # Texts of different blocks with one set are one node.
        again = found.groupBy("node").agg(F.min("block").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
        verdicts = found.select("node", "block").join(again.hint("merge"), "node", "left").select("node", "block", (F.col("first").isNull() | (F.col("block") == F.col("first"))).alias("stays"))
        self.candidates = staying(found, [F.col("node"), F.col("block")], verdicts).select("node", "n", "tokens")
        self.token_bytes = found.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, na, b, nb) those that are linked. Every fragment counts partial overlaps."""
        buckets = max(1, -(-2 * self.token_bytes // (BUCKET_BYTES << CHECK_BITS)))
        pairs = pairs.withColumn("bucket", F.pmod(F.xxhash64("a", "b"), F.lit(buckets)).cast("int"))
        busy = pairs.select("bucket", F.col("a").alias("node")).union(pairs.select("bucket", "b")).distinct()
        nodes = self.candidates.select("node", "tokens").join(busy.hint("merge"), "node").select("bucket", "node", "tokens")
        segments = nodes.mapInArrow(_split(CHECK_BITS), "fragment int, bucket int, node long, tokens binary")
        dealt = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(2**CHECK_BITS - 1)))).select("fragment", "bucket", "a", "na", "b", "nb")
        parts = segments.groupBy("fragment", "bucket").cogroup(dealt.groupBy("fragment", "bucket"))
        parts = parts.applyInArrow(_overlaps, "a long, b long, na int, nb int, part int")
        whole = parts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("common"))
        return whole.where(100 * F.col("common") >= self.percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")

    def _bounded(self, x: str, y: str) -> Column:
        """Length bound, and the position bound at this n-gram, for columns with the prefixes x and y."""
        nx, ny = F.col(f"{x}n").cast("long"), F.col(f"{y}n").cast("long")
        most = 1 + F.least(nx - F.col(f"{x}place") - 1, ny - F.col(f"{y}place") - 1)
        return (100 * F.least(nx, ny) >= self.percent * F.greatest(nx, ny)) & ((100 + self.percent) * most >= self.percent * (nx + ny))

    def _pairs(self, left: DataFrame, right: DataFrame, hubs: int | None, step: int) -> DataFrame:
        """left: token, node, n, place, component; right the same with an x in front. Each pair once, the lesser node first;
        with `hubs` set, a node of left meets that many of right in this round."""
        met = left.join(right, "token").where(F.col("component") != F.col("xcomponent")).where(self._bounded("", "x"))
        if hubs:
            of_node = Window.partitionBy("node").orderBy(F.xxhash64("xnode", F.lit(step)))
            met = met.select("node", "n", "xnode", "xn").distinct().withColumn("nth", F.row_number().over(of_node)).where(F.col("nth") <= hubs)
        first = F.col("node") < F.col("xnode")
        return met.select(
            F.least("node", "xnode").alias("a"),
            F.when(first, F.col("n")).otherwise(F.col("xn")).alias("na"),
            F.greatest("node", "xnode").alias("b"),
            F.when(first, F.col("xn")).otherwise(F.col("n")).alias("nb"),
        ).distinct()

    def linked(self) -> DataFrame:
        """node, component for nodes that are linked to others."""
        postings = self.candidates.mapInArrow(_postings(self.percent), "token long, node long, n int, place int")
        common = postings.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
        postings = written(postings.join(common, "token", "left_semi"), "near-postings")
        found, tried = None, None
        row = F.struct("n", "node", "place", "component")
        for step, hubs in enumerate((*HUBS, None)):
            if found is None:
                rows = postings.withColumn("component", F.col("node"))
            else:
                rows = postings.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
                split = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
                rows = rows.join(split, "token", "left_semi")
            rows = written(rows, "near-split")
            if rows.isEmpty():
                break
            if found is None and hubs:
                right = rows.groupBy("token").agg(F.min(row).alias("hub")).select("token", "hub.*")
                left = rows
            else:
                sizes = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
                large = sizes.groupBy("token").agg(F.max(F.struct("k", "component")).alias("top")).select("token", F.col("top.component").alias("most"))
                marked = rows.join(large, "token")
                left = marked.where("component <> most").drop("most")
                right = rows
                if hubs:
                    # The first of a token's largest component by a hash that differs from round to round.
                    first = Window.partitionBy("token").orderBy(F.xxhash64("node", F.lit(step)))
                    right = marked.where("component = most").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= hubs).drop("most", "nth")
            right = right.select("token", *[F.col(c).alias(f"x{c}") for c in ("node", "n", "place", "component")])
            pairs = self._pairs(left, right, hubs, step)
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = written(pairs, "near-pairs")
            if pairs.isEmpty():
                continue
            tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
            new = written(self.verified(pairs), "near-links")
            if new.isEmpty():
                continue
            edges = new if found is None else new.union(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
            found = written(components(edges), "near-components")
        return self.spark.createDataFrame([], "node long, component long") if found is None else found


def near_components(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, node: one row per row of docs."""
    sets = NearSets(docs, n, percent)
    linked = sets.linked().select("node", F.col("component").alias("top"))
    rows = sets.members.join(linked, "node", "left").withColumn("top", F.coalesce("top", "node"))
    names = rows.where("n > 0").groupBy("top").agg(F.min("doc_id").alias("name"))
    rows = rows.join(names, "top", "left")
    name = F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), name.alias("component_id"), "node")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """docs with one row of each component: that with its smallest doc_id; rows without words stay.

    Rows go by their doc_id: where one doc_id has several rows, all of them go if one does, and else one of them stays. Texts are not
    moved (see rowfilter); other columns stay with their row."""
    found = near_components(docs, n, percent)
    leaves = (F.col("n_shingles") > 0) & ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    worded = F.count(F.when(F.col("n_shingles") > 0, 1))
    verdicts = found.groupBy("doc_id").agg((~F.max(leaves)).alias("stays"), (~F.max(leaves) & (worded > 1)).alias("once"))
    return staying(docs, [F.col("doc_id").cast("long")], verdicts)


#: DuckDB SQL for the same rows, pairing all documents that share an n-gram.
NEAR_SQL = r"""
WITH RECURSIVE ws AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM ws),
sz AS (SELECT doc_id, count(*) AS k FROM sh GROUP BY doc_id),
ov AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
lk AS (SELECT a, b FROM ov JOIN sz p ON a = p.doc_id JOIN sz q ON b = q.doc_id WHERE 100 * c >= 75 * (p.k + q.k - c)),
rc(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT lk.b, rc.r FROM rc JOIN lk ON rc.doc_id = lk.a WHERE rc.r < lk.b),
mn AS (SELECT doc_id, min(r) AS component_id FROM rc GROUP BY doc_id)
SELECT d.doc_id, coalesce(sz.k, 0)::BIGINT AS n_shingles, mn.component_id FROM documents d JOIN mn USING (doc_id) LEFT JOIN sz USING (doc_id)
"""
