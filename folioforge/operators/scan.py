"""Blocks, neighbour pairs, the four detectors and the ordered candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.checkpoints import cut
from folioforge.functions import rules as R
from folioforge.functions import text as X
from folioforge.operators import structure

#: Blocks of a SimHash band that one task pairs with as many others.
TILE = 500


def validate(min_chars: int = 12, page_size: int = 300, max_anchors: int = R.MAX_ANCHORS, scope: str = "boundary", radius: int = R.L2_RADIUS) -> None:
    for name, value, low, high in (("min_chars", min_chars, 1, 500), ("page_size", page_size, 1, 10_000), ("max_anchors", max_anchors, 1, 10_000), ("radius", radius, 0, 1_000_000)):
        if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
            raise ValueError(f"{name} must be an integer from {low} to {high}")
    if scope not in ("boundary", "all"):
        raise ValueError("scope must be 'boundary' or 'all'")


def blocks(lines: DataFrame, min_chars: int = 12) -> DataFrame:
    """The lines that detectors look at: book_id, line_no, start_offset, end_offset, stripped, folded, key, signals, strength, kind."""
    return _blocks(structure.line_offsets(lines).where(F.length("stripped") > 0), min_chars)


def blocks_in_order(lines: DataFrame, min_chars: int = 12) -> DataFrame:
    """blocks() with `nth`: which of the book's lines that are not blank it is."""
    rows = structure.line_offsets(lines).where(F.length("stripped") > 0)
    return _blocks(rows.withColumn("nth", F.row_number().over(structure.by_book().orderBy("line_no"))), min_chars, "nth")


def _blocks(rows: DataFrame, min_chars: int, *more: str) -> DataFrame:
    rows = rows.withColumn("folded", X.match_fold(F.col("stripped")))
    is_heading = F.when(F.length("stripped") <= R.HEADING_CHARS, X.heading(F.col("stripped")).isNotNull()).otherwise(False)
    rows = structure.once(rows, is_heading=is_heading, signals=X.signals(F.col("folded")))
    size = F.length("stripped")
    letters = F.col("stripped").rlike(rf"^(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]){{{min_chars // 2}}}")
    regular = (size >= min_chars) & (size <= R.BLOCK_CHARS) & ~F.col("is_heading") & letters
    short = (size <= R.BLOCK_CHARS) & ~F.col("is_heading") & (X.any_of(F.col("signals"), R.SHORT) | X.short_site(F.col("folded")))
    long_ = (size > R.BLOCK_CHARS) & ((F.col("strength") == "strong") | X.short_site(F.col("folded")))
    kind = F.when(regular, "regular").when(short, "short_external").when(long_, "long_external")
    rows = structure.once(rows.withColumn("strength", X.strength(F.col("signals"))), kind=kind).where("kind is not null")
    rows = structure.once(rows, key=X.repetition_key(F.col("folded")))
    guard = F.when(F.col("kind") == "long_external", "long_line_mixed_content")
    return rows.select("book_id", "line_no", "start_offset", "end_offset", "stripped", "folded", "key", "signals", "strength", "kind", guard.alias("mutation_guard"), *more)


def with_slice(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows with the slice that holds their start: the last slice that begins at or before it, by a window over both."""
    marks = parts.select("book_id", F.col("slice_start").alias("__at"), F.lit(0).alias("__kind"), F.struct("slice_index", "kind", "title", "slice_start", "slice_end").alias("__slice"), F.lit(None).cast(rows.select(F.struct(*rows.columns)).schema[0].dataType).alias("__row"))
    own = rows.select("book_id", F.col("start_offset").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(marks.schema["__slice"].dataType).alias("__slice"), F.struct(*rows.columns).alias("__row"))
    order = Window.partitionBy("book_id").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(own).withColumn("__slice", F.last("__slice", ignorenulls=True).over(order)).where("__kind = 1")
    inside = F.col("__at") < F.col("__slice.slice_end")
    return both.select("__row.*", F.when(inside, F.col("__slice")).alias("slice"))


def neighbour_pairs(found: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs of signalled blocks (of blocks_in_order) one or two lines apart in one slice, with only blank lines between."""
    rows = with_slice(found.where(F.size("signals") > 0).select("book_id", "line_no", "nth", "start_offset", "stripped", "signals"), parts)
    rows = rows.withColumn("slice_index", F.coalesce("slice.slice_index", F.lit(-1))).drop("slice")
    # The next line that is not blank holds the only block that may be a neighbour.
    order = structure.by_book().orderBy("nth")
    rows = rows.withColumns({f"n_{c}": F.lead(c).over(order) for c in ("line_no", "nth", "start_offset", "stripped", "signals", "slice_index")})
    pairs = rows.withColumn("distance", (F.col("n_line_no") - F.col("line_no")).cast("int")).where((F.col("n_nth") == F.col("nth") + 1) & (F.col("distance") <= 2))
    return pairs.where((F.col("slice_index") == F.col("n_slice_index")) & (X.any_of(F.col("signals"), R.NEIGHBOR) | X.any_of(F.col("n_signals"), R.NEIGHBOR))).drop("nth", "n_nth")


def neighbour_spans(pairs: DataFrame) -> DataFrame:
    """Each pair from both sides."""
    def side(a: str, b: str, direction: str) -> DataFrame:
        return pairs.select("book_id", F.col(f"{a}start_offset").alias("source_offset"), F.col(f"{a}line_no").alias("source_line"), F.col(f"{b}start_offset").alias("neighbor_offset"), F.col(f"{b}line_no").alias("neighbor_line"), F.lit(direction).alias("direction"), F.col("distance").alias("line_distance"), F.col(f"{b}stripped").alias("original"), F.col(f"{b}signals").alias("signals"))

    return side("", "n_", "after").unionByName(side("n_", "", "before"))


def boundary_distance(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows with `boundary_distance`: how far the nearest slice start or end is, by two windows over rows and boundaries."""
    ends = parts.select("book_id", F.explode(F.array("slice_start", "slice_end")).alias("__at")).distinct()
    kind = rows.select(F.struct(*rows.columns)).schema[0].dataType
    both = ends.select("book_id", "__at", F.col("__at").alias("__edge"), F.lit(None).cast(kind).alias("__row")).unionByName(rows.select("book_id", F.col("start_offset").alias("__at"), F.lit(None).cast("long").alias("__edge"), F.struct(*rows.columns).alias("__row")))
    order = Window.partitionBy("book_id").orderBy("__at")
    low = F.max("__edge").over(order.rangeBetween(Window.unboundedPreceding, 0))
    high = F.min("__edge").over(order.rangeBetween(0, Window.unboundedFollowing))
    far = F.least(F.col("__at") - low, high - F.col("__at"))
    return both.withColumn("__far", far).where("__row is not null").select("__row.*", F.col("__far").cast("long").alias("boundary_distance"))


def exact_groups(found: DataFrame) -> DataFrame:
    """book_id, key of the blocks that recur at least three times, with all of them (members: start_offset, end_offset, line_no) in order."""
    member = F.struct("start_offset", "end_offset", "line_no")
    rows = found.groupBy("book_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min("start_offset").alias("first_start"), F.collect_list(member).alias("members"))
    return rows.where("n >= 3").withColumn("members", F.array_sort("members"))


def with_repeats(found: DataFrame) -> DataFrame:
    """found with `repeats`: how many blocks of the book have the key."""
    return found.withColumn("repeats", F.count(F.lit(1)).over(Window.partitionBy("book_id", "key")))


def _tiled(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on `by`, __t and __u in which each two rows of a group of `by` meet once: in the order of their tiles, or, within a
    tile, both ways round. A group is dealt into tiles of about TILE rows, so that a large one is paired by many tasks."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__k")).where("__k >= 2")
    tiles = F.ceil(F.col("__k") / TILE).cast("int")
    rows = rows.join(sizes, by).withColumn("__n", tiles).withColumn("__own", F.pmod(F.xxhash64("start_offset"), F.col("__n")).cast("int"))
    left = rows.withColumn("__t", F.col("__own")).withColumn("__u", F.explode(F.sequence("__own", F.col("__n") - 1)))
    right = rows.withColumn("__u", F.col("__own")).withColumn("__t", F.explode(F.sequence(F.lit(0), F.col("__own"))))
    return left.drop("__k", "__n", "__own"), right.drop("__k", "__n", "__own")


def near_pairs(selected: DataFrame) -> DataFrame:
    """The links among blocks: book_id, start_offset, o_start_offset, link. The first block of a key stands for all that have it: 'copy' links it
    to each of the others, and 'near' links two such blocks that share a 16-bit SimHash band and are alike, however many share the band. Only
    hashes, sizes and marks of grams are paired; keys are fetched for the pairs that their hashes do not link and whose marks may."""
    rows = cut(selected.select("book_id", "start_offset", "key"))
    first = rows.groupBy("book_id", "key").agg(F.min("start_offset").alias("start_offset"))
    copies = rows.select("book_id", "key", F.col("start_offset").alias("o_start_offset")).join(first, ["book_id", "key"]).where("start_offset < o_start_offset")
    first = cut(first.withColumn("s", X.simhash_of(F.col("key"))).select("book_id", "start_offset", "key", "s.*"))
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.shiftrightunsigned("sim", 16 * b).bitwiseAND(F.lit(0xFFFF)).alias("value")) for b in range(4)])
    dealt = first.select("book_id", "start_offset", "sim", "n", "marks", F.explode(bands).alias("b")).select("book_id", "b.*", "start_offset", "sim", "n", "marks")
    left, right = _tiled(dealt, ["book_id", "band", "value"])
    other = right.withColumnsRenamed({c: f"o_{c}" for c in ("start_offset", "sim", "n", "marks")})
    pairs = left.join(other, ["book_id", "band", "value", "__t", "__u"]).where((F.col("__t") < F.col("__u")) | (F.col("start_offset") < F.col("o_start_offset")))
    # Two blocks that share more than one band are a pair of the first.
    apart = F.col("sim").bitwiseXOR(F.col("o_sim"))
    shared = F.coalesce(*[F.when(F.shiftrightunsigned(apart, 16 * b).bitwiseAND(F.lit(0xFFFF)) == 0, b) for b in range(4)])
    alike = X.hamming(F.col("sim"), F.col("o_sim")) <= R.SIMHASH_DISTANCE
    # No similarity is above the share of the smaller set in the larger one, nor above what the grams that only one of them marks leave.
    may = F.least("n", "o_n") / F.greatest("n", "o_n") > R.NEAR_JACCARD
    differ = sum((X.hamming(F.col("marks")[i], F.col("o_marks")[i]) for i in range(1, X.MARKS)), X.hamming(F.col("marks")[0], F.col("o_marks")[0]))
    may &= differ <= (F.col("n") + F.col("o_n")) * ((1 - R.NEAR_JACCARD) / (1 + R.NEAR_JACCARD)) + 1e-6
    pairs = pairs.where((F.col("band") == shared) & (alike | may))
    pairs = cut(pairs.select("book_id", F.least("start_offset", "o_start_offset").alias("start_offset"), F.greatest("start_offset", "o_start_offset").alias("o_start_offset"), alike.alias("alike")))
    key = first.select("book_id", "start_offset", "key")
    # A band's pairs lie together; they are dealt anew, so that a large one is compared by many tasks.
    asked = pairs.where("not alike").repartition("book_id", "start_offset", "o_start_offset").join(key, ["book_id", "start_offset"]).join(key.toDF("book_id", "o_start_offset", "o_key"), ["book_id", "o_start_offset"])
    near = asked.where(X.gram_jaccard(F.col("key"), F.col("o_key")) > R.NEAR_JACCARD)
    linked = lambda found, link: found.select("book_id", "start_offset", "o_start_offset", F.lit(link).alias("link"))
    return linked(copies, "copy").unionByName(linked(pairs.where("alike"), "near")).unionByName(linked(near, "near"))


def components(pairs: DataFrame) -> DataFrame:
    """book_id, start_offset, root: the least start that links reach. Labels spread along links and are shortened until none changes."""
    both = cut(pairs.select("book_id", F.col("start_offset").alias("a"), F.col("o_start_offset").alias("b")))
    both = both.union(both.select("book_id", "b", "a"))
    labels = both.groupBy("book_id", F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root"))
    labels = cut(labels)
    while True:
        far = both.join(labels.select("book_id", F.col("node").alias("b"), "root"), ["book_id", "b"]).groupBy("book_id", F.col("a").alias("node")).agg(F.min("root").alias("near"))
        new = labels.join(far, ["book_id", "node"]).select("book_id", "node", F.least("root", "near").alias("root"))
        jump = new.select("book_id", F.col("node").alias("root"), F.col("root").alias("next"))
        new = cut(new.join(jump, ["book_id", "root"], "left").select("book_id", "node", F.coalesce("next", "root").alias("root")))
        if new.join(labels.withColumnRenamed("root", "old"), ["book_id", "node"]).where("root <> old").isEmpty():
            return new.withColumnRenamed("node", "start_offset")
        labels = new


def near_groups(found: DataFrame, parts: DataFrame, scope: str = "boundary", radius: int = R.L2_RADIUS) -> DataFrame:
    """book_id, start_offset, root of near repetitions of at least three among the blocks not yet taken."""
    rows = found.where(F.length("key").between(*R.NEAR_KEY))
    if scope == "boundary":
        pieces = parts.where("kind = 'fallback_chunk'").select("book_id").distinct().withColumn("__cut", F.lit(True))
        rows = boundary_distance(rows, parts).join(pieces, "book_id", "left")
        rows = rows.where(F.col("__cut").isNotNull() | (F.size("signals") > 0) | (F.col("boundary_distance") <= radius)).drop("__cut")
    linked = components(near_pairs(rows))
    big = linked.groupBy("book_id", "root").agg(F.count(F.lit(1)).alias("k")).where("k >= 3").select("book_id", "root")
    return linked.join(big, ["book_id", "root"])


def structural(found: DataFrame, parts: DataFrame, radius: int = R.L4_RADIUS) -> DataFrame:
    """Short signalled blocks near a slice's edge; none in books that are cut into pieces."""
    pieces = parts.where("kind = 'fallback_chunk'").select("book_id")
    found = found.join(pieces, "book_id", "left_anti")
    return boundary_distance(found.where((F.size("signals") > 0) & (F.length("stripped") <= R.L4_CHARS)), parts).where(F.col("boundary_distance") <= radius)


def cascade(lines: DataFrame, min_chars: int = 12, scope: str = "boundary", radius: int = R.L2_RADIUS) -> DataFrame:
    """Every block that a detector took, with layer and group: exact repetition, near repetition, pattern, structure, in this order."""
    validate(min_chars=min_chars, scope=scope, radius=radius)
    found, parts = cut(with_repeats(blocks(lines, min_chars).drop("folded"))), cut(structure.slices(lines))
    l1 = found.where("repeats >= 3").withColumn("layer", F.lit("L1")).withColumn("group", F.col("key"))
    rest = found.where("repeats < 3")
    near = near_groups(rest, parts, scope, radius)
    rest = rest.join(near, ["book_id", "start_offset"], "left")
    l2 = rest.where("root is not null").withColumn("layer", F.lit("L2")).withColumn("group", F.col("root").cast("string"))
    rest = rest.where("root is null")
    named = F.concat(F.when(F.col("strength") == "strong", "strong:").otherwise("weak:"), X.stable_hash(F.col("key")))
    l3 = rest.where(F.size("signals") > 0).withColumn("layer", F.lit("L3")).withColumn("group", named)
    l4 = structural(rest.where(F.size("signals") == 0), parts).withColumn("layer", F.lit("L4")).withColumn("group", F.col("start_offset").cast("string")).drop("boundary_distance")
    return l1.withColumn("root", F.lit(None).cast("long")).unionByName(l2).unionByName(l3).unionByName(l4).drop("repeats", "root")


def candidates(taken: DataFrame, max_anchors: int | None = R.MAX_ANCHORS) -> DataFrame:
    """One row per group, ranked: counts, the first max_anchors anchors (None: all), sorted signals, strength, guard, priority, risk, id."""
    anchor = F.struct("start_offset", "end_offset", "line_no", F.col("stripped").alias("original"))
    rows = taken.groupBy("book_id", "layer", "group").agg(
        F.count(F.lit(1)).alias("occurrence_count"),
        F.array_sort(F.collect_list(anchor)).alias("anchors"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("signals")))).alias("signals"),
        F.min("mutation_guard").alias("mutation_guard"),
    )
    strong = X.any_of(F.col("signals"), R.STRONG)
    rows = rows.withColumn("strength", X.strength(F.col("signals"))).withColumn("sample", F.col("anchors")[0]["original"]).withColumn("first_start", F.col("anchors")[0]["start_offset"])
    rows = rows.withColumn("priority", F.when(F.col("layer") == "L4", "low").when(strong, "high").otherwise("medium"))
    rows = rows.withColumn("risk", F.when(F.col("mutation_guard").isNotNull(), "high").when(F.col("layer") == "L4", "medium").when(strong, "low").otherwise("medium"))
    bucket = F.when((F.col("layer") == "L1") & (F.col("strength") == "strong"), "l1_strong").when(F.col("layer") == "L1", "l1_weak").otherwise(F.lower("layer"))
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy(*order_key()))
    return (
        rows.withColumn("quota_bucket", bucket)
        .withColumn("rank", rank.cast("long"))
        .withColumn("candidate_id", F.concat(F.lit("AD-"), F.lpad(F.col("rank").cast("string"), 4, "0")))
        .withColumn("anchors_truncated", F.lit(False) if max_anchors is None else F.size("anchors") > max_anchors)
        .withColumn("anchors", F.col("anchors") if max_anchors is None else F.slice("anchors", 1, max_anchors))
    )


def _place(column: str, names: tuple[str, ...]) -> Column:
    out = F.lit(9)
    for i, name in enumerate(names):
        out = F.when(F.col(column) == name, i).otherwise(out)
    return out


def order_key() -> list[Column]:
    return [_place("strength", ("strong", "weak", "none")), _place("priority", ("high", "medium", "low")), _place("risk", ("low", "medium", "high")), _place("layer", ("L3", "L1", "L2", "L4")), -F.col("occurrence_count"), F.col("sample"), F.col("first_start")]


def pages(found: DataFrame, page_size: int = 300) -> DataFrame:
    """Per page: records and a hash over them in order."""
    rows = found.withColumn("page", F.floor((F.col("rank") - 1) / page_size) + 1)
    listed = F.array_sort(F.collect_list(F.struct("rank", "candidate_id", "sample")))
    text = F.array_join(F.transform(listed, lambda r: F.concat_ws("|", r["candidate_id"], r["sample"])), "\n")
    return rows.groupBy("book_id", "page").agg(F.count(F.lit(1)).alias("record_count"), F.sha2(text, 256).alias("page_sha256"))


def page_integrity(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Declared against actual pages, as a full outer join: missing, extra, changed or ok."""
    a = actual.select("book_id", "page", F.col("record_count").alias("n"), F.col("page_sha256").alias("h"))
    rows = declared.join(a, ["book_id", "page"], "full_outer")
    state = F.when(F.col("h").isNull(), "missing").when(F.col("page_sha256").isNull(), "extra").when((F.col("h") != F.col("page_sha256")) | (F.col("n") != F.col("record_count")), "changed").otherwise("ok")
    return rows.select("book_id", "page", state.alias("state"))
