"""Benchmark decontamination with SimHash fingerprints of item-sized windows, by built-in functions only.

Words are runs of letters and digits in lower case; shingles are five words (fewer in a shorter item). A window has
as many words as an item. Every window that could be similar enough to any item of its size is fingerprinted: with m
shingles against s, a weighted Jaccard similarity of t needs t (m + s) / (1 + t) shared shingles, so a window with
fewer shingles of all items of that size together cannot reach it, in whatever order its words stand. Places of such
shingles are found by an inner join on their hashes, and windows that hold enough are read off the sorted places.

Their 64-bit fingerprints (each shingle weighing as often as it occurs) meet the items' of the same size in a
multi-index: 64 bits cut into `BLOCKS` blocks, an item standing under all values of a block that differ in at most
radius div BLOCKS bits from its own. By the pigeonhole principle this finds all pairs within the radius. They are
verified by the exact weighted Jaccard similarity of their shingles. At the threshold itself two fingerprints differ
in 9.7 bits on average with a deviation of 2.9, so a radius of 19 keeps 99.9 % of such pairs, and more above it.

The benchmark is broadcast only if its rows are counted to be at most `most_broadcast`; beyond that the joins are
ordinary shuffled ones. Documents' texts stay where they are, but for those with a window to fingerprint.

Null and empty texts, and items without words, match nothing; a document shorter than an item is one window; repeated
rows are found once for each doc_id; null doc_ids are kept; empty tables give no rows; other columns are not read,
and those of `without_leaks` stay, whatever their names.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SHINGLE = 5
SIMILAR = 0.8
RADIUS = 19
BLOCKS = 5
MOST_BROADCAST = 1_000_000
#: Rows of the index for each item, at the default radius: blocks of 13 bits at most.
VARIANTS = BLOCKS * sum(math.comb(13, n) for n in range(RADIUS // BLOCKS + 1))


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]++", " ")), " ", -1)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(words: Column, width: int = SHINGLE) -> Column:
    """Hashes of the shingles of an array of word hashes; of the whole array if it is shorter; none if it is empty."""
    many = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) >= width, many).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<long>"))


def simhash(hashes: Column) -> Column:
    """The bits that more than half of the hashes have."""
    count = lambda b: F.aggregate(hashes, F.lit(0), lambda n, x: n + F.getbit(x, b).cast("int"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(2 * count(b) > F.size(hashes), 1).otherwise(0).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit))


def blocks(fp: Column, flips: int = 0) -> Column:
    """The pieces of a fingerprint, numbered; with flips, all values that differ in at most so many bits from them."""
    ends = [64 * j // BLOCKS for j in range(BLOCKS + 1)]

    def piece(j: int, a: int, b: int) -> Column:
        own = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
        masks = [sum(1 << k for k in some) for n in range(flips + 1) for some in itertools.combinations(range(b - a), n)]
        return F.transform(F.lit(masks).cast("array<long>"), lambda m: F.struct(F.lit(j).alias("block"), own.bitwiseXOR(m).alias("bits")))

    return F.flatten(F.array(*[piece(j, a, b) for j, (a, b) in enumerate(itertools.pairwise(ends))]))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of shingle hashes, each shingle weighing as often as it occurs."""
    times = lambda x, y: F.size(F.filter(x, lambda z: z == y))
    both = F.aggregate(F.transform(F.array_intersect(a, b), lambda y: F.least(times(a, y), times(b, y))), F.lit(0), lambda n, k: n + k)
    return both / (F.size(a) + F.size(b) - both)


def _maybe_broadcast(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _shingled_width(width: Column) -> Column:
    return F.greatest(width - (SHINGLE - 1), F.lit(1))


def windows(found: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, tag, start, width of every window with enough shingles of items of its width.

    found: doc_id, tag, n (words), width and the sorted places `at` of such shingles in a document. A window of m
    shingles holds `need` of them where the need-th place after one lies at most m - 1 further.
    """
    s = _shingled_width(F.col("width"))
    m = F.when(F.col("n") >= F.col("width"), s).otherwise(_shingled_width(F.col("n")))
    need = F.ceil(F.lit(similar / (1 + similar)) * (m + s) - 1e-9).cast("int")
    rows = found.withColumns({"m": m, "need": F.greatest(need, F.lit(1)), "last": F.greatest(F.col("n") - F.col("width"), F.lit(0))}).where("size(at) >= need")
    runs = F.filter(F.transform(F.sequence(F.lit(1), F.size("at") - F.col("need") + 1), lambda i: F.struct(F.element_at("at", i).alias("a"), F.element_at("at", i + F.col("need") - 1).alias("b"))), lambda r: r["b"] - r["a"] < F.col("m"))
    first = lambda r: F.least(F.greatest(r["b"] - F.col("m") + 1, F.lit(0)), F.col("last"))
    starts = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(first(r), F.greatest(first(r), F.least(r["a"], F.col("last")))))))
    return rows.select("doc_id", "tag", "width", F.explode(starts).alias("start"))


def _matches(docs: DataFrame, items: DataFrame, similar: float = SIMILAR, radius: int = RADIUS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, tag (of the text), item_id, start and similarity of each window that matches an item."""
    own = items.select("item_id", word_hashes(F.col("text")).alias("words")).where("size(words) > 0")
    own = written(own.withColumns({"width": F.size("words"), "parts": shingles(F.col("words"))}).withColumn("fp", simhash(F.col("parts"))).drop("words"), "items")
    sizes = own.agg(F.coalesce(F.sum(F.size("parts")), F.lit(0)).alias("n"), F.count("*").alias("items")).first()
    small = sizes["n"] <= most_broadcast
    places = own.select("width", F.explode("parts").alias("shingle")).distinct()
    tagged = docs.select("doc_id", "text").where("text is not null").withColumn("tag", F.xxhash64("text"))
    # short items are one shingle of all their words; their windows are found by a scan of that width
    short = [r["width"] for r in own.where(F.col("width") < SHINGLE).select("width").distinct().collect()]
    words = tagged.select("doc_id", "tag", word_hashes(F.col("text")).alias("words"))
    hits = None
    for width in [SHINGLE, *sorted(short)]:
        targets = places.where(F.col("width") >= SHINGLE) if width == SHINGLE else places.where(F.col("width") == width)
        rows = words.where(F.size("words") >= width).select("doc_id", "tag", F.size("words").alias("n"), F.posexplode(shingles(F.col("words"), width)).alias("pos", "shingle"))
        found = rows.join(_maybe_broadcast(targets, small), "shingle").select("doc_id", "tag", "n", "width", "pos")
        hits = found if hits is None else hits.union(found)
    placed = hits.groupBy("doc_id", "tag", "n", "width").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    some = written(windows(placed, similar).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "width")).alias("windows")), "windows").withColumnsRenamed({"doc_id": "id", "tag": "t"})
    placed = tagged.join(some, F.expr("doc_id <=> id and tag = t")).select("doc_id", "tag", word_hashes(F.col("text")).alias("words"), "windows").dropDuplicates(["doc_id", "tag"])
    cut = placed.select("doc_id", "tag", "words", F.explode("windows").alias("w")).select("doc_id", "tag", "w.start", "w.width", F.expr("slice(words, w.start + 1, w.width)").alias("words"))
    marked = cut.select("doc_id", "tag", "start", "width", shingles(F.col("words")).alias("parts"))
    marked = written(marked.withColumn("fp", simhash(F.col("parts"))), "marked-windows")
    index = own.select("item_id", F.col("width").alias("w"), F.col("fp").alias("item_fp"), F.explode(blocks(F.col("fp"), radius // BLOCKS)).alias("x")).select("item_id", "w", "item_fp", "x.block", "x.bits")
    probe = marked.select("doc_id", "tag", "start", "width", "fp", F.explode(blocks(F.col("fp"))).alias("x")).select("doc_id", "tag", "start", "width", "fp", "x.block", "x.bits")
    few = sizes["items"] * VARIANTS <= most_broadcast
    joined = probe.join(_maybe_broadcast(index, few), (probe["width"] == index["w"]) & (probe["block"] == index["block"]) & (probe["bits"] == index["bits"]))
    near = joined.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).groupBy("doc_id", "tag", "start", "width").agg(F.collect_set("item_id").alias("near")).withColumnsRenamed({"doc_id": "id", "tag": "t", "start": "s", "width": "wd"})
    theirs = own.select("item_id", F.col("parts").alias("item_parts"))
    pairs = marked.join(near, F.expr("doc_id <=> id and tag = t and start = s and width = wd")).select("doc_id", "tag", "start", "parts", F.explode("near").alias("item_id")).join(_maybe_broadcast(theirs, small), "item_id")
    return pairs.select("doc_id", "tag", "item_id", "start", weighted_jaccard(F.col("parts"), F.col("item_parts")).alias("similarity")).where(F.col("similarity") >= similar)


def leaks(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, n_windows (that match), start (of the best, in words) and similarity (of the best)."""
    scored = _matches(docs, items, **how)
    best = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("start")))
    return scored.groupBy("doc_id", "item_id").agg(F.countDistinct("start").alias("n_windows"), best.alias("best")).select("doc_id", "item_id", "n_windows", (-F.col("best.start")).alias("start"), "best.similarity")


def without_leaks(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """docs without those in which a benchmark item was found, told apart by id and text; rows without a text stay."""
    bad = written(_matches(docs, items, **how).select(F.col("doc_id").alias("id"), F.col("tag").alias("found")).distinct(), "leaks")
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("tag"))
    return tagged.join(bad, F.expr("doc_id <=> id and tag = found"), "left_anti").select("row.*")
