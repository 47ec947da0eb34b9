"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with built-in functions only.

Texts are cut into blocks of `block_words` words. A source's quota is the number of blocks, in an order
permuted by a keyed hash, whose words come nearest its target: whole passes over the source, then a part of
a further pass. A tree splits the quotas among the output shards: at each node the blocks of the left half
are a draw without replacement from the node's blocks, so the counts by source are multivariate
hypergeometric and sum exactly to the quotas. Shards then own disjoint runs of the permuted order, each given
by the position of its last block, and are shuffled within themselves by a second key.

Because a run is an interval of hash positions, a document finds out which of its blocks are drawn, and into
which shard, from its own key and its source's list of ends: texts are not shuffled for that, and a hot
source is spread over 4,096 ranges of the key when its order is worked out. What comes to the driver is a
few numbers for each source and shard. That is the mix's own configuration, so sources may be at most
`MOST_SOURCES` (more is an error, never a part of them), and the plan is broadcast only up to `MOST_BROADCAST`
numbers.

A block's key is hashed from the document's id, its text's hash, its number among rows with the same id,
text and source, and the block's number. So null and repeated ids share no keys, and of exact copies some may be drawn and
others not. Only rows that have such a copy are shuffled for their numbers, dealt by the part of the input they
lie in, so that copies are never gathered in one task.

Null texts have size 0, which no pass takes; null sources are one source, last in order; an empty table gives
an empty mix; all columns pass through `mix`, whatever their names, and are ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, WORD_GAP, keyed, written

BLOCK_WORDS = 256
SHARDS = 16
SEED = "mix"
MOST = 3
KEY_BITS, RANGE_BITS = 60, 12
#: Sources that a mix may name, and numbers of the plan (one for each source and shard) that are broadcast.
MOST_SOURCES, MOST_BROADCAST = 100_000, 400_000


def targets(sizes: dict, weights: dict, most: int = MOST) -> dict:
    """Target of each source: its weight's share of all sizes, at most `most` times its size, the rest reshared."""
    left, capped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in sizes if s not in capped]
        total = sum(weights[s] for s in free)
        share = {s: left * weights[s] / total for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return capped | share
        for s in above:
            capped[s] = float(most * sizes[s])
        left = float(sum(sizes.values())) - sum(capped.values())


def repeating_weights(sources: list) -> dict:
    """1, 2, 3, repeating, over the sources by code point with null last."""
    return {s: i % 3 + 1 for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


def hypergeometric(good: int, bad: int, draws: int, u: float) -> int:
    """The number of good ones among `draws` of good + bad, by inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low

    def pmf(k: int) -> float:
        c = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
        return math.exp(c(good, k) + c(bad, draws - k) - c(good + bad, draws))

    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    down, up, p_down, p_up = mode, mode, pmf(mode), pmf(mode)
    u -= p_up
    while u > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up < 1e-18 and p_down < 1e-18:
            break
    return mode


def split_tree(quotas: dict, shards: int, seed: str = SEED) -> list[dict]:
    """The quotas of each shard: the node's blocks are halved by drawing the left half without replacement."""

    def uniform(*key) -> float:
        return (int.from_bytes(hashlib.md5("|".join(map(str, (seed, *key))).encode()).digest()[:7], "big") + 0.5) / 2**56

    def node(part: dict, first: int, last: int) -> list[dict]:
        if last - first == 1:
            return [part]
        middle, total = (first + last) // 2, sum(part.values())
        draws = total * (middle - first) // (last - first)
        left, rest, need = {}, total, draws
        for s, n in part.items():
            left[s] = hypergeometric(n, rest - n, need, uniform(first, last, s))
            rest, need = rest - n, need - left[s]
        return node(left, first, middle) + node({s: n - left[s] for s, n in part.items()}, middle, last)

    return node(quotas, 0, shards)


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD + "+")), F.lit(0)).cast("long")


def _key(block: Column) -> Column:
    return keyed(SEED, F.col("doc_id"), F.col("tag"), F.col("nth"), block)


def _numbered(rows: DataFrame, keep: bool = False) -> DataFrame:
    """rows (with doc_id, tag, source) and `nth`: 0, 1, ... among the rows with the same three, in any order.

    Copies are written with the part of the input they are in, so that all that reads the part sees the same one. They
    are numbered within it, and the parts' counts give each part its first number.
    keep: write the result, if there are copies at all.
    """
    by = ["doc_id", "tag", "source"]
    same = lambda a, b: F.expr(" AND ".join(f"{a}.{c} <=> {b}.{c}" for c in by))
    several = written(rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by), "mix-copies")
    if several.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = written(rows.alias("r").join(several.alias("s"), same("r", "s"), "left_semi").withColumn("part", F.spark_partition_id()), "mix-placed")
    counts = placed.groupBy(*by, "part").agg(F.count("*").alias("n"))
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = placed.withColumn("own", F.row_number().over(Window.partitionBy(*by, "part").orderBy("tag")))
    copies = own.alias("o").join(first.alias("f"), same("o", "f") & F.expr("o.part = f.part")).select(*[F.col(f"o.{c}").alias(c) for c in rows.columns], (F.col("first") + F.col("own") - 1).cast("long").alias("nth"))
    alone = rows.alias("r").join(several.alias("s"), same("r", "s"), "left_anti").select(*rows.columns, F.lit(0).cast("long").alias("nth"))
    every = alone.unionByName(copies)
    return written(every, "mix-numbered") if keep else every


def _blocks(sizes: DataFrame, block_words: int) -> DataFrame:
    """A row for each block: source, words, key and the key's range."""
    some = sizes.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(0L, (size - 1) div {block_words})")))
    cut = some.select("source", "doc_id", "tag", "nth", "size", "block", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words).alias("words"), _key(F.col("block")).alias("key"))
    return cut.withColumn("range", F.shiftright("key", KEY_BITS - RANGE_BITS).cast("int"))


def plan(sizes: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, weights: dict | None = None) -> DataFrame:
    """source, source_size, target, ends: for each shard, the last position (pass and key) of its run.

    sizes has doc_id, tag, nth, source and size and is read a few times, so it should be a written table.
    """
    spark = sizes.sparkSession
    if sizes.select("source").distinct().limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"a mix is planned over at most {MOST_SOURCES} sources")
    blocks = _blocks(sizes, block_words)
    by_source = {r["source"]: (r["size"], r["n"]) for r in sizes.groupBy("source").agg(F.sum("size").alias("size"), F.sum(F.expr(f"(size + {block_words - 1}) div {block_words}")).alias("n")).collect()}
    # in a fixed order, as the tree draws for one source after the other
    size = {s: by_source[s][0] for s in sorted(by_source, key=lambda s: (s is None, s or ""))}
    want = targets(size, weights or repeating_weights(list(size))) if sum(size.values()) else dict.fromkeys(size, 0.0)
    passes = {s: min(MOST, int(want[s] // size[s])) if size[s] else 0 for s in size}
    rest = [(s, float(want[s] - passes[s] * size[s])) for s in size]
    so_far = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.groupBy("source", "range").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    ranges = written(ranges.withColumns({"n0": F.coalesce(F.sum("n").over(so_far), F.lit(0)), "w0": F.coalesce(F.sum("w").over(so_far), F.lit(0))}), "mix-ranges")
    in_range = Window.partitionBy("source", "range").orderBy("key", "doc_id", "tag", "nth", "block")

    def near(wanted: DataFrame) -> DataFrame:
        """The blocks of the ranges that are wanted, numbered and summed within their range."""
        some = blocks.alias("b").join(wanted.alias("r"), F.expr("b.source <=> r.source and b.range = r.range"))
        some = some.select("b.*", *[f"r.{c}" for c in wanted.columns if c not in ("source", "range")])
        return some.withColumns({"nth": F.row_number().over(in_range), "sum": F.sum("words").over(in_range.rowsBetween(Window.unboundedPreceding, 0))})

    need = spark.createDataFrame(rest, "source string, need double")
    cut = ranges.alias("a").join(need.alias("n"), F.expr("a.source <=> n.source and a.w0 <= n.need and n.need < a.w0 + a.w")).select("a.*", "need")
    part = near(cut.select("source", "range", "n0", "w0", "need")).where("w0 + sum - words / 2 <= need").groupBy("source").agg(F.max(F.col("n0") + F.col("nth")).alias("k"))
    floor = {r["source"]: r["n0"] for r in cut.select("source", "n0").collect()} | {r["source"]: r["k"] for r in part.collect()}
    quota = {s: passes[s] * by_source[s][1] + (floor.get(s, 0) if passes[s] < MOST else 0) for s in size}
    ends, at = [], dict.fromkeys(size, 0)
    for i, own in enumerate(split_tree(quota, shards)):
        for s, n in own.items():
            at[s] += n
            if at[s]:
                ends.append((s, i, (at[s] - 1) // by_source[s][1], (at[s] - 1) % by_source[s][1] + 1))
    asked = spark.createDataFrame(ends, "source string, shard int, pass int, rank long")
    found = ranges.alias("a").join(asked.alias("e"), F.expr("a.source <=> e.source and a.n0 < e.rank and e.rank <= a.n0 + a.n")).select("a.*", "shard", "pass", (F.col("rank") - F.col("n0")).alias("rank"))
    lists = found.groupBy("source", "range").agg(F.collect_list(F.struct("shard", "pass", "rank")).alias("asked"))
    keys = near(lists).select("source", "key", F.explode(F.expr("filter(asked, x -> x.rank = nth)")).alias("x")).select("source", "x.shard", "x.pass", "key")
    last = {(r["source"], r["shard"]): (r["pass"] << KEY_BITS) + r["key"] for r in keys.collect()}
    rows = [(s, int(size[s]), float(want[s]), [last.get((s, i), -1) for i in range(shards)]) for s in size]
    return spark.createDataFrame(rows, "source string, source_size long, target double, ends array<long>")


def _planned(docs: DataFrame, planned: DataFrame, block_words: int, shards: int) -> DataFrame:
    """docs with their source's plan and `drawn`: pass, block, shard and order of each of their draws."""
    small = planned.count() * shards <= MOST_BROADCAST
    joined = docs.alias("d").join((F.broadcast(planned) if small else planned).alias("p"), F.expr("d.source <=> p.source")).select("d.*", "source_size", "target", "ends")
    keys = F.when(F.col("size") > 0, F.expr(f"sequence(0L, (size - 1) div {block_words})")).otherwise(F.array().cast("array<long>"))
    listed = joined.withColumn("keys", F.transform(keys, lambda b: F.struct(b.alias("block"), _key(b).alias("key"))))
    drawn = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(MOST - 1)), lambda p: F.transform(F.filter("keys", lambda k: F.shiftleft(p.cast("long"), KEY_BITS) + k["key"] <= F.element_at("ends", -1)), lambda k: F.struct(p.alias("pass"), k["block"].alias("block"), (F.shiftleft(p.cast("long"), KEY_BITS) + k["key"]).alias("at")))))
    return listed.withColumn("drawn", drawn).drop("keys")


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, tag (of the text), nth, source and size of each row, as a written table."""
    rows = written(docs.select("doc_id", F.xxhash64("text").alias("tag"), "source", _size(F.col("text")).alias("size")), "mix-sizes")
    return _numbered(rows, keep=True)


def mix_report(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, weights: dict | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken and n_shards of every document."""
    sizes = sizes_of(docs)
    mixed = _planned(sizes, plan(sizes, block_words, shards, weights), block_words, shards)
    words = lambda x: F.least(F.lit(block_words).cast("long"), F.col("size") - x["block"] * block_words)
    shard = lambda x: F.size(F.filter("ends", lambda e: e < x["at"]))
    return mixed.select("doc_id", "size", "source_size", "target", F.aggregate(F.transform("drawn", words), F.lit(0).cast("long"), lambda a, b: a + b).alias("taken"), F.size(F.array_distinct(F.transform("drawn", shard))).alias("n_shards"))


def block_texts(text: Column, block_words: int) -> Column:
    """A text cut into blocks of words, with the white space that follows each word (or leads the text)."""
    return F.regexp_extract_all(text, F.lit(f"(?:\\A{WORD_GAP}+)?(?:{WORD}+(?:{WORD_GAP}+)?){{1,{block_words}}}+"), 0)


def _drawn_rows(docs: DataFrame, block_words: int, shards: int, weights: dict | None) -> DataFrame:
    """row (all columns of docs), doc_id, source, text, size, source_size, target, ends and drawn."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("tag"), "source", "text", _size(F.col("text")).alias("size"))
    return _planned(_numbered(rows), plan(sizes_of(docs), block_words, shards, weights), block_words, shards)


def mixed_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, weights: dict | None = None) -> DataFrame:
    """The mix itself: shard, order, doc_id, source, block and text of each draw, shuffled within its shard.

    Rows are dealt by shard and a range of the order, so that no task need hold a shard.
    """
    mixed = _drawn_rows(docs.select("doc_id", "source", "text"), block_words, shards, weights)
    rows = mixed.withColumn("pieces", block_texts(F.col("text"), block_words)).select("doc_id", "tag", "nth", "source", "ends", "pieces", F.explode("drawn").alias("x"))
    rows = rows.select(F.size(F.filter("ends", lambda e: e < F.col("x.at"))).alias("shard"), keyed(SEED + "-order", F.col("doc_id"), F.col("tag"), F.col("nth"), F.col("x.at")).alias("order"), "doc_id", "source", F.col("x.block").alias("block"), F.expr("pieces[int(x.block)]").alias("text"))
    return rows.repartition("shard", F.shiftright("order", KEY_BITS - 6)).sortWithinPartitions("shard", "order")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, weights: dict | None = None) -> DataFrame:
    """The mix as documents: a row for each pass that takes any of a document, its text cut to the blocks drawn.

    A whole pass keeps the text as it is. All columns of docs stay; only texts that have an exact copy are shuffled.
    """
    rows = _drawn_rows(docs, block_words, shards, weights).withColumn("pass", F.explode(F.array_distinct(F.col("drawn.pass"))))
    own = F.filter("drawn", lambda x: x["pass"] == F.col("pass"))
    whole = F.size(own) == F.expr(f"(size + {block_words - 1}) div {block_words}")
    pieces = block_texts(F.col("text"), block_words)
    some = F.array_join(F.transform(F.array_sort(F.transform(own, lambda x: x["block"])), lambda b: F.element_at(pieces, (b + 1).cast("int"))), "")
    text = F.when(whole, F.col("text")).otherwise(some)
    return rows.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
