"""SimHash near-duplicates by deletion-variant signatures.

A document's 64-bit fingerprint has a bit where over half of its 3-word shingles' XXH64 values have it.
Fingerprints that differ in at most 3 bits have one of their two 32-bit segments differing in at most one
bit, so that segment's variant with that one bit as a wildcard is equal in both. The 64 variants of each
different fingerprint are dealt by variant, and within a variant pairs are verified by counting bits. Links
become components, and a component is named by its smallest doc_id.

Equal fingerprints are one before any of this, so copies cost nothing. In a variant, only pairs that differ
in the wildcard bit are compared, or (in the first variant of a segment) those with the same segment; a
variant gives at most one link for each member, never all pairs. One with too many pairs to compare, or too many
members to hold, is split by the same rule once more: of the two 16-bit halves of the other segment one differs in
at most one bit, so members meet in the one-wildcard variants of its halves. Such a part has at most 2^18 different
fingerprints (two values of the first wildcard, two of the second, 2^16 of the other half), so it is held whole.

Null and word-less texts have fingerprint zero, linked like any other; repeated rows are in one component;
null ids are never a component's name unless all its ids are null; an empty table gives no rows; other
columns are not read by `near_duplicates`.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written
from .components import components

RADIUS = 3
SEED = 42
SHINGLE = 3
#: Comparisons of one variant that are made at once; a larger variant is split first.
MOST_PAIRS = 1 << 24
#: Rows of one variant that a task holds (8 bytes each); the rest of a larger variant is passed on.
MOST_HELD = 1 << 21


def fingerprint(text: str | None) -> int:
    """Of one text: lower-case A-Z, words between ASCII white space, shingles joined by a space."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, ends = b" ".join(words), list(itertools.accumulate(len(w) + 1 for w in words))
    hashed, seed = xxhash.xxh64_intdigest, SEED
    h = np.array([hashed(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[SHINGLE - 1 :], strict=False)], "<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and `fp`, the fingerprint as a signed 64-bit number."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(*keep, *([] if text_col in keep else [text_col]))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def apply(batches):
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column(text_col).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp)], [*keep, "fp"])

    return docs.mapInArrow(apply, f"{kinds}, fp long")


class _Forest:
    """Labels of a variant's members; a link is reported only if it joins two labels."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.label = fps, np.arange(len(fps))

    def link(self, i: int, others: np.ndarray):
        roots, first = np.unique(self.label[others], return_index=True)
        new = roots != self.label[i]
        if new.any():
            yield from zip(itertools.repeat(int(self.fps[i])), self.fps[others[first[new]]].tolist())
            self.label[np.isin(self.label, roots)] = self.label[i]


def links_within(fps: np.ndarray, wildcard: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join the members of one variant, found by comparing them block by block.

    wildcard: bit 0 to 63. Members with the same segment are compared only for the segment's bit 0.
    """
    bit = (fps >> np.uint64(wildcard)) & np.uint64(1)
    zero, one = np.flatnonzero(bit == 0), np.flatnonzero(bit == 1)
    sides = [(zero, one)] if wildcard % 32 else [(zero, one), (zero, zero), (one, one)]
    forest, out = _Forest(fps), []
    for left, right in sides:
        step = max(1, (1 << 20) // max(1, len(right)))
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            near = np.bitwise_count(fps[rows][:, None] ^ fps[right][None, :]) <= radius
            for k in np.flatnonzero(near.any(axis=1)):
                others = right[near[k]]
                others = others[others > rows[k]] if left is right else others
                if len(others):
                    out += forest.link(int(rows[k]), others)
    return out


def _pairs(fps: np.ndarray, wildcard: int) -> int:
    ones = int(((fps >> np.uint64(wildcard)) & np.uint64(1)).sum())
    return (len(fps) ** 2 // 2) if wildcard % 32 == 0 else ones * (len(fps) - ones)


def _group_links(last: bool):
    """Arrow batches sorted by (variant, wildcard) to rows a, b: links, or with last False members to split (b null)."""

    def apply(batches):
        held_key, held, spilled = None, [], False

        def finish():
            fps = np.unique(np.concatenate(held).view(np.uint64)) if held else np.empty(0, np.uint64)
            if spilled:  # the rest, however little, is compared with what was passed on
                return [], fps
            if len(fps) < 2 or not _pairs(fps, held_key[1]):
                return [], []
            if not last and _pairs(fps, held_key[1]) > MOST_PAIRS:
                return [], fps
            return links_within(fps, held_key[1]), []

        def rows(links, heavy, key):
            a = np.array([x for x, _ in links], np.uint64)
            b = np.array([x for _, x in links], np.uint64)
            whole = np.concatenate((a, np.asarray(heavy, np.uint64))).view(np.int64)
            missing = np.arange(len(whole)) >= len(a)
            other = np.concatenate((b, np.zeros(len(heavy), np.uint64))).view(np.int64)
            return pa.RecordBatch.from_pydict({"a": pa.array(whole), "b": pa.array(other, mask=missing), "variant": pa.array([key[0]] * len(whole), pa.int64()), "wildcard": pa.array([key[1]] * len(whole), pa.int32())})

        for batch in batches:
            key, wild, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("variant", "wildcard", "fp"))
            cut = np.flatnonzero((key[1:] != key[:-1]) | (wild[1:] != wild[:-1])) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
            lone = ends - starts == 1
            lone[[0, -1]] = False  # these may go on in the batches before and after
            for s, e in zip(starts[~lone], ends[~lone], strict=True):
                own = (int(key[s]), int(wild[s]))
                if own != held_key:
                    if held and (sum(map(len, held)) > 1 or spilled):
                        links, heavy = finish()
                        if len(links) or len(heavy):
                            yield rows(links, heavy, held_key)
                    held_key, held, spilled = own, [], False
                held.append(fp[s:e])
                if not last and sum(map(len, held)) > MOST_HELD:
                    yield rows([], np.concatenate(held).view(np.uint64), own)
                    held, spilled = [], True
        if held and (sum(map(len, held)) > 1 or spilled):
            links, heavy = finish()
            if len(links) or len(heavy):
                yield rows(links, heavy, held_key)

    return apply


def links(fps: DataFrame) -> DataFrame:
    """Links a, b between the different fingerprints of column fp, enough to join all that a chain of links joins."""
    found = "a long, b long, variant long, wildcard int"
    segment = lambda i: F.shiftrightunsigned("fp", 32 * (i >= 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    variants = F.array(*[F.struct((F.lit(i).cast("long") * (1 << 32) + segment(i).bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i % 32)))).alias("variant"), F.lit(i).alias("wildcard")) for i in range(64)])
    dealt = fps.select("fp", F.explode(variants).alias("x")).select("fp", "x.variant", "x.wildcard")
    first = written(dealt.repartition("variant").sortWithinPartitions("variant").mapInArrow(_group_links(False), found), "links")
    heavy = first.where("b is null").select(F.col("a").alias("fp"), "variant", "wildcard")
    other = F.when(F.col("wildcard") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
    half = lambda i: F.shiftrightunsigned("other", 16 * (i >= 16)).bitwiseAND(F.lit(0xFFFF ^ (1 << i % 16)))
    parts = F.array(*[F.xxhash64("variant", F.lit(i), half(i)) for i in range(32)])
    split = heavy.withColumn("other", other).select("fp", "wildcard", F.explode(parts).alias("variant"))
    second = split.repartition("variant").sortWithinPartitions("variant", "wildcard").mapInArrow(_group_links(True), found)
    return first.where("b is not null").select("a", "b").union(second.select("a", "b"))


def fingerprint_components(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """fp, component_id for each different fingerprint of marked (id_col, fp), which is best a written table."""
    one = written(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "fps")
    roots = components(links(one.select("fp")))
    named = one.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(names, "root").select("fp", "component_id")


def hexadecimal(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    marked = written(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), "marked")
    return marked.join(fingerprint_components(marked), "fp").select(F.col("doc_id").alias(id_col), hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
