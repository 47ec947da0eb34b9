"""Near-dedup of texts by wide SimHash fingerprints and exact verification: five words, a similarity of 0.8 or more.

Two texts are linked if the sets of their 5-word shingles have a similarity (Jaccard) of 0.8; groups are what links join.

A radius of 3 in 64 bits finds hardly anything at a similarity of 0.8, where about 15 % of the bits differ. So a text has
a fingerprint of 1,024 bits here: bit k is set if over half of its different shingles' hashes have it. Of two texts with a
similarity of 0.8, hence a cosine of 2 * 0.8 / 1.8, it differs in about 1024 * acos(0.889) / pi = 155 bits, give or
take 12; unrelated texts differ in 512, give or take 16.

Candidates come from deletion variants of the first 256 bits, cut into 16 segments of 16 bits. Texts that differ there
in at most 31 bits have a segment that differs in at most one bit; at 39 bits, the mean at 0.8, they have one with a
probability of over 0.99. A segment is dealt with one of its four nibbles as a wildcard, which covers the variants of that
nibble's four bits at once, so a text is dealt 64 times. Within a variant, those up to 51 bits apart (two spreads above the
mean) are candidates, and of these the nearest that join two parts are reported, never all pairs. Candidates of 190
differing bits or fewer in all 1,024 (three spreads above the mean) are verified by the exact similarity.

This groups most near copies but not all: of pairs at 0.8 some are further apart, and a candidate may have been left out
for others that were refused. So the links between the groups that are left are found exactly. All shingles have one
order, the rarest first, as counted over all sets (a sample of fixed size tells ever fewer apart as the input grows, and
pairs then grow with its square). Sets of n and m shingles with a similarity of 0.8 share 4 / 9 * (n + m) or more, so each of them
has this many from the first shared shingle on, which is among the first n - ceil(0.8 * n) + 1. Each set is dealt by these,
and of those that meet at a shingle, all pairs of different groups with enough shingles from there on are verified. At a
shingle that many sets share, pairs whose parity bits tell that they differ in too many shingles are left out before.

A variant over MOST_DIRECT fingerprints is split in its task by the variants of the other segments. One over MOST_HELD
is kept in a scratch file of the task, and its parts are compared two by two. A shingle's rows beyond MOST_HELD lie in a
scratch file too.
"""

from __future__ import annotations

import contextlib
import itertools
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written
from .components import components

SHINGLE = 5
SEED = 42
#: Words of 64 bits of a fingerprint that are dealt, and in all.
WORDS = 4
ALL_WORDS = 16
SEGMENTS = 16
SIMILARITY = 0.8
#: Differing bits, at most: of candidates among the dealt bits; among all bits, of nearly sure links (verified as well) and of pairs worth verifying.
DISTANCE = 51
SURE = 132
UNSURE = 190
#: Fingerprints of one variant that are compared without another split.
MOST_DIRECT = 1 << 13
#: Fingerprints of one variant in memory (32 bytes each).
MOST_HELD = 1 << 20
#: Rows of whole variants that are compared in one run, and candidates that wait to be joined.
RUN = 1 << 15
WAITING = 1 << 19
#: Bits of a hash by which shingles are dealt to be counted, and bits of its place in the table of levels, at most (16 at
#: least). The levels order the shingles; any order is exact.
BUCKET_BITS = 10
LEVEL_BITS = 25
#: Rows of one shingle that are compared by offsets, without parity bits; and else rows of a block.
MOST_OFFSETS = 64
BLOCK = 1 << 9


def _words(h: np.ndarray) -> np.ndarray:
    """Hashes to rows of ALL_WORDS words: the hash itself, then the finalizer of SplitMix64 over its successors."""
    x = h[:, None] + np.arange(1, ALL_WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.concatenate((h[:, None], x ^ (x >> np.uint64(31))), axis=1)


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each 5-word shingle: lower-case A-Z, words between ASCII white space; fewer words are one shingle, none give none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, ends = b" ".join(words), list(itertools.accumulate(len(w) + 1 for w in words))
    hashed = xxhash.xxh64_intdigest
    last = ends[SHINGLE - 1 :] or ends[-1:]
    return np.array([hashed(joined[a : b - 1], SEED) for a, b in zip([0, *ends], last, strict=False)], np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """The different hashes, sorted."""
    return np.unique(shingle_hashes(text)).astype("<u8")


def wide_fingerprint(text: str | None) -> bytes:
    """128 bytes of one text; without words all zero."""
    return _fingerprint(shingle_set(text))


def _fingerprint(h: np.ndarray) -> bytes:
    ones = np.zeros(64 * ALL_WORDS, np.int64)
    for at in range(0, len(h), 255):  # as many as a byte can count
        bits = np.unpackbits(_words(h[at : at + 255]).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes()


def variants(fps: np.ndarray, skip: int | None = None):
    """(variant, segment) for each segment but skip and each nibble as the wildcard: the segment's place and the bits left."""
    parts = fps.astype("<u8").view("<u2").reshape(len(fps), SEGMENTS)
    for segment in range(SEGMENTS):
        if segment != skip:
            for nibble in range(4):
                yield (segment << 18 | nibble << 16) | (parts[:, segment] & np.uint16(0xFFFF ^ (0xF << 4 * nibble))).astype(np.int64), segment


class _Parts:
    """Parts of a run's fingerprints; candidates wait in a bounded buffer and join parts, nearest first."""

    def __init__(self, n: int):
        self.parent, self.waiting, self.size, self.out = np.arange(n), [], 0, []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        new = self.parent[a] != self.parent[b]
        if new.any():
            self.waiting.append(np.stack((a[new], b[new], d[new]), axis=1))
            self.size += int(new.sum())
            if self.size > WAITING:
                self.join()

    def join(self) -> None:
        if not self.size:
            return
        found = np.concatenate(self.waiting)
        for x, y, d in found[np.argsort(found[:, 2], kind="stable")].tolist():
            p, q = self.root(x), self.root(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                self.out.append((x, y, d))
        while (self.parent[self.parent] != self.parent).any():
            self.parent = self.parent[self.parent]
        self.waiting, self.size = [], 0


def _compare(key: np.ndarray, fps: np.ndarray, row: np.ndarray, parts: _Parts) -> None:
    """Give parts the candidates among rows of equal key (sorted); row: their places in the run."""
    at, k = np.arange(len(key)), 0
    while len(at):
        k += 1
        at = at[at + k < len(key)]
        at = at[key[at] == key[at + k]]
        d = np.bitwise_count(fps[at, :2] ^ fps[at + k, :2]).sum(axis=1, dtype=np.int64)
        near, d = at[d <= DISTANCE], d[d <= DISTANCE]
        d = d + np.bitwise_count(fps[near, 2:] ^ fps[near + k, 2:]).sum(axis=1, dtype=np.int64)
        near, d = near[d <= DISTANCE], d[d <= DISTANCE]
        parts.add(row[near], row[near + k], d)


def links_of(key: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Rows (place, place, distance): candidates of each variant (key, sorted), the nearest that join its parts."""
    cut = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
    large = np.flatnonzero(np.diff(cut) > MOST_DIRECT)
    parts, small = _Parts(len(key)), np.ones(len(key), bool)
    for g in large:
        rows = np.arange(cut[g], cut[g + 1])
        small[rows] = False
        for finer, _ in variants(fps[rows], int(key[rows[0]]) >> 18):
            order = np.argsort(finer, kind="stable")
            _compare(finer[order], fps[rows[order]], rows[order], parts)
    rows = np.flatnonzero(small)
    _compare(key[rows], fps[rows], rows, parts)
    parts.join()
    return np.array(parts.out, np.int64).reshape(-1, 3)


def _binary(fps: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(fps.astype("<u8"))
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(0, 32 * len(data) + 1, 32, dtype=np.int32)), pa.py_buffer(data)])


def _numbers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, WORDS)


def _deal(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            fps = _numbers(batch.column("fp").slice(start, 1024))
            keys = np.concatenate([k for k, _ in variants(fps)])
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), _binary(np.tile(fps, (4 * SEGMENTS, 1)))], ["variant", "fp"])


def _linked(batches):
    """Arrow batches sorted by variant to links a, b."""

    def rows(key, fps):
        pairs = links_of(key, fps)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([_binary(fps[pairs[:, 0]]), _binary(fps[pairs[:, 1]]), pa.array(pairs[:, 2].astype(np.int32))], ["a", "b", "d"])

    def held_out(scratch, parts, fps):
        """The last part of an oversized variant against itself and each part in the scratch file."""
        for at in range(parts):
            scratch.seek(at * MOST_HELD * 32)
            old = np.frombuffer(scratch.read(MOST_HELD * 32), "<u8").reshape(-1, WORDS)
            both = np.concatenate((old, fps))
            yield from rows(np.full(len(both), held_key), both)
        if not parts:
            yield from rows(np.full(len(fps), held_key), fps)

    keys, held, size, scratch, parts, held_key = [], [], 0, None, 0, -1
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            keys.append(batch.column("variant").to_numpy().astype(np.int64))
            held.append(_numbers(batch.column("fp")))
            size += batch.num_rows
            if size < RUN:
                continue
        if not size:
            continue
        key, fps = np.concatenate(keys), np.concatenate(held)
        whole = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
        if parts and key[0] == held_key and (whole or batch is None):  # the rest of an oversized variant ends here
            end = int(np.searchsorted(key, held_key, "right"))
            yield from held_out(scratch, parts, fps[:end])
            key, fps, whole, parts = key[end:], fps[end:], max(whole - end, 0), 0
        elif parts and key[0] != held_key:
            parts = 0
        if whole:
            yield from rows(key[:whole], fps[:whole])
        key, fps = key[whole:], fps[whole:]
        while len(key) >= MOST_HELD:
            if not parts:
                scratch, held_key = tempfile.TemporaryFile(), int(key[0])
            yield from held_out(scratch, parts, fps[:MOST_HELD])
            scratch.seek(parts * MOST_HELD * 32)
            scratch.write(np.ascontiguousarray(fps[:MOST_HELD]).tobytes())
            parts, key, fps = parts + 1, key[MOST_HELD:], fps[MOST_HELD:]
        keys, held, size = ([key], [fps], len(key)) if len(key) else ([], [], 0)


def _measured(batches):
    """Candidates (sets a, b) with the two sides' other bits to a, b, d: the differing bits of all."""
    for batch in batches:
        rest = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8").reshape(batch.num_rows, -1) for c in ("rest_a", "rest_b")]
        d = np.bitwise_count(rest[0] ^ rest[1]).sum(axis=1, dtype=np.int32) + batch.column("d").to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(d.astype(np.int32))], ["a", "b", "d"])


def _shingled(batches):
    """s, text to s, shingles: the set of hashes, sorted, as bytes."""
    for batch in batches:
        sets = [shingle_set(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array(sets, pa.binary())], ["s", "shingles"])


def _verified(batches):
    """a, b and both shingle sets to the a, b with a similarity of SIMILARITY or more."""
    for batch in batches:
        kept = []
        for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            kept.append(both >= SIMILARITY * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _side(df: DataFrame, key: str, end: str, **columns: str) -> DataFrame:
    return df.select(F.col(key).alias(end), *[F.col(c).alias(name) for name, c in columns.items()])


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (one row a set: s, id, tag, perhaps more) with its text, once; rows alike in id and text are one."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("own"))
    found = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["id"]) & (rows["own"] == wanted["tag"]))
    # the null-safe join's own keys, so that the texts are shuffled once for both
    same = Window.partitionBy(F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id"), "own").orderBy("own")
    return found.withColumn("nth", F.row_number().over(same)).where("nth = 1").select(*[c for c in wanted.columns if c not in ("id", "tag")], "text")


def _possible(batches):
    """a, b with both sides' shingles and parity bits to the a, b that do not differ in too many bits for the similarity."""
    for batch in batches:
        odd = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8").reshape(batch.num_rows, -1) for c in ("odd_a", "odd_b")]
        n = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
        near = 9 * np.bitwise_count(odd[0] ^ odd[1]).sum(axis=1, dtype=np.int64) <= n
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def verified(pairs: DataFrame, prints: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of a written table of pairs of sets (a, b) that have the similarity; sets are fetched only where the parity bits allow it."""
    pairs = pairs.join(_side(prints, "s", "a", n_a="n", odd_a="odd"), "a").join(_side(prints, "s", "b", n_b="n", odd_b="odd"), "b")
    pairs = written(pairs.select("a", "b", "n_a", "n_b", "odd_a", "odd_b").mapInArrow(_possible, "a long, b long"), "possible")
    ends = pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct()
    wanted = prints.join(ends, "s", "left_semi").select("s", F.col("x.id").alias("id"), F.col("x.tag").alias("tag"))
    sets = written(_texts(docs, wanted).mapInArrow(_shingled, "s long, shingles binary"), "shingles")
    exact = pairs.join(_side(sets, "s", "a", set_a="shingles"), "a").join(_side(sets, "s", "b", set_b="shingles"), "b")
    return written(exact.select("a", "b", "set_a", "set_b").mapInArrow(_verified, "a long, b long"), "verified")


def candidates(prints: DataFrame) -> DataFrame:
    """Pairs of sets a, b whose fingerprints are near, of a written table: s, fp (dealt bits), rest (other bits)."""
    first = written(prints.groupBy("fp").agg(F.min(F.struct("s", "rest")).alias("t")).select("fp", "t.s", "t.rest"), "first")
    dealt = first.select("fp").mapInArrow(_deal, "variant int, fp binary")
    found = dealt.repartition("variant").sortWithinPartitions("variant").mapInArrow(_linked, "a binary, b binary, d int")
    found = found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d"))
    pairs = found.join(_side(first, "fp", "a", s_a="s", rest_a="rest"), "a").join(_side(first, "fp", "b", s_b="s", rest_b="rest"), "b")
    pairs = pairs.select(F.col("s_a").alias("a"), F.col("s_b").alias("b"), "d", "rest_a", "rest_b")
    near = pairs.mapInArrow(_measured, "a long, b long, d int").where(F.col("d") <= UNSURE).select("a", "b")
    alike = prints.select("fp", F.col("s").alias("a")).join(_side(first, "fp", "fp", b="s"), "fp").where("a <> b").select("a", "b")
    return written(near.union(alike), "candidates")


def _dealt_shingles(batches):
    """Texts to (bucket, hashes): of the shingles that start with a bucket's BUCKET_BITS bits, the next 32 bits each."""
    for batch in batches:
        h = np.sort(np.concatenate([*(shingle_set(t) for t in batch.column("text").to_pylist()), np.empty(0, "<u8")]))
        ends = np.searchsorted(h >> np.uint64(64 - BUCKET_BITS), np.arange((1 << BUCKET_BITS) + 1))
        there = np.flatnonzero(np.diff(ends)).astype(np.int32)
        starts = pa.py_buffer((4 * np.append(ends[there], len(h))).astype(np.int32))
        data = pa.py_buffer((h >> np.uint64(32 - BUCKET_BITS)).astype("<u4"))
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.Array.from_buffers(pa.binary(), len(there), [None, starts, data])], ["bucket", "hashes"])


def _levels(batches, bits: int):
    """Rows sorted by bucket to one row each: the bucket's share of a table of 2^bits levels (a byte: 16 log2 of the sets).

    A level is that of the most frequent shingle at its place, the first bits of its hash; 0 if none is in two sets.
    """

    def one(bucket, held):
        h, n = np.unique(np.frombuffer(b"".join(held), "<u4"), return_counts=True)
        h, n = h[n > 1], n[n > 1]
        levels = np.zeros(1 << bits - BUCKET_BITS, np.uint8)
        np.maximum.at(levels, h >> np.uint32(32 + BUCKET_BITS - bits), np.minimum(16 * np.log2(n), 255).astype(np.uint8))
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([levels.tobytes()], pa.binary())], ["bucket", "levels"])

    now, held = None, []
    for batch in batches:
        for bucket, hashes in zip(batch.column("bucket").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
            if bucket != now and held:
                yield one(now, held)
                held = []
            now = bucket
            held.append(hashes)
    if held:
        yield one(now, held)


def shingle_levels(prints: DataFrame, docs: DataFrame) -> np.ndarray:
    """How many sets have a shingle, counted over all sets, as levels by the first bits of its hash; 0 for those of one set.

    Where over a quarter of the places would be taken, the lowest levels are 0 too.
    """
    bits = min(LEVEL_BITS, max(16, (prints.agg(F.sum("n")).first()[0] or 0).bit_length()))
    wanted = prints.select("s", F.col("x.id").alias("id"), F.col("x.tag").alias("tag"))
    dealt = _texts(docs, wanted).select("text").mapInArrow(_dealt_shingles, "bucket int, hashes binary")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    rows = dealt.mapInArrow(lambda batches: _levels(batches, bits), "bucket int, levels binary").toArrow()
    levels = np.zeros((1 << BUCKET_BITS, 1 << bits - BUCKET_BITS), np.uint8)
    for bucket, own in zip(rows["bucket"].to_pylist(), rows["levels"], strict=True):
        levels[bucket] = np.frombuffer(own.as_buffer(), np.uint8)
    return lowest_off(levels.reshape(-1))


def lowest_off(levels: np.ndarray) -> np.ndarray:
    """levels with the lowest ones set to 0 until a quarter of the places is taken at most."""
    above = np.cumsum(np.bincount(levels, minlength=256)[::-1])[::-1]  # places of a level or higher ones
    least = 1 + int((above[1:] > len(levels) // 4).sum())
    levels[levels < least] = 0
    return levels


def frequent_in(sets: list[np.ndarray], levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes (sorted) in these sets that have a level, and their levels."""
    flat, shift = np.concatenate([*sets, np.empty(0, "<u8")]), np.uint64(65 - len(levels).bit_length())
    known = np.unique(flat[levels[flat >> shift] > 0])
    return known, levels[known >> shift].astype(np.int64)


def prefixes(sets: list[np.ndarray], frequent: tuple[np.ndarray, np.ndarray]):
    """(set's place, shingle, shingles of the set, those from this one on) for the first n - ceil(0.8 * n) + 1 of each set."""
    size = np.array([len(x) for x in sets], np.int64)
    flat, row = np.concatenate([*sets, np.empty(0, "<u8")]), np.repeat(np.arange(len(sets)), size)
    count, (known, times) = np.zeros(len(flat), np.int64), frequent
    if len(known):
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        count = np.where(known[at] == flat, times[at], 0)
    order = np.lexsort((flat, count, row))
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))
    n = size[row]
    kept = left >= (4 * n + 4) // 5
    return row[kept], flat[order][kept], n[kept], left[kept]


def odd_bits(h: np.ndarray) -> bytes:
    """128 bytes of a set of hashes: the parity of how many fall on each bit. Sets differ in as many hashes as bits, or more."""
    return np.packbits(np.bincount((h & np.uint64(1023)).astype(np.int64), minlength=1024) & 1, bitorder="little").tobytes()


def _runs(batches, columns, odd=False):
    """Arrow batches sorted by token to (token, rows) of whole tokens; one with over MOST_HELD rows comes from a scratch file."""
    tokens, held, size, scratch = [], [], 0, None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            tokens.append(batch.column("token").to_numpy())
            now = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in columns], axis=1)
            if odd:
                now = np.concatenate((now, np.frombuffer(b"".join(batch.column("odd").to_pylist()), "<i8").reshape(len(now), -1)), axis=1)
            held.append(now)
            size += batch.num_rows
            if size < RUN:
                continue
        if not held:
            continue
        token, rows = np.concatenate(tokens), np.concatenate(held)
        if scratch is not None and (batch is None or token[-1] != scratch[0]):  # the rest of a token in the file ends here
            end = int(np.searchsorted(token, scratch[0], "right"))
            rows[:end].tofile(scratch[1])
            scratch[1].flush()
            long = np.memmap(scratch[1], np.int64, "r").reshape(-1, rows.shape[1])
            yield np.broadcast_to(scratch[0], len(long)), long
            token, rows, scratch = token[end:], rows[end:], None
        whole = len(token) if batch is None or not len(token) else int(np.searchsorted(token, token[-1]))
        if whole:
            yield token[:whole], rows[:whole]
        token, rows = token[whole:], rows[whole:]
        if len(token) >= MOST_HELD:
            scratch = scratch or (token[0], tempfile.TemporaryFile())
            rows.tofile(scratch[1])
            token, rows = token[:0], rows[:0]
        tokens, held, size = [token], [rows], len(token)


def _cut(token: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]))


def _good(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets (s, root, n, left) are of different groups and have enough shingles left."""
    return (rows[a, 1] != rows[b, 1]) & (9 * np.minimum(rows[a, 3], rows[b, 3]) >= 4 * (rows[a, 2] + rows[b, 2]))


def _batches(token, a, b, n, left):
    for i in range(0, len(a), RUN):
        part = [c[i : i + RUN] for c in (a, b, n, left)]
        name = pa.nulls(len(part[0]), pa.int64()) if token is None else pa.array(token[i : i + RUN])
        yield pa.RecordBatch.from_arrays([name, *[pa.array(c.astype(k)) for c, k in zip(part, (np.int64, np.int64, np.int32, np.int32), strict=True)]], ["token", "a", "b", "n", "left"])


def _met(batches):
    """Arrow batches sorted by token to pairs of sets a, b to verify (no token), and to the rows of tokens that many sets share.

    Those of a token whose rows are all of one group are left out.
    """
    for token, rows in _runs(batches, ("s", "root", "n", "left")):
        cut = _cut(token)
        mixed = np.minimum.reduceat(rows[:, 1], cut[:-1]) != np.maximum.reduceat(rows[:, 1], cut[:-1])
        large = np.repeat(mixed & (np.diff(cut) > MOST_OFFSETS), np.diff(cut))
        at, k = np.flatnonzero(np.repeat(mixed, np.diff(cut)) & ~large), 0
        while len(at):
            k += 1
            at = at[at + k < len(token)]
            at = at[token[at] == token[at + k]]
            found = at[_good(rows, at, at + k)]
            x, y = rows[found, 0], rows[found + k, 0]
            yield from _batches(None, np.minimum(x, y), np.maximum(x, y), x * 0, x * 0)
        at = np.flatnonzero(large)
        for i in range(0, len(at), RUN):
            here = at[i : i + RUN]
            yield from _batches(token[here], *rows[here].T)


def _met_by_many(batches):
    """Rows of tokens that many sets share, with their parity bits, to pairs of sets a, b to verify."""
    for token, rows in _runs(batches, ("a", "b", "n", "left"), odd=True):
        cut = _cut(token)
        for g in range(len(cut) - 1):
            own = np.arange(cut[g], cut[g + 1])
            names, n = np.unique(rows[own, 1], return_counts=True)
            other = rows[own, 1] != names[n.argmax()]  # two of the largest group are never compared
            order, others = np.concatenate((own[other], own[~other])), own[other]
            for i in range(0, len(others), BLOCK):
                for j in range(i, len(order), BLOCK):
                    x, y = others[i : i + BLOCK], order[j : j + BLOCK]
                    p, q = np.nonzero(_good(rows, x[:, None], y[None, :]))
                    x, y = rows[x[p]], rows[y[q]]
                    # two sets with the similarity differ in (n + m) / 9 shingles at most
                    differ = (x[:, 4:] ^ y[:, 4:]).view(np.uint64)  # of signed numbers the absolute value's bits would be counted
                    near = 9 * np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= x[:, 2] + y[:, 2]
                    x, y = x[near, 0], y[near, 0]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def between(prints: DataFrame, roots: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of sets a, b of different groups (node, root) that may have the similarity: none that has it is left out."""
    levels = shingle_levels(prints, docs)

    def apply(batches):
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            place, token, n, left = prefixes(sets, frequent_in(sets, levels))
            s, root = (batch.column(c).to_numpy()[place] for c in ("s", "root"))
            columns = [token.view("<i8"), s, root, n.astype(np.int32), left.astype(np.int32)]
            for i in range(0, len(token), RUN):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + RUN]) for c in columns], ["token", "s", "root", "n", "left"])

    rooted = prints.join(_side(roots, "node", "s", root="root"), "s", "left")
    rooted = rooted.select("s", F.coalesce("root", "s").alias("root"), F.col("x.id").alias("id"), F.col("x.tag").alias("tag"))
    dealt = _texts(docs, rooted).mapInArrow(apply, "token long, s long, root long, n int, left int")
    met = dealt.repartition("token").sortWithinPartitions("token").mapInArrow(_met, "token long, a long, b long, n int, left int")
    met = written(met, "met")
    shared = met.where("token IS NOT NULL").join(_side(prints, "s", "a", odd="odd"), "a")
    shared = shared.repartition("token").sortWithinPartitions("token").mapInArrow(_met_by_many, "a long, b long")
    return written(met.where("token IS NULL").select("a", "b").union(shared).distinct(), "between")


def groups(prints: DataFrame, docs: DataFrame) -> DataFrame:
    """node, root: the sets that links join, of a written table of sets: s, x (id, tag of one row), fp, rest, n (shingles), odd (parity bits)."""
    near = components(verified(candidates(prints), prints, docs))
    more = verified(between(prints, near, docs), prints, docs)
    return components(_side(near, "node", "a", b="root").union(more))


@contextlib.contextmanager
def _shuffles_go(spark):
    """Shuffle files go when the step that made them is written, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id (null last), then of the smallest text hash.

    Groups are what links join. Null and word-less texts are one group; of rows alike in id and text one stays; different
    texts with a null or the same id are told apart; no rows give none; other columns stay, whatever their names. A set of
    shingles is known by a hash of 64 bits.
    """
    bounded_batches(docs.sparkSession)

    def apply(batches):
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            names = np.array([xxhash.xxh3_64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            fps = [_fingerprint(x) for x in sets]
            split = [pa.array([f[: 8 * WORDS] for f in fps], pa.binary()), pa.array([f[8 * WORDS :] for f in fps], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(names), *split, pa.array([len(x) for x in sets], pa.int32()), pa.array([odd_bits(x) for x in sets], pa.binary())], ["doc_id", "tag", "s", "fp", "rest", "n", "odd"])

    tag = F.xxhash64("text").alias("tag")
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", tag)
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", "text", tag).mapInArrow(apply, f"doc_id {kind}, tag long, s long, fp binary, rest binary, n int, odd binary")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), F.col("tag").alias("tag"))).alias("x")
    with _shuffles_go(docs.sparkSession):
        one = written(marked.groupBy("s").agg(first, *[F.min(c).alias(c) for c in ("fp", "rest", "n", "odd")]), "sets")
        roots = groups(one, docs)
    rooted = one.join(_side(roots, "node", "s", root="root"), "s", "left")
    chosen = rooted.groupBy(F.coalesce("root", "s").alias("root")).agg(F.min("x").alias("x")).select("x.id", F.col("x.tag").alias("t"))
    kept = tagged.join(chosen, tagged["doc_id"].eqNullSafe(chosen["id"]) & (tagged["tag"] == chosen["t"]), "left_semi")
    # rows alike in id and text are one; the null-safe join's own keys, so that the texts are shuffled once for both
    same = Window.partitionBy(F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id"), "tag").orderBy("tag")
    return kept.withColumn("nth", F.row_number().over(same)).where("nth = 1").select("row.*")
