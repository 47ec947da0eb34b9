"""Removal of byte strings that also start in an earlier document, by external induced suffix sorting.

A text is cut into stretches of neighbouring 50-byte windows whose least 19-byte hash is the same. Equal
windows have an equal least hash, so all stretches of one least hash, sorted as one shard, show every match.

1. Documents are written once as chunks (one Arrow batch each, a few MB; a longer text is one chunk). Each
   chunk sends the 128-bit digests of its texts, packed, and learns which texts are copies of a smaller
   document's: those go as a whole and take no part in what follows.
2. Each chunk sends its distinct least hashes, 6 bytes each in one packed row a bucket; buckets return those
   that two documents may hold (two hashes that agree in 47 bits only cost time). A hash that all documents hold comes once from a chunk, never once a row.
3. Chunks send the stretches of these hashes, an equal stretch once for its smallest document (later ones
   are removed where they lie). Spark sorts them by hash, bytes and document, spilling as it must; a task reads them
   in that order, so that equal stretches follow each other and only the first goes into a shard. A shard is
   suffix-sorted with common prefixes (suffix_sort.py): suffixes that share 50 bytes with the one before are one
   class, and windows of a class go if a smaller document has one. A shard is cut where a hash begins; a single hash
   is one shard, however large: its texts, the sort and its result then lie in scratch files, not in memory.
4. Covered ranges return to their chunk, packed, where the bytes are taken out.

Only stage 3 makes text larger than itself, and only where it is shared.

Null texts are empty; texts under 50 bytes are kept; null ids count as larger than all others; documents of
one id do not remove from each other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written
from .suffix_sort import LIMIT, Scratch, Spool, suffix_order

LENGTH = 50
K = 19  # 32 hashes a window, so that five doublings find the least
MOST_WINDOWS = 256
SHARD_BYTES = 8 << 20
BLOCK = 1 << 16
BUCKET_BYTES = 4 << 20
LAST = (1 << 63) - 1
_B = [np.uint64(pow(0x9E3779B97F4A7C15, e, 1 << 64)) for e in (1, 2, 4, 8)]


def _least(data: np.ndarray) -> np.ndarray:
    """The least hash of 19 bytes in each 50-byte window of data."""
    h = data.astype(np.uint64) + np.uint64(0x51)
    h1, powers = h, []
    for e, b in zip((1, 2, 4, 8), _B, strict=True):
        h = h[:-e] * b + h[e:]
        powers.append(h)
    n = len(data) - K + 1
    h = (h[:n] * _B[1] + powers[0][16 : 16 + n]) * _B[0] + h1[18 : 18 + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    for e in (1, 2, 4, 8, 16):
        h = np.minimum(h[:-e], h[e:])
    h *= np.uint64(0x94D049BB133111EB)  # least values are small; this spreads them again
    h ^= h >> np.uint64(31)
    return h & np.uint64((1 << 48) - 2)


def _pack(values: np.ndarray) -> bytes:
    """48-bit numbers as 6 bytes each."""
    return np.ascontiguousarray(values.astype("<u8")[:, None].view(np.uint8)[:, :6]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def stretches(data: np.ndarray, ends: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, windows and least hash of each stretch of texts, but those to skip, that lie end to end in data."""
    valid = np.ones(len(data), bool)
    for a, b, whole in zip([0, *ends[:-1].tolist()], ends.tolist(), skip.tolist(), strict=True):
        valid[a if whole else max(a, b - LENGTH + 1) : b] = False
    starts, sizes, values = [], [], []
    for at in range(0, len(data) - LENGTH + 1, BLOCK):
        h = _least(data[at : at + BLOCK + LENGTH - 1])
        good = valid[at : at + len(h)]
        new = np.empty(len(h) + 1, bool)
        new[0] = new[-1] = True
        new[1:-1] = (h[1:] != h[:-1]) | (good[1:] != good[:-1])
        cuts = np.flatnonzero(new)
        first, n = cuts[:-1], np.diff(cuts)
        keep = good[first]
        first, n = first[keep], n[keep]
        if len(n) and n.max() > MOST_WINDOWS:
            pieces = -(-n // MOST_WINDOWS)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            rest = np.repeat(n, pieces) - nth * MOST_WINDOWS
            first, n = np.repeat(first, pieces) + nth * MOST_WINDOWS, np.minimum(rest, MOST_WINDOWS)
        starts.append(first + at)
        sizes.append(n)
        values.append(h[first])
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(values)


def _chunk_rows(batch: pa.RecordBatch):
    for chunk, doc_ids, lens, data in zip(*(batch.column(c) for c in ("chunk", "doc_ids", "lens", "data")), strict=True):
        yield chunk.as_py(), doc_ids.values.to_numpy(zero_copy_only=False), lens.values.to_numpy(zero_copy_only=False), np.frombuffer(pa.decompress(data.as_buffer(), decompressed_size=sum(lens.as_py()), codec="zstd"), np.uint8)


def _to_chunks(batches):
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("text").fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = text.buffers()[2]
        data = pa.py_buffer(raw)[int(offsets[0]) : int(offsets[-1])] if raw else pa.py_buffer(b"")
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array([task << 33 | n], pa.int64()), "size": pa.array([data.size], pa.int64()),
            "doc_ids": pa.array([batch.column("doc_id").to_numpy(zero_copy_only=False)], pa.list_(pa.int64())),
            "null_id": pa.array([batch.column("null_id").to_numpy(zero_copy_only=False)], pa.list_(pa.bool_())),
            "lens": pa.array([np.diff(offsets)], pa.list_(pa.int64())), "digests": pa.array([b"".join(hashlib.blake2b(x.as_buffer() or b"", digest_size=16).digest() for x in text)], pa.binary()), "data": pa.array([pa.compress(data, codec="zstd", asbytes=True)], pa.binary()),
        })
        n += 1


COPY = np.dtype([("digest", "V16"), ("doc_id", "<i8")])


def _digests(buckets: int):
    def digests(batches):
        for batch in batches:
            for chunk, doc_ids, packed in zip(batch.column("chunk").to_pylist(), batch.column("doc_ids"), batch.column("digests").to_pylist(), strict=True):
                least, out = {}, {}
                for i, d in enumerate(doc_ids.values.to_pylist()):
                    x = packed[16 * i : 16 * i + 16]
                    least[x] = min(d, least.get(x, d))
                for x, d in least.items():
                    out.setdefault(int.from_bytes(x[:4], "little") * buckets >> 32, []).append(x + d.to_bytes(8, "little", signed=True))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(out), pa.int64()), "chunk": pa.array([chunk] * len(out), pa.int64()), "packed": pa.array([b"".join(x) for x in out.values()], pa.binary())})

    return digests


def _copied(bucket_rows):
    """For each chunk the digests that a document smaller than all of the chunk's has."""
    least: dict[bytes, int] = {}
    rows = [(chunk, [(x[i : i + 16], int.from_bytes(x[i + 16 : i + 24], "little", signed=True)) for i in range(0, len(x), 24)]) for chunk, x in bucket_rows]
    for _, own in rows:
        for x, d in own:
            least[x] = min(d, least.get(x, d))
    out = [(chunk, b"".join(x + least[x].to_bytes(8, "little", signed=True) for x, d in own if least[x] < d)) for chunk, own in rows]
    out = [x for x in out if x[1]]
    return pa.RecordBatch.from_pydict({"chunk": pa.array([c for c, _ in out], pa.int64()), "packed": pa.array([p for _, p in out], pa.binary())})


def _copies(doc_ids: np.ndarray, digests: bytes, others: list[bytes] | None) -> np.ndarray:
    """Whether each text of a chunk is a smaller document's, of this chunk or of another."""
    x = np.frombuffer(digests, "V16").tolist()
    least: dict[bytes, int] = {}
    for d, i in zip(doc_ids.tolist(), x, strict=True):
        least[i] = min(d, least.get(i, d))
    for i, d in np.frombuffer(b"".join(others or []), COPY).tolist():
        least[i] = min(d, least[i])
    return np.array([least[i] < d for d, i in zip(doc_ids.tolist(), x, strict=True)], bool)


def _hashes(buckets: int):
    def hashes(batches):
        for batch in batches:
            for (chunk, doc_ids, lens, data), digests, others in zip(_chunk_rows(batch), batch.column("digests").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                ends = np.cumsum(lens)
                start, _, value = stretches(data, ends, _copies(doc_ids, digests, others))
                doc = doc_ids[np.searchsorted(ends, start, side="right")]
                order = np.argsort(value, kind="stable")
                value, doc = value[order], doc[order]
                first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.empty(0, np.int64)
                if not len(first):
                    continue
                several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
                value = value[first]
                bucket = (value >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)
                packed = value | several
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(value)]))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[cuts[:-1]].astype(np.int64)), "chunk": pa.array([chunk] * (len(cuts) - 1), pa.int64()), "packed": pa.array([_pack(packed[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    return hashes


def _shared(bucket_rows):
    """What of each row another row of the bucket has, or several documents."""
    one = np.uint64(1)
    packed = [_unpack(x) for _, x in bucket_rows]
    every = np.concatenate(packed)
    every.sort()
    value = every & ~one
    twice = np.unique(np.concatenate((value[1:][value[1:] == value[:-1]], value[(every & one) == one])))
    chunks, out = [], []
    for (chunk, _), p in zip(bucket_rows, packed, strict=True):
        v = p & ~one
        hit = v[twice[np.minimum(np.searchsorted(twice, v), len(twice) - 1)] == v] if len(twice) else v[:0]
        if len(hit):
            chunks.append(chunk)
            out.append(_pack(hit))
    return pa.RecordBatch.from_pydict({"chunk": pa.array(chunks, pa.int64()), "packed": pa.array(out, pa.binary())})


def _by_bucket(solve):
    """solve(rows of chunk and packed bytes) for each bucket of rows in order of their buckets."""

    def walk(batches):
        now, held = None, []
        for batch in batches:
            for bucket, chunk, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "packed")), strict=True):
                if bucket != now and held:
                    yield solve(held)
                    held = []
                now = bucket
                held.append((chunk, packed))
        if held:
            yield solve(held)

    return walk


STRETCH = pa.schema([("value", pa.int64()), ("chunk", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("bytes", pa.binary())])


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranges merged where they meet, as rows of start and end."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return np.stack((start[new], end[np.concatenate((new[1:], [len(start)])) - 1]), axis=1)


def _range_row(chunk: int, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    packed = _ranges(start, end).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([chunk]), pa.array([0]), pa.array([None], pa.int64()), pa.array([packed], pa.binary())], schema=STRETCH)


def _to_stretches(batches):
    """Stretches to be sorted; and, as rows without a doc_id, packed ranges that go for an equal stretch before."""
    for batch in batches:
        for (chunk, doc_ids, lens, data), digests, others, masks in zip(_chunk_rows(batch), *(batch.column(c).to_pylist() for c in ("digests", "copies", "masks")), strict=True):
            ends = np.cumsum(lens)
            copy = _copies(doc_ids, digests, others)
            whole = copy & (lens >= LENGTH)
            if whole.any():
                yield _range_row(chunk, ends[whole] - lens[whole], ends[whole])
            if masks is None:
                continue
            start, n, value = stretches(data, ends, copy)
            shared = np.sort(_unpack(b"".join(masks)))
            hit = shared[np.minimum(np.searchsorted(shared, value), len(shared) - 1)] == value
            start, n, value = start[hit], n[hit], value[hit]
            doc = doc_ids[np.searchsorted(ends, start, side="right")]
            order = np.argsort(doc, kind="stable")
            raw, first, keep, gone = data.tobytes(), {}, [], []
            for i, a, size, d in zip(order.tolist(), start[order].tolist(), n[order].tolist(), doc[order].tolist(), strict=True):
                (gone if first.setdefault(raw[a : a + size + LENGTH - 1], d) < d else keep).append(i)
            keep, gone = np.array(keep, np.int64), np.array(gone, np.int64)
            for a in range(0, len(keep), 8192):
                k = keep[a : a + 8192]
                own = [raw[x : x + size + LENGTH - 1] for x, size in zip(start[k].tolist(), n[k].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(value[k].astype(np.int64)), pa.array(np.full(len(k), chunk)), pa.array(start[k]), pa.array(doc[k]), pa.array(own, pa.binary())], schema=STRETCH)
            if len(gone):
                yield _range_row(chunk, start[gone], start[gone] + n[gone] + LENGTH - 1)


class _Shard:
    """The different stretches of some hashes, end to end, with where they lie; in memory or in the task's scratch files."""

    def __init__(self, limit: int):
        self.scratch = Scratch(limit)
        self.texts, self.sizes, self.doc = Spool(self.scratch, np.uint8), Spool(self.scratch, np.int64), Spool(self.scratch, np.int64)
        self.owner, self.chunk, self.at = Spool(self.scratch, np.int64), Spool(self.scratch, np.int64), Spool(self.scratch, np.int64)
        self.last, self.n = None, 0

    def add(self, chunk: np.ndarray, at: np.ndarray, doc: np.ndarray, new: np.ndarray, texts: list[bytes]) -> None:
        """Rows in order; new: whether a row's text differs from the one before it. Its doc is the text's smallest."""
        number = self.n - 1 + np.cumsum(new)
        self.owner.append(number)
        self.chunk.append(chunk)
        self.at.append(at)
        self.doc.append(doc[new])
        self.sizes.append(np.array([len(x) for x in texts], np.int64))
        self.texts.append(np.frombuffer(b"\0".join([*texts, b""]), np.uint8))
        self.n += len(texts)

    @property
    def bytes(self) -> int:
        return self.texts.n

    def solved(self):
        """Chunk, first and last byte of what goes, in blocks."""
        if self.n < 2:
            return
        sizes, doc = self.sizes.finished(), self.doc.finished()
        begin = self.scratch.array(self.n + 1, np.int64)
        np.cumsum(sizes + 1, out=begin[1:])
        raw, n = self.texts.finished(), self.texts.n
        symbols, is_window = self.scratch.array(n + 1, np.uint16), self.scratch.array(n + 1, bool)
        for a in range(0, n, BLOCK):
            symbols[a : min(n, a + BLOCK)] = raw[a : a + BLOCK]
            symbols[a : min(n, a + BLOCK)] += 2
        for a in range(0, self.n, BLOCK):
            own = begin[a : min(self.n, a + BLOCK) + 1]
            symbols[own[1:] - 1] = 1
            edges = np.zeros(int(own[-1] - own[0]) + 1, np.int8)
            np.add.at(edges, own[:-1] - own[0], 1)
            np.add.at(edges, own[1:] - own[0] - LENGTH, -1)
            is_window[int(own[0]) : int(own[-1])] = np.cumsum(edges[:-1]) > 0
        symbols[n] = 0
        order = suffix_order(symbols, LENGTH, self.scratch)
        # suffixes that agree with the one before in LENGTH bytes are one class; its smallest document keeps it
        least = Spool(self.scratch, np.int64)
        whose, lowest = lambda pos: doc[np.searchsorted(begin, pos, side="right") - 1], None
        for pos, lcp in order.blocks():
            first = np.flatnonzero(lcp < LENGTH)
            lows = np.minimum.reduceat(whose(np.minimum(pos, n - 1)), np.concatenate(([0], first[first > 0])))  # the end mark is alone in its class
            if lowest is not None and len(first) and first[0] == 0:
                least.append(np.array([lowest]))
            elif lowest is not None:
                lows[0] = min(lows[0], lowest)
            least.append(lows[:-1])
            lowest = int(lows[-1])
        least.append(np.array([lowest]))
        least = least.finished()
        goes, nth = self.scratch.array(n + 2, bool), -1
        for pos, lcp in order.blocks():
            number = nth + np.cumsum(lcp < LENGTH)
            nth = int(number[-1])
            pos, number = pos[pos < n], number[pos < n]
            goes[pos + 1] = is_window[pos] & (whose(pos) > least[number])
        edges = Spool(self.scratch, np.int64)
        for a in range(0, n + 1, BLOCK):
            own = goes[a : min(n + 2, a + BLOCK + 1)]
            edges.append(np.flatnonzero(own[1:] != own[:-1]) + a)
        edges = edges.finished()
        owner, chunk, at = self.owner.finished(), self.chunk.finished(), self.at.finished()
        for k in range(0, len(edges), BLOCK):
            a, b = edges[k : k + BLOCK : 2], edges[k + 1 : k + BLOCK : 2]
            text = np.searchsorted(begin, a, side="right") - 1
            from_, to = np.searchsorted(owner, text, side="left"), np.searchsorted(owner, text, side="right")
            times = to - from_
            rows = np.repeat(from_, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            start = at[rows] + np.repeat(a - begin[text], times)
            yield chunk[rows], start, start + np.repeat(b - a, times) + LENGTH - 1


def _packed(chunk: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Ranges as a row for each chunk."""
    order = np.argsort(chunk, kind="stable")
    chunk, start, end = chunk[order], start[order], end[order]
    cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)] if len(chunk) else [0]
    pairs = list(zip(cuts[:-1], cuts[1:], strict=True))
    return pa.RecordBatch.from_pydict({"chunk": pa.array([int(chunk[a]) for a, _ in pairs], pa.int64()), "packed": pa.array([_ranges(start[a:b], end[a:b]).tobytes() for a, b in pairs], pa.binary())})


def _solved(shard_bytes: int, limit: int):
    """Rows in order of hash, bytes and document to packed ranges; a shard ends with the hash that passes shard_bytes.

    Rows of a text that a smaller document has too go at once. A hash of a single text needs no sorting; so the last
    text of a batch waits for the next one, if it is the first of its hash.
    """

    def solved(batches):
        shard, before, text, least = _Shard(limit), None, None, None
        waiting = (np.empty(0, np.int64),) * 4, []

        def settled():
            for chunk, start, end in shard.solved():
                yield _packed(chunk, start, end)

        for batch in batches:
            packed = batch.column("doc_id").is_null()
            if (ready := batch.filter(packed)).num_rows:
                yield ready.select(["chunk", "bytes"]).rename_columns(["chunk", "packed"])
            rows = batch.filter(pc.invert(packed))
            if not rows.num_rows:
                continue
            columns, texts = [rows.column(i).to_numpy(zero_copy_only=False) for i in range(4)], rows.column(4).to_pylist()
            goes = np.empty(len(texts), bool)
            for i, (x, d) in enumerate(zip(texts, columns[3].tolist(), strict=True)):
                if x != text:
                    text, least = x, d
                goes[i] = d > least
            if goes.any():
                size = np.array([len(x) for x, g in zip(texts, goes.tolist(), strict=True) if g])
                yield _packed(columns[1][goes], columns[2][goes], columns[2][goes] + size)
            stays = ~goes
            value, chunk, at, doc = (np.concatenate((w, c[stays])) for w, c in zip(waiting[0], columns, strict=True))
            texts = waiting[1] + [x for x, g in zip(texts, goes.tolist(), strict=True) if not g]
            if not texts:
                continue
            new = np.array([True, *(x != y for x, y in itertools.pairwise(texts))])
            if before is not None and before[1] == texts[0]:
                new[0] = False
            first = np.flatnonzero(new)
            hashes = value[first]
            joins = np.concatenate(([before is not None and len(hashes) > 0 and before[0] == hashes[0]], hashes[1:] == hashes[:-1])) if len(hashes) else np.empty(0, bool)
            some = joins | np.append(joins[1:], False)  # texts that are not alone in their hash
            end = len(texts)
            if len(hashes) and not joins[-1]:
                end = int(first[-1])
                some[-1] = False
            waiting = tuple(x[end:] for x in (value, chunk, at, doc)), texts[end:]
            if not end:
                continue
            # rows that go on with a text of the batch before stay with it
            nth = np.cumsum(new[:end]) - 1
            keep = np.concatenate((some, [True]))[nth]
            before = (value[end - 1], texts[end - 1])
            value, chunk, at, doc, new = (x[:end][keep] for x in (value, chunk, at, doc, new))
            texts = [x for x, k in zip(texts[:end], keep.tolist(), strict=True) if k]
            if not texts:
                continue
            size = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))  # bytes before each row
            begins = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
            done = 0
            while done < len(texts):
                free = (begins > done) | ((begins == done) & (shard.n > 0) & (value[done] != shard.last))
                full = begins[free & (shard.bytes + size[begins] - size[done] > shard_bytes)]
                cut = int(full[0]) if len(full) else len(texts)
                if cut > done:
                    shard.add(chunk[done:cut], at[done:cut], doc[done:cut], new[done:cut], [x for x, n in zip(texts[done:cut], new[done:cut].tolist(), strict=True) if n])
                    shard.last = int(value[cut - 1])
                if cut < len(texts):
                    yield from settled()
                    shard = _Shard(limit)
                done = cut
        yield from settled()

    return solved


def _removed(with_text: bool):
    def removed(batches):
        for batch in batches:
            for (_, doc_ids, lens, data), nulls, packed in zip(_chunk_rows(batch), batch.column("null_id").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                covered = np.zeros(len(data) + 1, np.int32)
                if packed:
                    p = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 2)
                    np.add.at(covered, p[:, 0], 1)
                    np.add.at(covered, p[:, 1], -1)
                keep = np.cumsum(covered)[:-1] == 0
                out, at = [], 0
                for doc, null, n in zip(doc_ids.tolist(), nulls, lens.tolist(), strict=True):
                    k, own = keep[at : at + n], data[at : at + n]
                    at += n
                    whole = k.all()
                    left = (own if whole else own[k]).tobytes()
                    spans = 0 if whole else int((~k[0]) + np.count_nonzero(k[:-1] & ~k[1:]))
                    out.append((None if null else doc, n, n - len(left), spans, hashlib.sha256(left).hexdigest(), left if with_text else b""))
                cols = list(zip(*out, strict=True))
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    arrays.append(pa.array(cols[5], pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return removed


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, shard_bytes: int = SHARD_BYTES, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document; with_text adds the kept bytes.

    A shard ends with the hash that passes shard_bytes; its arrays beyond `limit` bytes lie in scratch files.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    key = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(key, F.lit(LAST)).alias("doc_id"), key.isNull().alias("null_id"), F.col(text_col).alias("text"))
    chunks = written(rows.mapInArrow(_to_chunks, "chunk long, size long, doc_ids array<long>, null_id array<boolean>, lens array<long>, digests binary, data binary"), "chunks")
    total = chunks.agg(F.sum("size").alias("n")).first()["n"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * 6 // 16 // BUCKET_BYTES)
    bare = chunks.drop("size")

    def answers(asked, solve, name):
        """What the buckets return, gathered by chunk."""
        told = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_by_bucket(solve), "chunk long, packed binary")
        return told.groupBy("chunk").agg(F.collect_list("packed").alias(name))

    asked = "bucket long, chunk long, packed binary"
    known = bare.join(answers(chunks.select("chunk", "doc_ids", "digests").mapInArrow(_digests(buckets), asked), _copied, "copies"), "chunk", "left")
    masks = answers(known.mapInArrow(_hashes(buckets), asked), _shared, "masks")
    found = known.join(masks, "chunk", "left").mapInArrow(_to_stretches, "value long, chunk long, at long, doc_id long, bytes binary")
    ranges = found.repartition("value").sortWithinPartitions("value", "bytes", "doc_id").mapInArrow(_solved(shard_bytes, limit), "chunk long, packed binary").groupBy("chunk").agg(F.collect_list("packed").alias("ranges"))
    # all joins are left joins of the same columns, so that the chunks are shuffled once
    extra = ", kept binary" if with_text else ""
    return bare.join(ranges, "chunk", "left").mapInArrow(_removed(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + extra)
