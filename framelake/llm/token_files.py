"""Token ids in binary files: patched frame-of-reference blocks with an index, in ascending id order.

File format, all little-endian: the magic b"PFOR", then u32 version, block length, number of documents,
number of ids and number of blocks; u64 number of ids in the range's earlier files; the documents' ids (i64) and a
byte each that is 1 for a null id; the documents' first positions (u64, one more than documents); the block index
(u64 byte offset of each block, one more than blocks); then the blocks. A block is u32 minimum,
u8 width, u8 number of exceptions, the values less the minimum cut to `width` bits and packed lowest bit
first, the exceptions' places (u8) and their bits above the width (u32). The width is the number of bits
that holds the chosen percentile of the block's values, so what lies above it becomes an exception.

Files are rows of a Parquet table in the shared folder (range, part, number of ids, the file's bytes): any store
that Spark writes will do, and a lost task is simply redone. Texts are dealt once by ranges of doc_id and a hash
of the text, so that null or repeated ids are spread too, and tokenised in order; a file holds at most
`file_tokens` ids, or one document. A worker holds one file and one batch of texts.

Null texts are empty (the end id alone); null ids sort first; repeated ids are ordered by their texts' hash
and give a row each; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, texts_of, written
from .wordbpe import id_cache, loaded

MAGIC, VERSION, BLOCK = b"PFOR", 2, 128
PERCENTILE = 90
FILE_TOKENS = 1 << 20
#: Bytes of text that one range is meant to hold.
RANGE_BYTES = 64 << 20
_HEAD = struct.Struct("<4s5IQ")
CACHE_WORDS = 900_000


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def encode_file(ids: np.ndarray, starts: np.ndarray, doc_ids: list, before: int = 0, percentile: float = PERCENTILE, block: int = BLOCK) -> bytes:
    """The bytes of one file; starts has the position of each document's first id, and the number of ids."""
    n, blocks = len(ids), -(-len(ids) // block)
    full = np.empty(blocks * block, np.uint32)
    full[:n] = ids
    if n % block:
        full[n:] = ids[-1]
    rows = full.reshape(blocks, block) if blocks else full.reshape(0, block)
    low = rows.min(axis=1) if blocks else np.empty(0, np.uint32)
    delta = rows - low[:, None]
    rank = min(block - 1, int(block * percentile / 100))
    width = _bit_lengths(np.partition(delta, rank, axis=1)[:, rank]) if blocks else np.empty(0, np.uint8)
    over = (delta >> width[:, None].astype(np.uint32)) > 0
    n_over = over.sum(axis=1)
    size = 6 + width.astype(np.int64) * (block // 8) + 5 * n_over
    at = np.concatenate(([0], np.cumsum(size))).astype(np.uint64)
    body = np.zeros(int(at[-1]), np.uint8)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        if w:
            cell = "<u2" if w <= 16 else "<u4"
            raw = delta[own].astype(cell).view(np.uint8).reshape(len(own), block, -1)
            bits = np.unpackbits(raw, axis=2, count=int(w), bitorder="little")
            packed = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
            body[at[own].astype(np.int64)[:, None] + 6 + np.arange(packed.shape[1])] = packed
    head = np.zeros((blocks, 6), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(blocks, 4)
    head[:, 4], head[:, 5] = width, n_over
    body[at[:-1].astype(np.int64)[:, None] + np.arange(6)] = head
    row, col = np.nonzero(over)
    first = np.concatenate(([0], np.cumsum(n_over)))
    tail = at[row].astype(np.int64) + 6 + width[row].astype(np.int64) * (block // 8)
    nth = np.arange(len(row)) - first[row]
    body[tail + nth] = col
    high = (delta[row, col] >> width[row]).astype("<u4").view(np.uint8).reshape(-1, 4)
    body[(tail + n_over[row] + 4 * nth)[:, None] + np.arange(4)] = high
    names, null = np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8)
    return b"".join((_HEAD.pack(MAGIC, VERSION, block, len(doc_ids), n, blocks, before), names.tobytes(), null.tobytes(), np.asarray(starts, "<u8").tobytes(), at.astype("<u8").tobytes(), body.tobytes()))


class TokenFile:
    """An opened file: block length, number of ids, ids before it, documents, their starts, block index, block bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        _, version, self.block, docs, self.n, blocks, self.before = _HEAD.unpack_from(data)
        if version != VERSION:
            raise ValueError(f"unknown version {version}")
        at = _HEAD.size
        names, null = np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(names, null, strict=True)]
        at += 9 * docs
        self.starts = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64)
        self.index = np.frombuffer(data, "<u8", blocks + 1, at + 8 * (docs + 1))
        self.body = np.frombuffer(data, np.uint8, offset=at + 8 * (docs + blocks + 2))


def read_ids(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids at positions first to last - 1; only the blocks that hold them are unpacked."""
    file = TokenFile(data)
    block, index, body = file.block, file.index, file.body
    last = file.n if last is None else min(last, file.n)
    if first >= last:
        return np.empty(0, np.uint32)
    b0, b1 = first // block, -(-last // block)
    at = index[b0:b1].astype(np.int64)
    low = np.ascontiguousarray(body[at[:, None] + np.arange(4)]).view("<u4").ravel()
    width, n_over = body[at + 4].astype(np.int64), body[at + 5].astype(np.int64)
    out = np.zeros((b1 - b0, block), np.uint32)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        if w:
            raw = body[at[own][:, None] + 6 + np.arange(w * block // 8)]
            bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(own), block, w)
            out[own] = (bits * (np.uint32(1) << np.arange(w, dtype=np.uint32))).sum(axis=2, dtype=np.uint32)
    row = np.repeat(np.arange(b1 - b0), n_over)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    tail = at[row] + 6 + width[row] * (block // 8)
    high = np.ascontiguousarray(body[(tail + n_over[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
    out[row, body[tail + nth]] |= high << width[row].astype(np.uint32)
    return (out + low[:, None]).ravel()[first - b0 * block : last - b0 * block]


def write_token_files(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, file_tokens: int = FILE_TOKENS, cache_words: int = CACHE_WORDS) -> DataFrame:
    """The table of files: range, part, n_tokens, payload."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    # one width for all that is written and read
    wide = "<u2" if max(loaded(path).library.get_vocab_size(), end_id + 1) <= 65_536 else "<u4"

    def pack(batches):
        cache, end = id_cache(path, wide, cache_words), np.array([end_id], wide).tobytes()
        own, part, before, ids, names, held = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def flush():
            nonlocal part, before, ids, names, held
            every = np.frombuffer(b"".join(ids), wide).astype(np.uint32)
            starts = np.concatenate(([0], np.cumsum([len(x) // len(end) for x in ids])))
            row = pa.RecordBatch.from_pydict({"range": pa.array([own], pa.int32()), "part": pa.array([part], pa.int32()), "n_tokens": pa.array([len(every)], pa.int64()), "payload": pa.array([encode_file(every, starts, names, before)], pa.binary())})
            part, before, ids, names, held = part + 1, before + len(every), [], [], 0
            return row

        for batch in batches:
            for doc, x in zip(batch.column("doc_id").to_pylist(), cache.encode(texts_of(batch, "text")), strict=True):
                n = len(x) // len(end) + 1
                if ids and held + n > file_tokens:
                    yield flush()
                ids.append(x + end)
                names.append(doc)
                held += n
        if ids:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), "tie"]
    placed = docs.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    return written(placed.mapInArrow(pack, "range int, part int, n_tokens long, payload binary"), "tokens")


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files.

    Only the total of each range comes to the driver: as many numbers as there are ranges.
    """
    totals = sorted((r["range"], r["n"]) for r in files.groupBy("range").agg(F.sum("n_tokens").alias("n")).collect())
    begin, so_far = {}, 0
    for b, n in totals:
        begin[b], so_far = so_far, so_far + n

    def decode(batches):
        for batch in batches:
            for own, data in zip(batch.column("range").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                file, ids = TokenFile(data), read_ids(data).astype("<u4")
                starts = file.starts
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(file.doc_ids, pa.int64()), "start": pa.array(starts[:-1] + begin[own] + file.before), "n_tokens": pa.array(np.diff(starts)), "ids_crc32": pa.array(crc, pa.int64())})

    return files.select("range", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
