"""Token counts of whole texts by a map-side two-tier lookup, without any shuffle of pre-tokens.

Tier one is a compact hash table of frequent pre-token lengths, broadcast once (at most `table_size`
entries of 10 bytes at a load of a half). Tier two is a cache in each worker: a word that is not in it is
split into pre-tokens, whose lengths come from the table or, failing that, from the tokenizer itself. The
table is read off about `sample_docs` rows, drawn from all rows by a keyed hash where they lie; each task sends its
own most frequent `task_entries` at most, and only tasks that hold a drawn row send any. It is only a cache, so what
it holds changes no count.

Null texts count as empty (no bytes, no tokens); repeated rows and ids give a row each; empty tables give
no rows; columns other than the two named ones are not read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, keyed, texts_of
from .wordbpe import PRE_TOKEN, CompactTable, length_caches, loaded

TABLE_SIZE = 32_768
SAMPLE_DOCS = 1_000
TASK_ENTRIES = 2_048
CACHE_WORDS = 300_000


def frequent_lengths(docs: DataFrame, id_col: str, text_col: str, path: str, sample_docs: int, table_size: int, task_entries: int = TASK_ENTRIES) -> CompactTable:
    """Lengths of the most frequent pre-tokens of a sample; at most sample_docs x task_entries small rows come back."""

    def count(batches):
        bpe, seen = loaded(path), Counter()
        for batch in batches:
            for text in texts_of(batch, "text"):
                if bpe.simple(text):
                    for word, n in Counter(bpe.words(text)).items():
                        for piece in PRE_TOKEN.findall(word):
                            seen[piece] += n
        top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:task_entries]
        if top:
            yield pa.RecordBatch.from_pydict({"k": pa.array([CompactTable.key(p) - (1 << 63) for p, _ in top], pa.int64()), "v": pa.array([min(len(bpe.ids(p)), 65_535) for p, _ in top], pa.int32()), "n": pa.array([n for _, n in top], pa.int64())})

    total = docs.count()
    drawn = docs.select(F.col(text_col).alias("text"), keyed("tokens", F.col(id_col)).alias("key"))
    if total > sample_docs:
        drawn = drawn.where(F.col("key") < F.lit(int(sample_docs / total * (1 << 60))))
    seen, length = Counter(), {}
    for r in drawn.select("text").mapInArrow(count, "k long, v int, n long").toLocalIterator():
        seen[r["k"]] += r["n"]
        length[r["k"]] = r["v"]
    return CompactTable.build([(k + (1 << 63), length[k]) for k, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:table_size] if length[k] < 65_535])


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    first = frequent_lengths(docs, id_col, text_col, path, sample_docs, table_size)
    shared = spark.sparkContext.broadcast((first.keys, first.values))
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        bpe, frequent = loaded(path), CompactTable(*shared.value)

        def piece_length(piece: str) -> int:
            known = frequent.get(CompactTable.key(piece))
            return len(bpe.ids(piece)) if known is None else known

        lengths, pieces = length_caches(path, cache_words)
        pieces.fill = piece_length
        lengths.fill = lambda word: sum(map(pieces.__getitem__, PRE_TOKEN.findall(word)))
        for batch in batches:
            texts = texts_of(batch, text_col)
            n = [sum(map(lengths.__getitem__, bpe.words(t))) if bpe.simple(t) else len(bpe.ids(t)) for t in texts]
            size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(count, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")
