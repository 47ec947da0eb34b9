"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and pairs of words are hashed into 2^16 buckets. One pass over all documents counts the raw corpus's
multinomial and, among them, the target's: labelled documents of quality 1 that are not toxic. A document's
score is the mean over its n-grams of log p(target) - log p(raw), both smoothed. It is kept if it passes the
base rules and its score reaches a threshold, found on labelled documents that the target did not use: the
best balanced accuracy among thresholds that keep at least `keep` of those of quality 1.

Labels are used up to `sample` rows, those with the smallest keyed hash: half for the target, half for the
threshold. A document labelled twice is trusted only if all its labels say so, and only trusted ones are good ones
to the threshold too. Corpus counts cover every document. What comes to the driver is a fixed number of bucket
counts and at most `sample` scores.

Null texts have no words and so fail the base rules; an empty table gives no rows; with no labels every
document that passes the base rules is kept; repeated ids count and are judged row by row; labels with null
ids or qualities are left out; other columns pass through `judge` and clash with nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, keyed
from .wordbpe import WordCache

BUCKETS = 1 << 16
SAMPLE = 20_000
KEEP = 0.995
SMOOTHING = 1.0
CACHE_WORDS = 500_000
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MOST_REPEATED = 50, 50
_GAPS = str.maketrans("", "", " \t\n\x0b\x0c\r")
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"

_HASHES = WordCache(lambda w: xxhash.xxh64_intdigest(w), CACHE_WORDS)


def word_hashes(data: bytes) -> np.ndarray:
    words = data.split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def ngram_buckets(h: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all words and all pairs of neighbouring words."""
    pairs = h[:-1] * _P + h[1:] * _Q
    every = np.concatenate((h, pairs ^ (pairs >> np.uint64(29))))
    return ((every * _Q) >> np.uint64(40)).astype(np.int64) % buckets


def base_stats(text: str, data: bytes, h: np.ndarray) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    n = len(h)
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    repeated = 0
    if n > 3:
        windows = (h[:-2] * _P + h[1:-1]) * _Q + h[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        if same.any():
            found = np.zeros(n, bool)
            first = np.concatenate((order[1:][same], order[:-1][same]))
            for k in range(3):
                found[first + k] = True
            repeated = int(found.sum())
    return n, len(text.translate(_GAPS)) if not text.isascii() else len(b"".join(data.split())), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, n < MIN_WORDS or 100 * repeated > MOST_REPEATED * n


class Model:
    """Log ratios by bucket, and the threshold."""

    def __init__(self, ratios: np.ndarray, threshold: float):
        self.ratios, self.threshold = ratios, threshold

    def score(self, h: np.ndarray) -> float:
        return float(self.ratios[ngram_buckets(h, len(self.ratios))].mean(dtype=np.float64)) if len(h) else float("-inf")


def log_ratios(target: np.ndarray, raw: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(raw))
    p, q = target + smoothing, raw + smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum())


def best_threshold(good: np.ndarray, bad: np.ndarray, keep: float = KEEP) -> float:
    """Best balanced accuracy among thresholds that keep the share `keep` of good ones; the lowest on ties."""
    if not len(good) or not len(bad):
        return float("-inf")
    good, bad = np.sort(good), np.sort(bad)
    highest = good[int(len(good) * (1 - keep))]
    ends = np.unique(np.concatenate((good[good <= highest], [highest])))
    lost, rejected = np.searchsorted(good, ends) / len(good), np.searchsorted(bad, ends) / len(bad)
    best = int(np.argmax(rejected - lost))
    below = bad[bad < ends[best]]
    return float((ends[best] + below[-1]) / 2) if len(below) else float("-inf")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, sample: int = SAMPLE, keep: float = KEEP) -> Model:
    """The model from all documents and a bounded sample of labels."""
    spark = docs.sparkSession
    bounded_batches(spark)
    key = keyed("quality", F.col("doc_id"))
    trusted = F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int"))
    known = labels.select(F.col(id_col).alias("doc_id"), "quality", "toxic").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(trusted.alias("trusted"))
    known = known.withColumn("key", key).orderBy("key", "doc_id").limit(sample).withColumn("held", F.col("key") % 2 == 1)
    rows = [(r["doc_id"], 0 if r["held"] else 1, r["trusted"]) for r in known.collect() if r["held"] or r["trusted"]]
    use = spark.createDataFrame(rows, "doc_id long, target int, quality int")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, own in zip(batch.column("text").to_pylist(), batch.column("target").to_pylist(), strict=True):
                n = np.bincount(ngram_buckets(word_hashes((text or "").encode()), buckets), minlength=buckets)
                raw += n
                if own:
                    target += n
        found = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(found, pa.int32()), "raw": pa.array(raw[found]), "target": pa.array(target[found])})

    flagged = texts.join(F.broadcast(use.select("doc_id", "target")), "doc_id", "left").select("text", "target")
    counts = flagged.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[counts["bucket"].to_numpy()], target[counts["bucket"].to_numpy()] = counts["raw"].to_numpy(), counts["target"].to_numpy()
    model = Model(log_ratios(target, raw), float("-inf"))
    if not target.sum():
        return model
    ratios = spark.sparkContext.broadcast(model.ratios)

    def score(batches):
        own = Model(ratios.value, 0.0)
        for batch in batches:
            s = [own.score(word_hashes((t or "").encode())) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(s, pa.float64())], ["quality", "score"])

    held = texts.join(F.broadcast(use.where("target = 0").select("doc_id", "quality")), "doc_id").select("text", "quality")
    scores = held.mapInArrow(score, "quality int, score double").where("score > double('-inf')").toPandas()
    good = scores["quality"] == 1
    model.threshold = best_threshold(scores["score"][good].to_numpy(), scores["score"][~good].to_numpy(), keep)
    return model


def judge(docs: DataFrame, model: Model, text_col: str = "text", keep_columns: tuple[str, ...] | None = ("doc_id",), only_kept: bool = False) -> DataFrame:
    """The chosen columns of docs (None: all), with statistics, score and verdict, or only the rows kept as they were."""
    spark = docs.sparkSession
    bounded_batches(spark)
    columns = list(docs.columns if keep_columns is None else keep_columns)
    shared = spark.sparkContext.broadcast((model.ratios, model.threshold))
    docs = docs.select(*columns, *([] if text_col in columns else [text_col]))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def apply(batches):
        own = Model(*shared.value)
        for batch in batches:
            out = []
            for text in batch.column(text_col).to_pylist():
                text = text or ""
                data = text.encode()
                h = word_hashes(data)
                stats, score = base_stats(text, data, h), own.score(h)
                out.append((*stats, score, not stats[-1] and score >= own.threshold))
            cols = list(zip(*out, strict=True)) or [()] * 8
            if only_kept:
                yield batch.select(columns).filter(pa.array(cols[-1], pa.bool_()))
                continue
            made = [pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + made, [*columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"])

    return docs.mapInArrow(apply, kinds if only_kept else f"{kinds}, {STATS}, score double, kept boolean")
