"""The pipeline on small tables: each stage keeps what it should."""

import re

import corpus_pipeline
from framelake.llm.common import table

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, DIR).cache()
        assert out.columns == columns
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) <= n, name
        docs, n = out, len(ids)
    last = corpus_pipeline.run(spark, DIR)
    assert set(last.columns) == {*columns, "slot", "shard"} and last.count() > 0


def test_stages_against_brute_force(spark):
    """Near-dedup by all pairs of texts, decontamination by all windows, the mix by its words, shards by their table."""
    import hashlib

    from framelake.llm import mixing, sharding
    from test_near_text import survivors
    from test_text_operators import WORD, brute_leaks

    docs = table(spark, DIR, "documents")
    rows = docs.collect()
    kept = corpus_pipeline.near_dedup(spark, docs, DIR)
    assert sorted(r["doc_id"] for r in kept.collect()) == survivors([(r["doc_id"], r["text"]) for r in rows])

    items = [(r["item_id"], r["text"]) for r in table(spark, DIR, "benchmark").collect()]
    shared = {" ".join(w[i : i + 5]) for _, t in items for w in [re.findall(r"[^\W_]+", t.lower())] for i in range(len(w) - 4)}
    near = [(r["doc_id"], r["text"]) for r in rows if r["text"] and any(" ".join(w[i : i + 5]) in shared for w in [re.findall(r"[^\W_]+", r["text"].lower())] for i in range(len(w) - 4))]
    bad = {d for d, _ in brute_leaks(near, items)}
    assert bad and {r["doc_id"] for r in corpus_pipeline.decontaminate(spark, docs, DIR).collect()} == {r["doc_id"] for r in rows} - bad

    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_report(docs).collect()}
    words = dict.fromkeys(taken, 0)
    for r in corpus_pipeline.mix_sources(spark, docs, DIR).collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert words == taken

    slots = sharding.fill(sharding.shard_names(sharding.SHARDS))
    for r in corpus_pipeline.shard(spark, docs, DIR).collect():
        slot = int(hashlib.md5(f"shard|{r['doc_id']}".encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert (r["slot"], r["shard"]) == (slot, slots[slot])


def test_quality_stage_against_its_model(spark):
    """The model's ratios and the verdicts, recomputed one document at a time."""
    import numpy as np

    from framelake.llm import quality

    docs, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    model = quality.fit(docs, labels)
    rows = docs.collect()
    raw = np.zeros(quality.BUCKETS)
    for r in rows:
        np.add.at(raw, quality.ngram_buckets(quality.word_hashes((r["text"] or "").encode())), 1)
    q = np.log((raw + 1) / (raw + 1).sum())
    # p = ratios + q must be a multinomial whose counts are whole and at most the corpus's
    p = np.exp(model.ratios + q)
    counts = p / p.min() - 1
    assert abs(p.sum() - 1) < 1e-9 and (counts < raw + 1e-3).all() and np.allclose(counts, counts.round(), atol=1e-3)
    want = set()
    for r in rows:
        h = quality.word_hashes((r["text"] or "").encode())
        failed = quality.base_stats(r["text"] or "", (r["text"] or "").encode(), h)[-1]
        if not failed and model.ratios[quality.ngram_buckets(h)].mean() >= model.threshold:
            want.add(r["doc_id"])
    assert want and {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, DIR).collect()} == want
