"""Suffix-array dedup and its sort against brute force."""

import hashlib
import itertools

import numpy as np
import pytest

from framelake.llm import suffix_dedup, suffix_sort

N = 50


def brute(rows):
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in texts:
        for a in range(len(b) - N + 1):
            s, k = b[a : a + N], float("inf") if i is None else i
            least[s] = min(least.get(s, k), k)
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for a in range(len(b) - N + 1):
            if least[b[a : a + N]] < (float("inf") if i is None else i):
                gone[a : a + N] = [True] * N
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (a == 0 or not gone[a - 1]) for a, g in enumerate(gone))
        out.append((-1 if i is None else i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:5]) for r in df.collect())


def brute_order(t, depth):
    """Suffixes by their first depth symbols, and common prefixes of neighbours."""
    key = [t[i : i + depth] for i in range(len(t))]
    order = sorted(range(len(t)), key=lambda i: t[i:])
    shared = [0]
    for a, b in itertools.pairwise(order):
        shared.append(next((k for k, (x, y) in enumerate(zip(key[a], key[b], strict=False)) if x != y), min(len(key[a]), len(key[b]))))
    return order, shared, [key[i] for i in order]


@pytest.mark.parametrize(("bands", "batch", "block", "limit", "waves", "mostly"), [(512, 1 << 19, 1 << 20, 1 << 26, 12, 0.5), (2, 7, 13, 64, 12, 1.0), (4, 3, 5, 1 << 20, 1, 1.0), (2, 1000, 1000, 128, 12, 1.0)])
def test_suffix_order(monkeypatch, bands, batch, block, limit, waves, mostly):
    """Random and periodic texts, with tiny batches, bands and memory, deep recursion, and every kind of queue."""
    for name, value in (("BANDS", bands), ("BATCH", batch), ("BLOCK", block), ("WAVES", waves), ("MOSTLY", mostly)):
        monkeypatch.setattr(suffix_sort, name, value)
    rng, spilled = np.random.default_rng(limit), 0
    for k in range(60):
        n, symbols = int(rng.integers(0, 180)), int(rng.integers(2, 9))
        some = rng.integers(1, symbols, n) if k % 3 else np.tile(rng.integers(1, symbols, int(rng.integers(1, 8))), 40)[:n]
        t = np.append(some, 0).astype(np.uint16)
        for depth in (len(t), int(rng.integers(1, 12))):
            scratch = suffix_sort.Scratch(limit)
            order, shared = suffix_sort.suffix_order(t, depth, scratch).arrays()
            want, want_shared, keys = brute_order(t.tolist(), depth)
            assert [t[i : i + depth].tolist() for i in order] == keys and shared.tolist() == want_shared
            assert depth < len(t) or order.tolist() == want
            spilled += scratch.spilled
    assert (spilled > 0) == (limit < 1000)


def test_a_shard_of_many_times_the_memory():
    """A text of 60 times the limit: queues, text and result lie in files."""
    rng = np.random.default_rng(4)
    words = [rng.integers(2, 30, 12) for _ in range(300)]
    t = np.append(np.concatenate([words[i] for i in rng.integers(0, 300, 5000)]), 0).astype(np.uint16)
    scratch = suffix_sort.Scratch(2000)
    order, shared = suffix_sort.suffix_order(t, 50, scratch).arrays()
    assert t.nbytes > 50 * scratch.limit and scratch.spilled > 10 * t.nbytes
    keys = [t[i : i + 50].tolist() for i in order]
    assert all(a <= b for a, b in itertools.pairwise(keys)) and sorted(order.tolist()) == list(range(len(t)))
    assert shared[1:].tolist() == [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in itertools.pairwise(keys)]


def made():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeüñ東\x00"), rng.integers(1, 7))) for _ in range(40)]
    say = lambda n: " ".join(rng.choice(words, n))
    passage, long = say(40), say(3000)
    rows = [(i, say(int(rng.integers(0, 80)))) for i in range(100, 130)]
    rows += [(i, say(20) + passage[i % 30 : 100 + i] + say(15)) for i in range(60)]
    rows += [(200 + i, rows[0][1]) for i in range(8)] + [(90, long), (300, long[500:9000]), (7, passage), (7, passage), (301, "a" * 2000), (302, "a" * 49), (303, "b" + "a" * 700), (304, "ab" * 400), (5, "ab" * 300)]
    rows += [(None, passage), (None, None), (400, None), (401, ""), (None, say(60)), (402, passage[:50]), (403, passage[3:52])]
    return rows


@pytest.mark.parametrize(("shard", "limit"), [(0, 1 << 26), (1 << 22, 1 << 26), (1 << 22, 500)])
def test_remove_repeats(spark, shard, limit):
    rows = made()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, chunk long, data long").repartition(5)
    assert rows_of(suffix_dedup.remove_repeats(docs, shard_bytes=shard, limit=limit)) == brute(rows)


def test_kept_text(spark):
    long = "".join(chr(97 + x) for x in np.random.default_rng(1).integers(0, 26, 120))
    docs = spark.createDataFrame([(1, long), (2, "x" + long + "y")], "doc_id long, text string")
    assert {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(docs, with_text=True).collect()} == {1: long.encode(), 2: b"xy"}


def test_empty(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_small_tables(spark):
    from framelake.llm.common import table
    from framelake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    assert rows_of(QUERIES["op1_suffix_dedup"](spark, sf)) == brute(rows)
