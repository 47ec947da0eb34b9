"""Near-dedup by wide fingerprints, against all pairs of exact 5-word similarities."""

import itertools
import random

import numpy as np
import pytest

from framelake.llm import near_text
from framelake.llm.common import table

DIR = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def survivors(rows):
    """ids that name their group, where groups are what pairs of texts with a similarity of 0.8 join; no words: one group."""
    sets = {i: shingles(t) for i, t in rows}
    name = {i: i for i in sets}

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or (both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)):
            p, q = sorted((root(a), root(b)))
            name[q] = p
    return sorted(i for i in name if name[i] == i)


def family(rng, at, n, length, changes):
    """n texts, each a base with words exchanged at random places."""
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    for i in range(n):
        words = list(base)
        for place in rng.sample(range(length), changes):
            words[place] = f"x{rng.randrange(10**9)}"
        yield at + i, " ".join(words)


def test_stage_keeps_one_of_each_group(spark):
    rng = random.Random(7)
    rows = [(i, t) for i, t in enumerate([None, "", " \t", "one two", "ONE  two", "one two three", "one two three four five six"])]
    rows += family(rng, 100, 40, 400, 1)  # about 0.95 to each other
    rows += family(rng, 200, 40, 400, 4)  # about 0.82
    rows += family(rng, 300, 40, 300, 6)  # about 0.66, none is a copy
    rows += [(400 + i, f"Alone {i} " + " ".join(f"v{rng.randrange(5000)}" for _ in range(30))) for i in range(60)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r["doc_id"] for r in near_text.keep_one(docs).collect()) == survivors(rows)


def test_stage_on_the_tables(spark):
    docs = table(spark, DIR, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in near_text.keep_one(docs).collect()) == survivors(rows)


def test_distance_follows_similarity():
    rng = random.Random(3)
    for changes, low, high in ((1, 0, near_text.SURE), (5, near_text.SURE, near_text.UNSURE), (60, near_text.UNSURE, 600)):
        (_, a), (_, b) = family(rng, 0, 2, 400, changes)
        d = int.from_bytes(near_text.wide_fingerprint(a), "little") ^ int.from_bytes(near_text.wide_fingerprint(b), "little")
        assert low < d.bit_count() < high
    assert near_text.wide_fingerprint(None) == near_text.wide_fingerprint(" \n") == bytes(128)
    long = " ".join(f"w{i * i % 977}" for i in range(40_000))
    assert near_text.wide_fingerprint(long) == near_text.wide_fingerprint(long.replace(" ", "\t").upper())


@pytest.mark.parametrize("limits", [{}, {"MOST_DIRECT": 8, "WAITING": 4}, {"MOST_HELD": 16, "RUN": 8}, {"MOST_HELD": 16, "RUN": 8, "MOST_DIRECT": 5, "WAITING": 1}])
def test_variants_join_all_that_candidates_join(monkeypatch, limits):
    """Fingerprints in families, some variants over every limit: the parts are those of all pairs at candidates' distance."""
    import pyarrow as pa

    for name, value in limits.items():
        monkeypatch.setattr(near_text, name, value)
    rng = np.random.default_rng(11)
    bits = []
    for size, flips in ((60, 8), (30, 2), (7, 20), (1, 0), (1, 0), (2, 25)):
        base = rng.integers(0, 2, 256, dtype=np.uint8)
        for _ in range(size):
            own = base.copy()
            own[rng.choice(256, flips, replace=False)] ^= 1
            bits.append(own)
    fps = np.unique(np.packbits(np.array(bits), axis=1, bitorder="little").view("<u8"), axis=0)
    dealt = pa.Table.from_batches(near_text._deal(pa.Table.from_arrays([near_text._binary(fps)], ["fp"]).to_batches())).sort_by("variant")
    found = [(a, b) for batch in near_text._linked(iter(dealt.to_batches(max_chunksize=9))) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]

    def parts(pairs):
        name = {x.tobytes(): x.tobytes() for x in fps}

        def root(x):
            while name[x] != x:
                x = name[x]
            return x

        for a, b in pairs:
            p, q = sorted((root(a), root(b)))
            name[q] = p
        return {x: root(x) for x in name}

    near = [(a.tobytes(), b.tobytes()) for a, b in itertools.combinations(fps, 2) if np.bitwise_count(a ^ b).sum() <= near_text.DISTANCE]
    assert all(np.bitwise_count(np.frombuffer(a, "<u8") ^ np.frombuffer(b, "<u8")).sum() <= near_text.DISTANCE for a, b in found)
    assert parts(found) == parts(near)


def test_no_link_is_left_out(spark):
    """Pairs and families around a similarity of 0.8, and texts that differ in how often they repeat a line, as by all pairs."""
    rng = random.Random(5)
    rows = []
    for at in range(0, 1500, 10):
        rows += family(rng, at, 2, 400, 4)  # about 0.82
    for at in range(1500, 3000, 10):
        rows += family(rng, at, 6, 410 + at // 10 % 7, 5)  # about 0.78 to 0.81
    passage, line = " ".join(f"p{i}" for i in range(200)), " same old line of words here"
    rows += [(3000, passage + line), (3001, passage + line * 300)]
    rows += [(4000 + i, " ".join(f"q{i // 2}_{j}" for j in range(13 + i % 2))) for i in range(40)]  # 9 of 10 short shingles
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r["doc_id"] for r in near_text.keep_one(docs).collect()) == survivors(rows)


@pytest.mark.parametrize("limits", [{}, {"MOST_OFFSETS": 2, "BLOCK": 3}, {"MOST_OFFSETS": 2, "BLOCK": 3, "MOST_HELD": 8, "RUN": 4}])
@pytest.mark.parametrize("grouped", [False, True])
def test_sets_that_meet_hold_all_links(monkeypatch, limits, grouped):
    """Every link between groups is among the pairs, whatever the order of shingles and however many share one."""
    import pyarrow as pa

    for name, value in limits.items():
        monkeypatch.setattr(near_text, name, value)
    rng = np.random.default_rng(2)
    sets = []
    for n in (1, 2, 4, 5, 9, 20, 45, 90):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for _ in range(25):
            new = rng.integers(0, 1 << 63, rng.integers(0, n // 5 + 2), dtype=np.uint64)
            sets.append(np.unique(np.concatenate((rng.permutation(base)[rng.integers(0, n // 8 + 1) :], new))).astype("<u8"))
    flat = np.unique(np.concatenate(sets))
    known = np.sort(rng.choice(flat, 50, replace=False))
    root = np.arange(len(sets)) // (4 if grouped else 1) * 4
    place, token, n, left = near_text.prefixes(sets, (known, rng.integers(1, 9, len(known))))
    names = ["token", "s", "root", "n", "left"]
    dealt = pa.Table.from_arrays([pa.array(c) for c in (token.view("<i8"), place, root[place], n, left)], names).sort_by("token")
    met = pa.Table.from_batches(near_text._met(iter(dealt.to_batches(max_chunksize=3)))).to_pylist()
    found = {(r["a"], r["b"]) for r in met if r["token"] is None}
    many = [r | {"odd": near_text.odd_bits(sets[r["a"]])} for r in sorted((r for r in met if r["token"] is not None), key=lambda r: r["token"])]
    assert many or not limits
    if many:
        for batch in near_text._met_by_many(iter(pa.Table.from_pylist(many).to_batches(max_chunksize=3))):
            found |= set(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True))
    links = set()
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if root[a] != root[b] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            links.add((a, b))
    assert len(links) > 200 and links <= found and all(root[a] != root[b] for a, b in found)

def test_levels_are_those_of_all_sets():
    """Every shingle of two sets or more has its level, whatever the batches; one of a single set shares a place by chance only."""
    import pyarrow as pa

    rng = random.Random(9)
    texts = [t for at in range(0, 400, 10) for _, t in family(rng, at, 2 + at % 7, 60, 3)] + [None, ""]
    bits = 20
    dealt = [b for i in range(0, len(texts), 13) for b in near_text._dealt_shingles([pa.record_batch([pa.array(texts[i : i + 13], pa.string())], ["text"])])]
    rows = pa.Table.from_batches(dealt).sort_by("bucket")
    levels = np.zeros((1 << near_text.BUCKET_BITS, 1 << bits - near_text.BUCKET_BITS), np.uint8)
    for batch in near_text._levels(iter(rows.to_batches(max_chunksize=7)), bits):
        levels[batch.column("bucket")[0].as_py()] = np.frombuffer(batch.column("levels")[0].as_py(), np.uint8)
    levels = levels.reshape(-1)
    sets = [near_text.shingle_set(t) for t in texts]
    h, n = np.unique(np.concatenate(sets), return_counts=True)
    place = h >> np.uint64(64 - bits)
    assert (levels[place] >= np.floor(np.where(n > 1, 16 * np.log2(n), 0))).all()
    assert (levels > 0).sum() == len(np.unique(place[n > 1])) and 1000 < (n > 1).sum() < (n == 1).sum() * 10
    known, times = near_text.frequent_in(sets, levels)
    assert set(h[n > 1]) <= set(known) and (times > 0).all() and len(known) < 1.05 * (n > 1).sum()
    full = near_text.lowest_off(np.repeat(np.arange(1, 9, dtype=np.uint8), 10))
    assert (full > 0).sum() == 20 and set(full[full > 0]) == {7, 8}
    assert not near_text.lowest_off(np.ones(64, np.uint8)).any()


def test_pairs_do_not_grow_with_the_input(spark, monkeypatch):
    """Families that are alike but not linked do not meet, however many sets there are: a sample of 8,192 no longer told them apart."""
    rng, rows = random.Random(12), []
    for at in range(0, 24_000, 6):
        base = [f"w{rng.randrange(5000)}" for _ in range(60)]
        for i in range(6):
            words = list(base)
            for place in (rng.randrange(5, 15), rng.randrange(25, 35), rng.randrange(45, 55)):
                words[place] = f"x{rng.randrange(10**9)}"  # 15 of 56 shingles are the text's own, 12 are dealt
            rows.append((at + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made, write = {}, near_text.written

    def counted(df, label):
        table = write(df, label)
        made[label] = table.count()
        return table

    monkeypatch.setattr(near_text, "written", counted)
    near_text.keep_one(docs).count()
    assert made["sets"] == len(rows) and made["met"] < len(rows) // 10
