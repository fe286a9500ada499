"""Near duplicates by shingle sets against brute force."""

from __future__ import annotations

import random

import numpy as np

from tidemark.llm import neardup


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(texts):
    """The smallest position reachable from each over all pairs of similarity 0.8, and the number of such pairs."""
    sets = [plain_shingles(t) for t in texts]
    label, pairs = list(range(len(sets))), 0

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and len(a & b) * 5 >= len(a | b) * 4:
                pairs += 1
                low, high = sorted((root(i), root(j)))
                label[high] = low
    return [root(i) for i in range(len(sets))], pairs


def kept_ids(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r["doc_id"] for r in neardup.keep_one(docs).collect())


def test_cloud_and_chains_against_brute_force(spark):
    """A cloud around one text, chains of edits, texts that share a passage only, and odd ones."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(500)}"
    centre, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    texts = [None, "", " \n", "one", "One", "two words", "a b c d e", "a b c d e f"]
    for _ in range(60):
        edited = list(centre)
        for _ in range(rng.randrange(8)):
            edited[rng.randrange(120)] = word()
        texts.append(" ".join(edited))
    for _ in range(5):
        chain = [word() for _ in range(100)]
        for _ in range(6):
            texts.append(" ".join(chain))
            chain[rng.randrange(100)] = word()
            chain[rng.randrange(100)] = word()
    for n in range(20):
        texts.append(" ".join(passage + [word() for _ in range(3 * n)]))
    rng.shuffle(texts)
    label, pairs = components(texts)
    assert pairs > 100
    assert kept_ids(spark, texts) == [i for i, at in enumerate(label) if at == i]


def apart(a, b):
    bits = [np.unpackbits(neardup.sketch_of(x).view(np.uint8)).reshape(2, -1) for x in (a, b)]
    return (bits[0] != bits[1]).any(axis=0).sum()


def test_bands_and_sketches_find_pairs_at_the_least_similarity():
    """Sets of similarity 0.8 exactly: 3,000 pairs, all but a few share a band, and all are within the sketches' limit."""
    rng = np.random.default_rng(3)
    found = 0
    for at in range(3000):
        unit = (1, 10, 50)[at % 3]
        x = rng.integers(-(2**63), 2**63, 10 * unit)
        a, b = (neardup.minima_of(np.sort(s)) for s in (x[: 9 * unit], x[unit:]))  # 8 of 10 are common
        found += bool(np.isin(neardup.bands_of(a), neardup.bands_of(b)).any())
        assert apart(a, b) <= neardup.APART
    assert found >= 2985
    assert (neardup.minima_of(np.tile(x, 1000)) == neardup.minima_of(x)).all()


def test_sketches_tell_half_similar_sets_apart():
    rng = np.random.default_rng(4)
    sets = [rng.integers(-(2**63), 2**63, 300) for _ in range(500)]
    near = [apart(neardup.minima_of(x[:225]), neardup.minima_of(x[75:])) <= neardup.APART for x in sets]  # 150 of 300
    assert sum(near) <= 2


def test_finer_sketches_keep_pairs_at_the_least_similarity():
    """Of 300 pairs of similarity 0.8 exactly all are within the limit, of 300 pairs of 0.7 few."""
    rng = np.random.default_rng(6)
    near = {}
    for all_of, own in ((10, 1), (20, 3)):  # 8 of 10 and 14 of 20 units are common
        near[own] = 0
        for at in range(300):
            unit = (10, 40)[at % 2]
            x = rng.integers(-(2**63), 2**63, all_of * unit)
            a, b = (neardup.fine_sketch_of(np.sort(s)) for s in (x[: len(x) - own * unit], x[own * unit :]))
            near[own] += np.unpackbits((a ^ b).view(np.uint8)).sum() <= neardup.FINE_APART
    assert near[1] == 300
    assert near[3] <= 15


def test_table_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    label, pairs = components([r["text"] for r in rows])
    assert pairs > 50
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted(r["doc_id"] for r in neardup.keep_one(docs).collect()) == [rows[i]["doc_id"] for i, at in enumerate(label) if at == i]
