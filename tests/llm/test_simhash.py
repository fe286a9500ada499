"""SimHash links and components against brute force."""

from __future__ import annotations

import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import graph, simhash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text("aB é\t\n\u2003\x0b", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint_of(text) % (1 << 64) == plain_fingerprint(text)


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefgh", k=500))
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint_of(text) % (1 << 64) == plain_fingerprint(text)


def components(fps):
    """The smallest position reachable from each, over all pairs."""
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    return label


@pytest.mark.parametrize("pair_limit", [256, 2])
def test_links_connect_what_all_pairs_connect(spark, pair_limit):
    """A cloud of close values, chains, and values apart; with a limit of 2 nearly all go the other exact way."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(25)]
    fps += [rng.getrandbits(64) for _ in range(5)] + [0, 3, 15, 63, (1 << 64) - 1, 1 << 63]
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), pair_limit).collect()
    for r in found:
        assert ((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 2
    at = {s: i for i, s in enumerate(signed)}
    links = spark.createDataFrame([(at[r["a"]], at[r["b"]]) for r in found], "u long, v long")
    named = {r["node"]: r["component"] for r in graph.connected_components(links).collect()}
    assert [named.get(i, i) for i in range(len(fps))] == components(fps)


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 120)] + [(200, 201), (201, 202), (202, 200)] + [(5, 5), (None, 7), (31, 2), (2, 31)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 32)}, **{i: 100 for i in range(101, 120)}, 201: 200, 202: 200}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(spark):
    """Null, empty and wordless texts link at zero; repeated rows stay; ids may be null; other columns don't matter."""
    data = [(5, None, "x"), (3, "", "x"), (4, " \n", "y"), (9, "one two three four", "z"), (7, "ONE two\tthree four", "z"), (9, "one two three four", "z"), (None, "one two three four", None), (2, "quite another text here", "w")]
    docs = spark.createDataFrame(data, "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(5, 3), (3, 3), (4, 3), (9, 7), (7, 7), (9, 7), (None, 7), (2, 2)], key=repr)
    kept = simhash.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 7] and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "d e f g")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(twice).collect()) == [1, 2]


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    expected = components([plain_fingerprint(r["text"]) for r in rows])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert [got[r["doc_id"]] for r in rows] == [rows[i]["doc_id"] for i in expected]


def test_null_and_repeated_ids_are_judged_by_their_texts(spark):
    """Different texts stay though their ids are null or repeated; near copies of such rows go."""
    data = [(None, "a clean text about rivers"), (None, "another one on mountains here"), (None, "a clean text about rivers"), (4, "words of the fourth"), (4, "something else with that id")]
    kept = simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted(set(data), key=repr)


def test_chain_through_null_id(spark, monkeypatch):
    """Fingerprints 0, 3 and 15 are a chain whose middle has only a null id."""
    monkeypatch.setattr(simhash, "fingerprint", lambda text, shingle=3: text.cast("long"))
    docs = spark.createDataFrame([(8, "0"), (None, "3"), (9, "15"), (None, "255")], "doc_id long, text string")
    got = {r["fp"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == {0: 8, 3: 8, 15: 8, 255: None}
    assert sorted(r["text"] for r in simhash.keep_one(docs).collect()) == ["0", "255"]


def test_variants_are_never_broadcast(spark, monkeypatch):
    """Statistics leave out that 64 rows come of a fingerprint; all of them would pass through the driver."""
    plans = {}

    def seen(df, name, path=None):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name, path)

    written = simhash.written
    monkeypatch.setattr(simhash, "written", seen)
    simhash.links(written(spark.range(3000).selectExpr("xxhash64(id) AS fp"), "fps")).count()
    assert "SortMergeJoin" in plans["buckets"] and "Broadcast" not in plans["buckets"]
