"""Licences, decontamination, line dedup, mixing and language ID."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, licenses, linededup, mixing
from tidemark.llm.text import sampled

DOC = "doc_id long, text string, lang string, source string, n_chars long"


# Licences
def test_licence_units(spark):
    mit = licenses.TEMPLATES[-4][1]
    long = "word " * 5000
    texts = [None, "", "x", "Released under the MIT license!", "a b c\n\n" + mit.replace(", ", ",\n") + "\n\nmore", long, "released under THE mit License released under the mit license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: sorted((m["license"], m["unit"], m["at"]) for m in r["licence_matches"]) for r in licenses.scan_licences(docs).collect()}
    assert found[3] == [("MIT", "line", 0)]
    assert found[4] == [("MIT", "paragraph", 1)]
    assert found[6] == [("MIT", "line", 0)] and all(found[i] == [] for i in (0, 1, 2, 5))
    assert licenses.scan_licences(docs.withColumn("licence_matches", F.lit(1)).limit(0)).count() == 0


# Decontamination
def brute(text, items, window=13):
    words = decontaminate.words_of(text)
    hit, names = set(), set()
    for name, item in items:
        w = decontaminate.words_of(item)
        k = min(window, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            for at in range(len(words) - k + 1):
                if words[at : at + k] == w[s : s + k]:
                    hit |= set(range(at, at + k))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab A.", max_size=60), min_size=1, max_size=4), st.text("ab A.", max_size=120), st.integers(1, 6))
def test_wu_manber_against_comparison(items, text, window):
    named = tuple(enumerate(items))
    n, spans, found = decontaminate.search(text, decontaminate._searchers(named, window))
    covered = sum(b - a for a, b in zip(spans[::2], spans[1::2], strict=True))
    assert (n, covered, sorted(map(str, found))) == brute(text, named, window)


@pytest.mark.parametrize("max_bytes", [1 << 20, 60])
def test_contamination_in_shards(spark, max_bytes):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([2, 5, 13, 20])))) for i in range(6)] + [(None, "w1 w2 w3 w4"), (7, None), (8, "..."), (1, "w9 w9 w9")]
    texts = [None, "", "W1, w2; w3 W4 é"] + [" ".join(rng.choices(words, k=40)) + " " + (i[1] or "") + " tail" for i in items]
    docs = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], "doc_id long, text string, contamination string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.decontaminate(docs, bench, max_bytes=max_bytes).collect():
        n, hit, _ = brute(texts[r["doc_id"]], items)
        names = brute(texts[r["doc_id"]], [i for i in items if i[0] is not None])[2]
        c = r["contamination"]
        assert (c["n_words"], c["n_hit"], list(c["items"]), c["contaminated"]) == (n, hit, names, hit > 0 and 20 * hit >= n)
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    clean = decontaminate.decontaminate(docs, bench.limit(0)).select("contamination.*").agg(F.max("n_hit"), F.count_if("contaminated")).first()
    assert tuple(clean) == (0, 0)


# Line dedup
def plain_dedup(docs, least):
    """Deleted lines by comparing every run of lines with all earlier places."""
    solid = [(d, [(at, s) for at, s in enumerate((t or "").split("\n")) if s.split()]) for d, t in docs]
    first, gone = {}, {d: set() for d, _ in docs}
    spans = {}
    for d, lines in solid:
        counts = [len(s.split()) for _, s in lines]
        found = set()
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += counts[b]
                if total >= least:
                    found.add((a, b))
                    break
        for b in range(len(lines)):
            total = 0
            for a in range(b, -1, -1):
                total += counts[a]
                if total >= least:
                    found.add((a, b))
                    break
        spans[d] = sorted(found)
    for d, lines in solid:
        for a, b in spans[d]:
            key = "\n".join(s for _, s in lines[a : b + 1])
            first.setdefault(key, (d, a, b))
    for d, lines in solid:
        for a, b in spans[d]:
            key = "\n".join(s for _, s in lines[a : b + 1])
            d0, a0, b0 = first[key]
            if (d, a) != (d0, a0):
                for i in range(max(a, b0 + 1) if d == d0 else a, b + 1):
                    gone[d].add(lines[i][0])
    return {d: sorted(g) for d, g in gone.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_runs_against_comparison(spark, seed):
    rng = random.Random(seed)
    lines = ["a", "b c", "d e f", "", " ", "g h i j k", "l " * 9]
    docs = [(n, "\n".join(rng.choices(lines, k=rng.randrange(0, 12)))) for n in range(14)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: list(r["deleted"]) for r in linededup.dedup_lines(df, min_words=8).collect()}
    assert got == plain_dedup(docs, 8)


def test_line_runs_odd_rows(spark):
    run = "one two three\nfour five six seven"
    docs = [(1, None), (2, ""), (3, f"x\n{run}"), (3, f"x\n{run}"), (4, f"{run}\n\ny"), (None, run), (5, f"{run}\n{run}")]
    df = spark.createDataFrame([(d, t, "e", "g") for d, t in docs], "doc_id long, text string, deleted string, _gone string")
    out = linededup.dedup_lines(df, min_words=7)
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], list(r["deleted"])) for r in out.collect()), key=repr)
    assert got == sorted([(1, None, 0, []), (2, "", 1, []), (3, f"x\n{run}", 3, []), (3, f"x\n{run}", 3, []), (4, "\ny", 4, [0, 1]), (None, "", 2, [0, 1]), (5, "", 4, [0, 1, 2, 3])], key=repr)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


# Mixing
def plain_budgets(leaves, weights, total, epochs):
    """Water-filling by bisection of the level, top down."""
    out = {}

    def share(prefix, budget, depth):
        if depth == 3:
            out[prefix] = budget
            return
        children = sorted({p[: depth + 1] for p in leaves if p[:depth] == prefix})
        cap = {c: sum(t for p, t in leaves.items() if p[: depth + 1] == c) * epochs for c in children}
        w = {c: weights.get(mixing.LEVELS[depth], {}).get(c[-1], 1.0) for c in children}
        budget = min(budget, sum(cap.values()))
        low, high = 0.0, 1e12
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(cap[c], w[c] * mid) for c in children) < budget else (low, mid)
        for c in children:
            share(c, min(cap[c], w[c] * high), depth + 1)

    share((), total, 0)
    return out


def test_budgets_against_bisection(spark):
    rng = random.Random(9)
    leaves = {(d, lang, f"s{k}"): rng.randrange(10, 1000) for d in "xyz" for lang in ("en", "de") for k in range(rng.randrange(1, 4))}
    weights = {"domain": {"x": 5.0, "y": 1.0, "z": 0.2}, "lang": {"en": 3.0}}
    df = spark.createDataFrame([(*k, t) for k, t in leaves.items()], "domain string, lang string, source string, tokens long")
    for total in (100, 3000, 10**7):
        got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(df, weights, total, 2).collect()}
        expected = plain_budgets(leaves, weights, total, 2)
        assert all(abs(got[k] - expected[k]) <= 3 for k in leaves), total


def test_mix_takes_prefixes_of_seeded_epochs(spark):
    rng = random.Random(4)
    data = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 30))), rng.choice(["en", "de"]), rng.choice(["a", "a", "a", "b", None]), 0) for i in range(400)]
    data += [(900, None, "en", "a", 0), (901, " ", "en", "a", 0)]
    docs = spark.createDataFrame(data, DOC).withColumns({c: F.lit("clash") for c in ("tokens", "copies", "_key", "_p_lang", "cut", "rest")})
    out = mixing.mix(docs, F.lit("d"), {"lang": {"en": 1.0, "de": 4.0}}, total=4000, max_epochs=3, seed=1).collect()
    leaves = {}
    for i, text, lang, source, _ in data:
        if text and text.split():
            leaves.setdefault(("d", lang, source or ""), []).append((i, len(text.split())))
    budgets = plain_budgets({k: sum(n for _, n in v) for k, v in leaves.items()}, {"lang": {"en": 1.0, "de": 4.0}}, 4000, 3)
    copies = {r["doc_id"]: r["copies"] for r in out}
    for leaf, members in leaves.items():
        whole = sum(n for _, n in members)
        used = sum(n * copies.get(i, 0) for i, n in members)
        longest = max(n for _, n in members)
        assert budgets[leaf] - longest - 3 <= used <= budgets[leaf] + 1
        epochs = int((budgets[leaf] + 0.5) // whole)
        order = sorted(members, key=lambda m: hashlib.md5(f"1:{epochs}:{m[0]}".encode()).hexdigest())
        taken = [copies.get(i, 0) - epochs for i, _ in order]
        assert taken == sorted(taken, reverse=True) and set(taken) <= {0, 1}
    assert 900 not in copies and 901 not in copies
    assert mixing.mix(docs.limit(0), F.lit("d"), {}).count() == 0


# Language ID
def test_codewords_are_apart():
    for n in (1, 2, 4, 6, 9, 40):
        m = langid.codewords(n)
        assert m.shape[0] == n and (n == 1 or min((m[i] != m[j]).sum() for i in range(n) for j in range(i)) >= 1)
    assert min((langid.codewords(20)[i] != langid.codewords(20)[j]).sum() for i in range(20) for j in range(i)) >= 12


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=60))
def test_codes_do_not_depend_on_blocks(text):
    whole = np.sort(np.concatenate([*langid.codes(text), np.array([], int)]))
    before, langid.BLOCK = langid.BLOCK, 5
    try:
        assert (np.sort(np.concatenate([*langid.codes(text), np.array([], int)])) == whole).all()
    finally:
        langid.BLOCK = before


def test_samples_are_bounded_where_texts_are_copies(spark):
    copies = spark.range(40_000).withColumn("text", F.lit("one text"))
    n = lambda share: copies.filter(sampled(F.lit(share), 7, F.col("id"), F.col("text"))).count()
    assert 320 < n(0.01) < 480
    assert n(1.0) == 40_000 and n(0.0) == 0 and n(1e-9) == 0


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "", None, "s", 0), (10_003, "12 !?", "xx", "s", 0), (None, "the and of", None, None, None)], DOC)
    out = langid.identify(docs.union(odd)).collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] < 10_000]
    assert len(held) > 200 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    by = {r["doc_id"]: r for r in out}
    assert [by[i]["lang_pred"] for i in (10_001, 10_002, 10_003)] == ["und"] * 3 and by[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in out)
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0
