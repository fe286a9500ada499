"""The five stages on the smallest tables, and each query against its SQL."""

from __future__ import annotations

import hashlib
import random

import duckdb
import pytest

import corpus_pipeline
from tests.conftest import plain
from tests.llm.test_neardup import components
from tests.llm.test_text_operators import brute, plain_budgets, plain_dedup
from tidemark.llm import catalog, langid, neardup, simhash

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, rows):
    got = catalog.QUERIES[name](spark, DATA)
    if name not in catalog.ORACLES:
        assert got.count() > 0
        return
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = c.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(range(len(names)), key=names.__getitem__)
    assert rows(got) == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


def test_stages(spark):
    docs = catalog.documents(spark, DATA)
    seen = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        path = corpus_pipeline.written(out, f"test-{name}")
        now = {r["doc_id"] for r in path.collect()}
        assert now and now <= seen, name
        docs, seen = path, now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r["doc_id"] for r in last.collect()} <= seen


def test_pipeline_against_brute_force(spark):
    """Every stage done again in plain Python on whole texts; only which language wins is taken from the operator, and its accuracy is tested apart."""
    docs = catalog.documents(spark, DATA)
    predicted = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    kept = {r["doc_id"]: (r["text"], predicted[r["doc_id"]], r["source"]) for r in docs.orderBy("doc_id").collect() if any(map(str.isalpha, r["text"] or ""))}
    gone = plain_dedup([(i, t) for i, (t, _, _) in kept.items()], 50)
    for i, lines in gone.items():
        if lines:
            text = "\n".join(s for at, s in enumerate(kept[i][0].split("\n")) if at not in lines)
            kept[i] = (text, *kept[i][1:])
    kept = {i: v for i, v in kept.items() if not gone[i] or v[0].split()}
    ids = sorted(kept)
    label, _ = components([kept[i][0] for i in ids])
    kept = {i: kept[i] for at, i in enumerate(ids) if label[at] == at}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for i in list(kept):
        n, hit, _ = brute(kept[i][0], items)
        if hit and 20 * hit >= n:
            del kept[i]
    domain = lambda s: list(catalog.MIX_WEIGHTS["domain"])[int(hashlib.md5((s or "").encode()).hexdigest()[:4], 16) % 3]
    leaves = {}
    for i, (text, lang, source) in kept.items():
        if text.split():
            leaves.setdefault((domain(source), lang, source), []).append((i, len(text.split())))
    totals = {k: sum(n for _, n in v) for k, v in leaves.items()}
    budgets = plain_budgets(totals, catalog.MIX_WEIGHTS, sum(totals.values()), 4)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(got) <= set(kept)
    assert all(r["text"] == kept[i][0] and r["n_chars"] == len(r["text"]) for i, r in got.items())
    for leaf, members in leaves.items():
        used = sum(n * (got[i]["copies"] if i in got else 0) for i, n in members)
        assert budgets[leaf] - max(n for _, n in members) - 3 <= used <= budgets[leaf] + 3


def test_no_documents(spark):
    docs = catalog.documents(spark, DATA).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_near_duplicates_takes_simhash_classes(spark, monkeypatch):
    """Without any MinHash band a near copy within two bits goes; one within two bits that whole texts refute stays."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(800)]
    edits = (words[:at] + ["other"] + words[at + 1 :] for at in range(800))
    apart = lambda a, b: ((simhash.fingerprint_of(a) ^ simhash.fingerprint_of(b)) % (1 << 64)).bit_count()
    near = next(t for e in edits if apart(t := " ".join(e), " ".join(words)) <= 2)
    hot = [f"c{n}" for n in range(21)] * 100
    far = [" ".join(hot + [f"{tail}{n}" for n in range(20)]) for tail in "xy"]
    assert apart(*far) <= 2
    pairs = neardup.near_pairs
    monkeypatch.setattr(neardup, "near_pairs", lambda bands, *more: pairs(bands.limit(0), *more))
    docs = spark.createDataFrame([(2, " ".join(words)), (1, near), (3, far[0]), (4, far[1]), (None, "a text apart from all"), (None, None)], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [1, 3, 4, None, None]
