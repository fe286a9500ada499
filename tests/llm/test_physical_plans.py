"""Operators that are maps over rows must not move them, and native ones must not run Python."""

from __future__ import annotations

import re

import pytest

from tidemark.llm import catalog, decontaminate, licenses, pii

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_maps_have_no_exchange(spark):
    docs = catalog.documents(spark, DATA).select("doc_id", "text")
    outs = [licenses.scan_licences(docs), pii.find(docs, pii.fit(docs)), decontaminate.decontaminate(docs, spark.read.parquet(f"{DATA}/benchmark.parquet"))]
    assert not any("Exchange" in plan(out) for out in outs)


@pytest.mark.parametrize("name", ["op2_licences", "op5_line_runs", "op8_pii"])
def test_native_queries_run_no_python(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(catalog.QUERIES[name](spark, DATA)))
