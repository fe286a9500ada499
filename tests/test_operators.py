"""Write modes, strategies, tables, evolution, partitions and quality on small frames."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import asof, evolution, load, partitions, quality, strategies, transform
from tidemark.operators.tables import StaleTableError, TableBusyError, VersionedTable


def frame(spark, data, schema="k int, v string"):
    return spark.createDataFrame(data, schema)


def test_upsert_updates_inserts_and_ignores_null_keys(spark, rows):
    target = frame(spark, [(1, "a"), (2, "b"), (None, "n")])
    source = frame(spark, [(2, "B"), (3, "c"), (None, "m"), (None, "m")])
    assert rows(load.upsert(target, source, ["k"])) == sorted([(1, "a"), (2, "B"), (3, "c"), (None, "n"), (None, "m"), (None, "m")], key=repr)
    assert rows(load.delete_insert(target, source, ["k"])) == rows(load.upsert(target, source, ["k"]))


def test_upsert_sets_null_from_the_source(spark, rows):
    assert rows(load.upsert(frame(spark, [(1, "a")]), frame(spark, [(1, None)]), ["k"])) == [(1, None)]


def test_upsert_of_fewer_columns_and_other_case(spark, rows):
    target = frame(spark, [(1, "a", 5)], "k int, v string, w int")
    assert rows(load.upsert(target, frame(spark, [(1, 6), (2, 7)], "K int, W int"), ["K"])) == [(1, "a", 6), (2, None, 7)]


def test_repeated_keys_are_an_error_without_an_order(spark, rows):
    source = frame(spark, [(1, "a"), (1, "b")])
    with pytest.raises(load.LoadError, match="more than once"):
        load.upsert(frame(spark, []), source, ["k"])
    assert rows(load.upsert(frame(spark, []), source, ["k"], order_by="v")) == [(1, "b")]


def test_all_faults_of_a_load_are_listed(spark):
    with pytest.raises(load.LoadError) as e:
        load.upsert(frame(spark, []), frame(spark, [], "k string, z int"), ["k", "q"])
    assert all(x in str(e.value) for x in ("'z' is not in the target", "different types", "'q' is not in the source"))


def test_append_casts_within_families(spark, rows):
    assert rows(load.append(frame(spark, [(1, "a")]), frame(spark, [(2,)], "k bigint"))) == [(1, "a"), (2, None)]
    with pytest.raises(load.LoadError):
        load.append(frame(spark, []), frame(spark, [], "k date"))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 5), st.text("ab", max_size=2)), st.dictionaries(st.integers(0, 5), st.text("ab", max_size=2)))
def test_upsert_is_dict_update_and_idempotent(spark, rows, a, b):
    target, source = frame(spark, list(a.items())), frame(spark, list(b.items()))
    once = load.upsert(target, source, ["k"])
    assert rows(once) == sorted(({**a, **b}).items(), key=repr)
    assert rows(load.upsert(once, source, ["k"])) == rows(once)


def test_modes_take_their_own_options_only():
    for bad in ({"name": "INCREMENTAL"}, {"name": "UPSERT"}, {"name": "REPLACE", "keys": ("a",)}, {"name": "APPEND", "lookback": "1 day"}, {"name": "MERGE"}):
        with pytest.raises(transform.ModeError):
            transform.Mode(**bad)
    assert transform.parse_lookback("2 DAYS") == timedelta(days=2)
    assert transform.parse_lookback("'36 hours'") == timedelta(hours=36)
    with pytest.raises(transform.ModeError):
        transform.parse_lookback("soon")


def test_macros_are_bound_outside_quotes(spark, rows):
    q = "SELECT @start_date AS a, @ end_dt AS b, '@start_date' AS c -- @end_date"
    assert rows(transform.run_with_range(spark, q, datetime(2024, 1, 2, 3), datetime(2024, 1, 5))) == [("2024-01-02", "2024-01-05", "@start_date")]


def test_incremental_keeps_null_times_and_is_a_rebuild(spark, rows):
    schema = "ts timestamp_ntz, v int"
    target = frame(spark, [(None, 0), (datetime(2024, 1, 1), 1), (datetime(2024, 1, 2), 2)], schema)
    fresh = frame(spark, [(None, 9), (datetime(2024, 1, 2), 3), (datetime(2024, 1, 3), 4)], schema)
    out = transform.incremental(target, fresh, "ts", datetime(2024, 1, 2), datetime(2024, 1, 3))
    assert rows(out.select("v")) == [(0,), (1,), (3,)]
    assert rows(transform.incremental(out, fresh, "ts", datetime(2024, 1, 2), datetime(2024, 1, 3))) == rows(out)


def test_changes_apply_by_last_event(spark, rows):
    target = frame(spark, [(1, "a"), (2, "b"), (3, "c")])
    events = frame(spark, [(1, "x", "D", 1), (1, "y", "I", 2), (2, None, "D", 1), (4, "d", "I", 1), (3, "C", "U", 1), (3, "?", "?", 9)], "k int, v string, op string, ts int")
    assert rows(strategies.apply_changes(target, events, ["k"]).select("k", "v")) == [(1, "y"), (3, "C"), (4, "d")]


def test_conflict_rules(spark, rows):
    target = frame(spark, [(1, "a", 5), (2, "b", 5), (3, "c", None)], "k int, v string, at int")
    source = frame(spark, [(1, "A", 4), (2, "B", 5), (3, "C", 1), (4, "D", 1)], "k int, v string, at int")
    by = lambda rule: [r[2] for r in sorted(rows(strategies.upsert_with(target, source, ["k"], rule, "at").select("k", "at", "v")), key=lambda r: r[1])]
    assert by("source_wins") == ["A", "B", "C", "D"]
    assert by("target_wins") == ["a", "b", "c", "D"]
    assert by("latest_wins") == ["a", "B", "C", "D"]
    with pytest.raises(strategies.ConflictError):
        by("manual")


def test_versions_switch_and_roll_back(spark, tmp_path, rows):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None and not t.exists()
    t.replace(frame(spark, [(1, "a")]), {"c": "1"})
    t.replace(t.read().union(frame(spark, [(2, "b")])), {"c": "2"})
    assert rows(t.read()) == [(1, "a"), (2, "b")] and t.cursors() == {"c": "2"}
    assert rows(t.rollback()) == [(1, "a")] and t.cursors() == {"c": "1"}
    with pytest.raises(ValueError, match="no earlier"):
        t.rollback()
    for n in range(4):
        t.replace(frame(spark, [(n, "x")]))
    assert len(list((tmp_path / "t").glob("v*"))) == 2
    (tmp_path / "t/_lock").touch()
    with pytest.raises(TableBusyError):
        t.replace(frame(spark, []))
    t.unlock()
    t.replace(frame(spark, []))


def test_no_write_is_lost(spark, tmp_path, rows):
    one, two = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    one.append(frame(spark, [(1, "a")]))
    seen_by_one, seen_by_two = one.read(), two.read()
    one.replace(load.append(seen_by_one, frame(spark, [(2, "b")])))
    with pytest.raises(StaleTableError):
        two.replace(load.append(seen_by_two, frame(spark, [(3, "c")])))
    two.append(frame(spark, [(3, "c")]))
    assert rows(one.read()) == [(1, "a"), (2, "b"), (3, "c")]
    with one.writing(), pytest.raises(TableBusyError):
        two.append(frame(spark, [(4, "d")]))


def _files(path):
    return {str(f): f.stat().st_mtime_ns for f in path.glob("v*/**/*.parquet")}


def test_only_touched_files_are_written(spark, tmp_path, rows):
    t = VersionedTable(spark, str(tmp_path / "t"), keep=10)
    for k in (0, 10, 20):
        t.append(spark.range(k, k + 10, 1, 2).select(F.col("id").cast("int").alias("k"), F.lit("old").alias("v")), lambda written: {"rows": str(written.count())})
    before = _files(tmp_path / "t")
    assert len(before) == 6 and t.cursors() == {"rows": "10"}
    t.upsert(frame(spark, [(3, "new"), (40, "new"), (None, "none")], "K bigint, v string"), ["K"], cursors=lambda written: {"max": str(written.agg(F.max("k")).first()[0])})
    assert {k: v for k, v in _files(tmp_path / "t").items() if k in before} == before
    current = t._state()["versions"][-1]["parts"]
    assert [len(p["files"] or t._files(p["folder"])) for p in current[:-1]] == [1, 2, 2] and t.cursors()["max"] == "40"
    assert rows(t.read().filter("v <> 'old'")) == sorted([(3, "new"), (40, "new"), (None, "none")], key=repr) and t.read().count() == 32
    t.delete_insert(frame(spark, [(3, "x"), (3, "y")]), ["k"])
    assert rows(t.read().filter("k = 3")) == [(3, "x"), (3, "y")]
    t.compact()
    assert len(t._state()["versions"][-1]["parts"]) == 1 and t.read().count() == 33
    assert t.rollback().count() == 33 and t.rollback().filter("k = 3").count() == 1
    t.reset_cursors("max")
    assert t.cursors() == {"rows": "10"}
    t.reset_cursors()
    assert t.cursors() == {}


def test_partitioned_tables_are_rewritten_by_file(spark, tmp_path, rows):
    t = VersionedTable(spark, str(tmp_path / "t"))
    days = frame(spark, [(1, "2024-01-01 10:00"), (2, "2024-01-02 10:00"), (3, "a b")], "k int, day string")
    t.replace(days, partition_by=["day"])
    t.append(frame(spark, [(4, "2024-01-02 10:00")], "k int, day string"))
    t.upsert(frame(spark, [(2, "2024-01-01 10:00")], "k int, day string"), ["k"])
    assert sorted((r["k"], r["day"]) for r in t.read().collect()) == [(1, "2024-01-01 10:00"), (2, "2024-01-01 10:00"), (3, "a b"), (4, "2024-01-02 10:00")]
    assert rows(t.read().filter("day = '2024-01-01 10:00'").select("k")) == [(1,), (2,)]


def test_ties_do_not_depend_on_row_order(spark, rows):
    data = [(1, "a", 5), (1, "b", 5), (1, "c", 4)]
    found = {tuple(rows(load.latest(frame(spark, part, "k int, v string, at int"), ["k"], "at"))) for part in (data, data[::-1])}
    assert len(found) == 1 and next(iter(found))[0][2] in "ab"
    events = [(1, "x", "I", 1), (1, "y", "D", 1)]
    for part in (events, events[::-1]):
        assert rows(strategies.apply_changes(frame(spark, [(1, "a")]), frame(spark, part, "k int, v string, op string, ts int"), ["k"])) == []


def test_schema_evolution(spark, rows):
    old = T.StructType.fromDDL("a int, b date, c string, d decimal(5,2)")
    assert evolution.diff(old, T.StructType.fromDDL("A bigint, b timestamp, c string, d decimal(7,3), e int")).verdict == "REQUIRES_MIGRATION"
    assert evolution.diff(old, old).verdict == "COMPATIBLE"
    bad = evolution.diff(old, T.StructType.fromDDL("a smallint, b string, c string"))
    assert (bad.narrowed, bad.incompatible, bad.removed, bad.verdict) == (["a"], ["b"], ["d"], "INCOMPATIBLE")
    with pytest.raises(ValueError, match="narrowed"):
        evolution.evolve(frame(spark, [], "a int"), T.StructType.fromDDL("a smallint"))
    assert rows(evolution.evolve(frame(spark, [(1,)], "a int"), T.StructType.fromDDL("a bigint, z int"))) == [(1, None)]


def test_partitions(spark):
    found = partitions.by_name("t", ["t_p_20240229", "t_p_202402", "t_p_2024", "t_p_20240230", "x_p_2024", "t_p_9"])
    assert found["t_p_202402"] == partitions.TimeRange(datetime(2024, 2, 1), datetime(2024, 3, 1)) and len(found) == 3
    paths = partitions.by_path(["/a/year=2024/month=12/x", "/a/dt=2024-01-05/x", "/a/20240105.parquet", "/a/none"])
    assert [r.name("month") for r in paths.values()] == ["202412", "202401", "202401"]
    assert paths["/a/year=2024/month=12/x"].end == datetime(2025, 1, 1)
    with pytest.raises(ValueError, match="none of"):
        partitions.virtual(spark.range(1), "id", "eon")


def test_quality_of_empty_and_odd_tables(spark):
    rules = quality.null_rate("v"), quality.duplicate_rate("k"), quality.freshness_hours("at", datetime(2024, 1, 2)), quality.negative_rate("k")
    v = quality.Validator(*rules)
    empty = {r["rule"]: r["passed"] for r in v.results(frame(spark, [], "k int, v string, at timestamp_ntz")).collect()}
    assert empty == {"null_check_v": True, "duplicate_check_k": True, "data_freshness_at": False, "negative_values_k": True}
    v.enable("data_freshness_at", False)
    v.remove("negative_values_k")
    v.add(quality.Rule("big", F.max("k"), 1, severity="critical"))
    one = v.score(frame(spark, [(1, None, None), (1, "x", None), (3, "y", None)], "k int, v string, at timestamp_ntz")).first()
    assert (one["passed"], one["failed"], one["score"]) == (0, 3, 0.0)
    assert quality.load_passes(0.9, 0) and not quality.load_passes(0.9, 1)


def test_partition_suggestions():
    first = datetime(2024, 1, 1)
    found = [partitions.suggest(rows, first, first + timedelta(days=span), days, months) for rows, span, days, months in ((99_999, 5, 5, 1), (200_000, 30, 12, 1), (200_000, 200, 52, 7), (200_000, 200, 53, 7), (200_000, 366, 9, 4), (200_000, 5000, 4000, 160))]
    assert [(f.granularity, f.parts, f.virtual) if f else None for f in found] == [None, ("day", 12, False), ("day", 52, False), ("week", 28, False), ("month", 4, False), ("month", 160, True)]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2]), st.one_of(st.none(), st.integers(0, 40))), max_size=12), st.lists(st.tuples(st.sampled_from([None, 1, 3]), st.one_of(st.none(), st.integers(0, 40))), max_size=12))
def test_as_of_join(spark, left, right):
    at = lambda t: None if t is None else datetime(2024, 1, 1) + timedelta(minutes=t)
    a = spark.createDataFrame([(i, k, at(t)) for i, (k, t) in enumerate(left)], "i int, k int, t timestamp_ntz")
    b = spark.createDataFrame([(k, at(t), n) for n, (k, t) in enumerate(right)], "k int, t timestamp_ntz, n int")
    got = {r["i"]: (r["right"]["t"], r["right"]["n"]) if r["right"] else None for r in asof.as_of(a, b, ["k"], "t", slices=3).collect()}
    fits = lambda k, t: [(at(u), n) for n, (j, u) in enumerate(right) if k is not None and t is not None and j == k and u is not None and u <= t]
    assert got == {i: max(fits(k, t), default=None) for i, (k, t) in enumerate(left)}


def test_as_of_join_far_from_a_single_row(spark):
    """A key with one right row, or several within microseconds, has left rows hours to centuries away."""
    at = lambda **k: datetime(2024, 1, 1) + timedelta(**k)
    times = [at(days=-1), at(minutes=-36), at(), at(microseconds=3), at(hours=1), at(days=30), datetime(1, 1, 1), datetime(9999, 12, 31)]
    a = spark.createDataFrame([(i, k, t) for k in (1, 2) for i, t in enumerate(times)], "i int, k int, t timestamp_ntz")
    b = spark.createDataFrame([(1, at(), 7), (2, at(), 8), (2, at(microseconds=3), 9)], "k int, t timestamp_ntz, n int")
    got = {(r["k"], r["i"]): r["right"] and r["right"]["n"] for r in asof.as_of(a, b, ["k"], "t").collect()}
    assert [got[1, i] for i in range(8)] == [None, None, 7, 7, 7, 7, None, 7]
    assert [got[2, i] for i in range(8)] == [None, None, 8, 9, 9, 9, None, 9]
