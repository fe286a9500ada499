"""Variables, conditions and pipelines."""

from __future__ import annotations

import json
from datetime import datetime

import pytest

from tidemark.plans import conditions, variables
from tidemark.plans import pipeline as p
from tidemark.plans.alerts import SLOW_STEP, AlertRule, Metrics


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("${env} == 'prod'", True),
        ("'${env}' == \"prod\"", True),
        ("${env} != 'prod' OR ${n} >= 3", True),
        ("NOT ${flag} and ${n} > -1", False),
        ("${unknown} == 'x'", False),
        ("${unknown|x} == 'x'", True),
        ("1 < ${n} < 3", False),
        ("${flag} == true", True),
        ("${unknown} > 3", False),
        ("${env} == 'a and b'", False),
    ],
)
def test_conditions(text, expected):
    assert conditions.evaluate(text, {"env": "prod", "n": "3", "flag": "true"}) is expected


@pytest.mark.parametrize("text", ["${env} = 'prod'", "prod == 'prod'", "${n}", "__import__('os')", "${env} ==", "[1] == [1]"])
def test_conditions_refused(text):
    with pytest.raises(conditions.ConditionError):
        conditions.evaluate(text, {"env": "prod", "n": 3})


def test_substitution():
    known = {"a": "x", "n": 3, "none": None, "q": "it's"}
    assert variables.substitute("${a} $n ${b|'d e'} ${b} $b", known) == "x 3 d e ${b} $b"
    assert variables.substitute({"${a}": ["$n", 1]}, known) == {"x": ["3", 1]}
    assert variables.substitute("${q} ${none} ${n}", known, as_sql=True) == "'it\\'s' NULL 3"
    assert variables.resolved({"v": 1}, {"v": 2, "w": 2}, {"w": 3, "x": 3}, {"x": 4, "y": 4}) == {"v": 1, "w": 2, "x": 3, "y": 4}
    with pytest.raises(variables.VariableError, match="did you mean table"):
        variables.check("${tabel}", {"table": 1})


def test_branches_and_sets_are_resolved_before_running():
    known = {"env": "dev"}
    steps = [p.Set("x", "${env}-1"), p.Branch((("${x} == 'dev-1'", (p.Export("a", "csv"), p.Branch((("false", (p.Export("no", "csv"),)),)))), ("else", (p.Export("b", "csv"),)))), p.Include([p.Export("c", "csv")])]
    assert [s.query for s in p.flatten(steps, known)] == ["a", "c"]


def test_faults_are_reported_together(spark):
    steps = [
        p.Source("s", "csv", {}),
        p.Source("t", "parquet", {"path": "x", "sync_mode": "incremental"}),
        p.Load("a", "z"),
        p.Load("b", "s", "UPSERT"),
        p.Table("c", "SELECT 1", "INCREMENTAL"),
        p.Table("d", "SELECT 1"),
        p.Table("d", "SELECT 2"),
    ]
    with pytest.raises(p.PipelineError) as e:
        p.Pipeline(spark).compile(steps)
    for part in ("csv needs path", "cursor_field", "no source 'z'", "mode UPSERT", "INCREMENTAL needs", "made twice"):
        assert part in str(e.value)


def test_first_failure_stops_the_run(spark, tmp_path):
    steps = [p.Table("good_one", "SELECT 1 AS x"), p.Table("bad", "SELECT * FROM god_one"), p.Table("never", "SELECT 1 AS x")]
    with pytest.raises(p.PipelineError, match="did you mean good_one") as e:
        p.Pipeline(spark).run(steps, str(tmp_path / "run"))
    assert e.value.step == "table:bad"
    assert [s["step"] for s in json.loads((tmp_path / "run/run.json").read_text())] == ["table:good_one", "table:bad"]


def test_incremental_table_keeps_its_cursor(spark, tmp_path, rows):
    steps = [p.Table("daily", "SELECT ts, v FROM feed WHERE ts >= @start_dt AND ts < @end_dt AND note <> '@start_dt'", "INCREMENTAL", by="ts", lookback="1 day")]
    run = lambda data, now: (spark.sql(data).createOrReplaceTempView("feed"), p.Pipeline(spark, str(tmp_path), now=now).run(steps).tables["daily"])[1]
    first = "SELECT TIMESTAMP_NTZ '2024-01-0{}' AS ts, {} AS v, 'n' AS note"
    assert len(rows(run(first.format(1, 1) + " UNION ALL " + first.format(2, 2), datetime(2024, 1, 3)))) == 2
    # the 1st lies before the look-back and stays; the 2nd is made anew
    assert rows(run(first.format(1, 7) + " UNION ALL " + first.format(2, 8) + " UNION ALL " + first.format(4, 9), datetime(2024, 1, 5)).select("v")) == [(7,), (8,), (9,)]
    assert rows(run(first.format(1, 5) + " UNION ALL " + first.format(4, 6), datetime(2024, 1, 6)).select("v")) == [(6,), (7,), (8,)]


def test_alerts_fire_once_in_their_cooldown():
    now = [0.0]
    m = Metrics([SLOW_STEP, AlertRule("few", "rows", "lt", 10)], clock=lambda: now[0])
    m.observe("step_seconds", 9.0)
    m.count("rows", 3)
    assert m.alerts() == ["slow_step", "few"]
    assert m.alerts() == []
    now[0] = 301
    assert m.alerts() == ["slow_step", "few"]
    assert m.summary("step_seconds")["count"] == 1
    with pytest.raises(ValueError, match="none of"):
        AlertRule("x", "m", "above", 1)


def test_profiles_and_command_line(spark, tmp_path, capsys, monkeypatch):
    from tidemark.__main__ import main
    from tidemark.plans import profiles

    monkeypatch.setenv("LEAST", "2")
    file = tmp_path / "p.toml"
    file.write_text(f"""[dev.variables]
least = "${{LEAST}}"
[dev.connectors.numbers]
type = "parquet"
params = {{ path = "{tmp_path}/n" }}
""")
    spark.range(5).write.parquet(str(tmp_path / "n"))
    (tmp_path / "my_steps.py").write_text("from tidemark.plans.pipeline import *\nsteps = [Source('n', connection='numbers'), Load('n', 'n'), Table('big', 'SELECT * FROM n WHERE id >= ${least}')]\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert main(["run", "my_steps:steps", "--profile", f"{file}:dev", "--store", str(tmp_path / "store")]) == 0
    assert spark.table("big").count() == 3
    assert main(["explain", "my_steps:steps", "--profile", f"{file}:dev", "--var", "least=4"]) == 0
    assert "id >= 4" in capsys.readouterr().out
    assert main(["run", "my_steps:steps"]) == 1
    assert profiles.errors({"x": 1, "connectors": {"c": {"type": "ftp"}}}) == ["unknown section 'x'", "connection 'c' has type 'ftp'"]
