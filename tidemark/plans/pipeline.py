"""Pipelines as Python: steps that run in order on one session.

A pipeline is a list of steps.  Sources are lazy; Load and Table make tables
(views over versioned Parquet, or plain views in memory); Export writes.
Variables are put in first and branches are chosen before anything runs, so
what runs is a plain list.  Spark plans each step's query.
"""

from __future__ import annotations

import difflib
import json
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from datetime import date, datetime
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.names import check_name
from tidemark.operators import load, strategies, transform
from tidemark.operators.tables import VersionedTable
from tidemark.plans import conditions, variables
from tidemark.sources import registry
from tidemark.sources.shared import new_path, remove


class PipelineError(RuntimeError):
    """A step that failed, or steps that can't be run; ``step`` names the first one."""

    def __init__(self, message: str, step: str | None = None):
        super().__init__(message)
        self.step = step


@dataclass(frozen=True)
class Set:
    """A variable, unless the profile or the command line sets it."""

    name: str
    value: object


@dataclass(frozen=True)
class Source:
    """A named source: a type with options, or a connection of the profile with options over its own."""

    name: str
    type: str | None = None
    options: dict = field(default_factory=dict)
    connection: str | None = None


@dataclass(frozen=True)
class Load:
    """A table from a source: REPLACE, APPEND or UPSERT by keys."""

    table: str
    source: str
    mode: str = "REPLACE"
    keys: tuple[str, ...] = ()
    order_by: str | None = None


@dataclass(frozen=True)
class Table:
    """A table from a query, with a transform mode."""

    name: str
    query: str
    mode: str = "REPLACE"
    by: str | None = None
    keys: tuple[str, ...] = ()
    lookback: str | None = None


@dataclass(frozen=True)
class Export:
    """A table or a query to a sink."""

    query: str
    type: str
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Call:
    """A table made by a Python function of the session, such as a table function over another table."""

    name: str
    function: Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class Branch:
    """Steps under the first condition that holds; the condition 'else' always does."""

    cases: tuple[tuple[str, tuple], ...]


@dataclass(frozen=True)
class Include:
    """The steps of another pipeline, put in place."""

    steps: Sequence


@dataclass
class Result:
    """What ran, with seconds and rows where a step made a table in a store."""

    steps: list[dict] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)


def flatten(steps: Sequence, known: dict) -> list:
    """The steps that run: variables set, branches chosen, includes put in place; ``known`` gains the variables."""
    out = []
    for step in steps:
        if isinstance(step, Set):
            known.setdefault(step.name, variables.substitute(step.value, known))
        elif isinstance(step, Branch):
            chosen = next((body for text, body in step.cases if text == "else" or conditions.evaluate(text, known)), ())
            out += flatten(chosen, known)
        elif isinstance(step, Include):
            out += flatten(step.steps, known)
        else:
            out.append(step)
    return out


def _label(step) -> str:
    kind = type(step).__name__.lower()
    return f"{kind}:{getattr(step, 'table', None) or getattr(step, 'name', None) or getattr(step, 'query', '')[:40]}"


class Pipeline:
    """Runs steps; ``store`` is a folder for tables that stay, None for views in memory."""

    def __init__(self, spark: SparkSession, store: str | None = None, profile: dict | None = None, cli: dict | None = None, now: datetime | None = None):
        self.spark, self.store, self.profile = spark, store, profile or {}
        self.cli, self.now = cli or {}, now
        self.sources: dict[str, Source] = {}

    def compile(self, steps: Sequence) -> list:
        """The steps that would run, variables put in; raises PipelineError with every fault found."""
        over = {**self.profile.get("variables", {}), **self.cli}
        known, out, faults = dict(over), [], []
        try:
            for step in flatten(steps, known):
                try:
                    out.append(self._filled(step, known))
                except variables.VariableError as e:
                    faults.append(f"{_label(step)}: {e}")
        except conditions.ConditionError as e:
            faults.append(str(e))
        faults += self._faults(out)
        if faults:
            raise PipelineError("; ".join(faults))
        return out

    def _filled(self, step, known: dict):
        values = {}
        for name, value in vars(step).items():
            if isinstance(step, (Table, Export)) and name == "query":
                variables.check(value, known)
            values[name] = variables.substitute(value, known) if isinstance(value, (str, dict, tuple)) else value
        return type(step)(**values)

    def _faults(self, steps: list) -> list[str]:
        faults, sources, made = [], {}, {}
        for step in steps:
            if isinstance(step, Source):
                if bool(step.type) == bool(step.connection):
                    faults.append(f"source {step.name} needs a type or a connection, not both")
                elif step.connection and step.connection not in self.profile.get("connectors", {}):
                    faults.append(f"source {step.name}: no connection {step.connection!r} in the profile")
                else:
                    kind, layers = self._options(step)
                    try:
                        registry.merged(kind, *layers)
                    except registry.SourceError as e:
                        faults.append(f"source {step.name}: {e}")
                sources[step.name] = step
            elif isinstance(step, Load):
                if step.source not in sources:
                    near = difflib.get_close_matches(step.source, [*sources], 1)
                    faults.append(f"table {step.table}: no source {step.source!r}" + (f" (did you mean {near[0]}?)" if near else ""))
                if step.mode.upper() not in ("REPLACE", "APPEND", "UPSERT") or (step.mode.upper() == "UPSERT") != bool(step.keys):
                    faults.append(f"table {step.table}: mode {step.mode} with keys {step.keys}")
                made[step.table] = step
            elif isinstance(step, (Table, Call)):
                if isinstance(made.get(step.name), (Table, Call)) and getattr(step, "mode", "REPLACE").upper() == "REPLACE":
                    faults.append(f"table {step.name} is made twice")
                if isinstance(step, Table):
                    try:
                        transform.Mode(step.mode, step.by, tuple(step.keys), step.lookback)
                    except transform.ModeError as e:
                        faults.append(f"table {step.name}: {e}")
                made[step.name] = step
            elif isinstance(step, Export) and step.type.lower() not in registry.SPECS:
                faults.append(f"export to unknown type {step.type!r}")
        return faults

    def _options(self, step: Source) -> tuple[str, list[dict]]:
        found = self.profile.get("connectors", {}).get(step.connection, {})
        return step.type or found.get("type", ""), [found.get("params", {}), step.options]

    def explain(self, steps: Sequence) -> str:
        """The compiled steps as JSON, to be kept beside a run."""
        return json.dumps([{"step": _label(s), **({"name": s.name} if isinstance(s, Call) else asdict(s))} for s in self.compile(steps)], default=str, indent=1)

    def run(self, steps: Sequence, artifacts: str | None = None) -> Result:
        """Run all steps in order; the first failure stops the run with PipelineError."""
        compiled, out = self.compile(steps), Result()
        self.sources = {s.name: s for s in compiled if isinstance(s, Source)}
        for step in compiled:
            began, label = time.time(), _label(step)
            try:
                made = self._run(step)
            except Exception as e:
                out.steps.append({"step": label, "seconds": round(time.time() - began, 3), "error": str(e)})
                self._record(artifacts, out)
                hint = ""
                if isinstance(e, AnalysisException) and (name := (e.getMessageParameters() or {}).get("relationName")):
                    near = difflib.get_close_matches(name.strip("`"), [*out.tables, *(t.name for t in self.spark.catalog.listTables())], 1)
                    hint = f" (did you mean {near[0]}?)" if near else ""
                raise PipelineError(f"{label}: {e}{hint}", label) from e
            if made is not None:
                out.tables[getattr(step, "table", None) or step.name] = made
            out.steps.append({"step": label, "seconds": round(time.time() - began, 3)})
        self._record(artifacts, out)
        return out

    def _record(self, folder: str | None, result: Result) -> None:
        if folder:
            Path(folder).mkdir(parents=True, exist_ok=True)
            Path(folder, "run.json").write_text(json.dumps(result.steps, indent=1))

    def _run(self, step) -> DataFrame | None:
        if isinstance(step, Source):
            return None
        if isinstance(step, Export):
            registry.write(self.spark.sql(step.query if " " in step.query.strip() else f"SELECT * FROM {check_name(step.query.strip())}"), step.type, step.options)
            return None
        if isinstance(step, Call):
            return self._keep(step.name, step.function(self.spark))
        return self._load(step) if isinstance(step, Load) else self._transform(step)

    def _current(self, name: str) -> DataFrame | None:
        if self.store:
            return self._table(name).read()
        return self.spark.table(name) if self.spark.catalog.tableExists(name) else None

    def _table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.store}/{check_name(name)}")

    def _keep(self, name: str, df: DataFrame, cursors: dict[str, str] | None = None) -> DataFrame:
        """Data and cursors become current together; then the view of that name reads the new version."""
        if self.store:
            df = self._table(name).replace(df, cursors)
        df.createOrReplaceTempView(check_name(name))
        return df

    def _load(self, step: Load) -> DataFrame:
        source = self.sources[step.source]
        kind, layers = self._options(source)
        rows = registry.read(self.spark, kind, *layers)
        options = registry.merged(kind, *layers)
        column = options["cursor_field"] if options.get("sync_mode") == "incremental" else None
        if not self.store:
            if column:
                rows = registry.after_cursor(rows, column, None)
            target, mode = self._current(step.table), step.mode.upper()
            new = load.upsert(target, rows, step.keys, step.order_by) if mode == "UPSERT" else load.append(target, rows) if mode == "APPEND" else rows
            return self._keep(step.table, new)
        with self._table(step.table).writing() as table:
            if not column:
                return self._view(step.table, _store(table, rows, step))
            name = f"source:{step.source}:{column}"
            before = table.cursors().get(name)
            # the source is asked once; rows that reach it later are of the next run, whatever happens to this one
            copy = new_path(self.spark, "increment")
            if options.get("cursor_param") and before is not None:
                rows = registry.read(self.spark, kind, *layers, {"cursor_value": before})
            registry.after_cursor(rows, column, before).write.parquet(copy)
            rows = self.spark.read.schema(rows.schema).parquet(copy)
            mark = registry.next_cursor(rows, column, before)
            made = _store(table, rows, step, {name: mark} if mark is not None else None)
            remove(self.spark, copy)
            return self._view(step.table, made)

    def _view(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(check_name(name))
        return df

    def _transform(self, step: Table) -> DataFrame:
        mode = transform.Mode(step.mode, step.by, tuple(step.keys), step.lookback)
        if self.store:
            with self._table(step.name).writing() as table:
                return self._view(step.name, self._stored_transform(step, mode, table))
        target = self._current(step.name)
        if mode.name != "INCREMENTAL":
            return self._keep(step.name, transform.apply(target, self.spark.sql(step.query), mode))
        mark = transform.high_water(target, step.by).first()[0] if target is not None else None
        start, end = transform.window(_time(mark), self.now or datetime.now(), step.lookback)
        return self._keep(step.name, transform.apply(target, transform.run_with_range(self.spark, step.query, start, end), mode, start, end))

    def _stored_transform(self, step: Table, mode: transform.Mode, table: VersionedTable) -> DataFrame:
        target = table.read()
        if mode.name != "INCREMENTAL":
            rows = self.spark.sql(step.query)
            if mode.name == "REPLACE" or target is None:
                return table.replace(rows)
            return table.append(rows) if mode.name == "APPEND" else table.delete_insert(rows, list(mode.keys))
        name = f"transform:{step.by}"
        mark = table.cursors().get(name)
        if mark is None and target is not None:
            high = transform.high_water(target, step.by).first()[0]
            mark = high.isoformat() if high is not None else None
        start, end = transform.window(datetime.fromisoformat(mark) if mark else None, self.now or datetime.now(), step.lookback)
        fresh = transform.run_with_range(self.spark, step.query, start, end)

        def water(written: DataFrame) -> dict[str, str]:
            high = transform.high_water(written, step.by).first()[0]
            later = [t for t in (_time(high), datetime.fromisoformat(mark) if mark else None) if t is not None]
            return {name: (high if high is not None and _time(high) == max(later) else max(later)).isoformat()} if later else {}

        if target is None:
            return table.replace(transform.apply(None, fresh, mode, start, end), water)
        touched = transform.in_range(fresh.schema[step.by].dataType, step.by, start, end)
        return table.rewrite(lambda rows: rows.filter(touched), lambda rows: transform.apply(rows, fresh, mode, start, end), water)


def _time(value: date | datetime | None) -> datetime | None:
    return value if value is None or isinstance(value, datetime) else datetime(value.year, value.month, value.day)


def _store(table: VersionedTable, rows: DataFrame, step: Load, cursors: dict[str, str] | None = None) -> DataFrame:
    """Write a load's rows in its mode, with its cursors."""
    mode = step.mode.upper()
    if mode == "UPSERT":
        return table.upsert(rows, list(step.keys), step.order_by, cursors)
    return table.append(rows, cursors) if mode == "APPEND" else table.replace(rows, cursors)


def load_with_strategy(target: DataFrame | None, source: DataFrame, pattern: strategies.LoadPattern, keys: Sequence[str] = (), time_column: str | None = None) -> tuple[str, DataFrame]:
    """Choose a strategy for a load's pattern and apply it: its name and the new content."""
    name = strategies.choose(pattern)
    if name == "cdc":
        return name, strategies.apply_changes(target, source, keys, order_by=time_column or "ts")
    if name == "upsert":
        return name, strategies.upsert_with(target, source, keys, "latest_wins" if time_column else "source_wins", time_column)
    return name, source if name == "snapshot" else load.append(target, source)
