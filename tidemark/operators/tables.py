"""Parquet tables that are read while they are written, and rolled back.

A version is a list of parts: folders that are never changed after they are
written, or some files of such a folder.  So an append writes its own rows only,
and an upsert or an incremental run writes the files that it touches again while
all others are taken over.  A small pointer file names the parts of the last
versions and holds the cursors of loads, so that data and cursor change with one
rename.  All paths go through Hadoop's file system.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import load
from tidemark.sources.shared import hadoop_path, put_text, remove

#: Cursors to commit: fixed, or worked out from the rows that were written.
Cursors = dict[str, str] | Callable[[DataFrame], dict[str, str]] | None


class TableBusyError(RuntimeError):
    """Another writer holds the table."""


class StaleTableError(RuntimeError):
    """The table was changed by another writer after it was read."""


class VersionedTable:
    """A table at ``path``.

    append() and rewrite() read and write under the table's lock.  replace()
    refuses to go over a version that came after this object's last read(), so
    that no committed write is lost.  Hold writing() around steps that belong
    together.  A second writer fails at once; a lock that a killed driver left
    behind is removed with unlock().
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._holds, self._seen = False, None

    @contextmanager
    def writing(self):
        """Hold the table's lock; what is read inside is still current when it is written."""
        if self._holds:
            yield self
            return
        fs, lock = hadoop_path(self.spark, f"{self.path}/_lock")
        fs.mkdirs(lock.getParent())
        if not fs.createNewFile(lock):
            raise TableBusyError(f"{self.path} is being written by another run")
        self._holds = True
        try:
            yield self
        finally:
            self._holds = False
            fs.delete(lock, False)

    def unlock(self) -> None:
        """Remove the lock of a writer that is known to be dead."""
        remove(self.spark, f"{self.path}/_lock")

    def _state(self) -> dict:
        fs, where = hadoop_path(self.spark, f"{self.path}/current.json")
        if not fs.exists(where):
            return {"versions": [], "cursors": {}, "previous": []}
        return json.loads(self.spark.read.text(f"{self.path}/current.json", wholetext=True).first()[0])

    def _read(self, version: dict, with_file: bool = False) -> DataFrame:
        schema = T.StructType.fromJson(version["schema"])
        reader = self.spark.read.schema(schema)
        paths = [(f"{self.path}/{p['folder']}", p["files"]) for p in version["parts"]]
        if version["partition_by"]:
            frames = [reader.option("basePath", folder).parquet(*([f"{folder}/{f}" for f in files] if files else [folder])) for folder, files in paths]
        else:
            frames = [reader.parquet(*[x for folder, files in paths for x in ([f"{folder}/{f}" for f in files] if files else [folder])])]
        frames = [f.select(*([c for c in map(_quoted, schema.names)] + ([F.col("_metadata.file_path").alias("_file")] if with_file else []))) for f in frames]
        return reduce(DataFrame.unionByName, frames)

    def exists(self) -> bool:
        return bool(self._state()["versions"])

    def read(self) -> DataFrame | None:
        """The current version, or None before the first."""
        versions = self._state()["versions"]
        self._seen = versions[-1]["name"] if versions else ""
        return self._read(versions[-1]) if versions else None

    def cursors(self) -> dict[str, str]:
        """High-water marks by name, as of the current version."""
        return self._state()["cursors"]

    def reset_cursors(self, *names: str) -> None:
        """Forget high-water marks, all or those named, so that the next run starts anew; the data stay."""
        with self.writing():
            state = self._state()
            put_text(self.spark, f"{self.path}/current.json", json.dumps(state | {"cursors": {k: v for k, v in state["cursors"].items() if names and k not in names}}, sort_keys=True))

    def replace(self, df: DataFrame, cursors: Cursors = None, partition_by: list[str] | None = None) -> DataFrame:
        """Write df as the next version, make it current together with the cursors, and return it.

        df may read the current version.  Versions beyond the last ``keep`` are
        deleted after the change.  Raises StaleTableError if another writer
        changed the table after this object last read it.
        """
        with self.writing():
            state = self._state()
            last = state["versions"][-1]["name"] if state["versions"] else ""
            if self._seen is not None and self._seen != last:
                raise StaleTableError(f"{self.path} was changed after it was read; read it again")
            return self._commit(state, [], df, list(partition_by or []), cursors)

    def append(self, df: DataFrame, cursors: Cursors = None) -> DataFrame:
        """Add rows, matched by column name and cast to the table's types; nothing else is written."""
        with self.writing():
            state = self._state()
            if not state["versions"]:
                return self._commit(state, [], df, [], cursors)
            now = state["versions"][-1]
            return self._commit(state, now["parts"], load.conform(df, self._read(now)), now["partition_by"], cursors, now["schema"])

    def rewrite(self, hit: Callable[[DataFrame], DataFrame], make: Callable[[DataFrame], DataFrame], cursors: Cursors = None) -> DataFrame:
        """Replace the files that hold a row of hit(table) by make(their rows); all other files stay.

        ``hit`` filters or semi-joins the table, so that only the columns it
        needs are read to find the files.  The table must exist.
        """
        with self.writing():
            state = self._state()
            now = state["versions"][-1]
            # a row for each touched file
            found = [urllib.parse.unquote(r[0]) for r in hit(self._read(now, with_file=True)).select("_file").distinct().collect()]
            kept, touched = [], []
            for part in now["parts"]:
                mark = f"/{part['folder']}/"
                hits = {f.split(mark, 1)[1] for f in found if mark in f}
                if not hits:
                    kept.append(part)
                    continue
                touched.append({"folder": part["folder"], "files": sorted(hits)})
                rest = sorted(set(part["files"] or self._files(part["folder"])) - hits)
                kept += [{"folder": part["folder"], "files": rest}] if rest else []
            rows = self._read(now | {"parts": touched}) if touched else self.spark.createDataFrame([], T.StructType.fromJson(now["schema"]))
            return self._commit(state, kept, make(rows), now["partition_by"], cursors, now["schema"])

    def upsert(self, df: DataFrame, keys: list[str], order_by: str | None = None, cursors: Cursors = None) -> DataFrame:
        """load.upsert() that writes only files with a key of df; df is read more than once, so it should be stored."""
        return self._by_key(df, keys, lambda rows: load.upsert(rows, df, keys, order_by), cursors, lambda: load.upsert(None, df, keys, order_by))

    def delete_insert(self, df: DataFrame, keys: list[str], cursors: Cursors = None) -> DataFrame:
        """load.delete_insert() that writes only files with a key of df."""
        return self._by_key(df, keys, lambda rows: load.delete_insert(rows, df, keys), cursors, lambda: df)

    def _by_key(self, df: DataFrame, keys: list[str], make: Callable, cursors: Cursors, first: Callable) -> DataFrame:
        with self.writing():
            state = self._state()
            if not state["versions"]:
                return self._commit(state, [], first(), [], cursors)
            now = T.StructType.fromJson(state["versions"][-1]["schema"])
            errors = load.key_errors(keys, df.schema, now) + load.schema_errors(df.schema, now)
            if errors:
                raise load.LoadError("; ".join(errors))
            return self.rewrite(lambda table: load.with_keys(table, df, keys), make, cursors)

    def compact(self) -> DataFrame:
        """Write the current version as one part, for instance after many appends."""
        with self.writing():
            state = self._state()
            now = state["versions"][-1]
            return self._commit(state, [], self._read(now), now["partition_by"], None)

    def _files(self, folder: str) -> list[str]:
        fs, where = hadoop_path(self.spark, f"{self.path}/{folder}")
        found, out = fs.listFiles(where, True), []
        while found.hasNext():
            name = found.next().getPath().toUri().getPath().split(f"/{folder}/", 1)[1]
            if not name.rsplit("/", 1)[-1].startswith(("_", ".")):
                out.append(name)
        return out

    def _commit(self, state: dict, kept: list[dict], df: DataFrame, partition_by: list[str], cursors: Cursors, schema: dict | None = None) -> DataFrame:
        number = int(state["versions"][-1]["name"].split("-")[0][1:]) + 1 if state["versions"] else 0
        name = f"v{number:06d}-{uuid.uuid4().hex[:8]}"
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(f"{self.path}/{name}")
        fresh = {"name": name, "parts": [{"folder": name, "files": None}], "schema": schema or json.loads(df.schema.json()), "partition_by": partition_by}
        if callable(cursors):
            cursors = cursors(self._read(fresh))
        version = fresh | {"parts": [*kept, *fresh["parts"]]}
        versions = [*state["versions"], version]
        old, now = versions[: -self.keep], versions[-self.keep :]
        previous = [*state["previous"], state["cursors"]][-self.keep :]
        put_text(self.spark, f"{self.path}/current.json", json.dumps({"versions": now, "cursors": state["cursors"] | (cursors or {}), "previous": previous}, sort_keys=True))
        self._forget(old, now)
        self._seen = name
        return self._read(version)

    def _forget(self, old: list[dict], now: list[dict]) -> None:
        """Delete folders that only old versions have."""
        used = {p["folder"] for v in now for p in v["parts"]}
        for folder in {p["folder"] for v in old for p in v["parts"]} - used:
            remove(self.spark, f"{self.path}/{folder}")

    def rollback(self) -> DataFrame:
        """Make the version before the current one current again, with its cursors, and delete what only the other has."""
        with self.writing():
            state = self._state()
            if len(state["versions"]) < 2:
                raise ValueError(f"{self.path} has no earlier version")
            *kept, gone = state["versions"]
            put_text(self.spark, f"{self.path}/current.json", json.dumps({"versions": kept, "cursors": state["previous"][-1], "previous": state["previous"][:-1]}, sort_keys=True))
            self._forget([gone], kept)
        return self.read()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
