"""Schema evolution: difference, verdict, plan and application."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCALES = [["tinyint", "smallint", "int", "bigint"], ["float", "double"]]
_WIDER = {("int", "float"), ("int", "double"), ("bigint", "double"), ("smallint", "float"), ("smallint", "double"), ("date", "timestamp"), ("date", "timestamp_ntz")}
ADD_MS, WIDEN_MS = 50, 100


def widens(old: T.DataType, new: T.DataType) -> bool:
    """Whether every value of the old type has a place in the new one."""
    a, b = old.simpleString(), new.simpleString()
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    if isinstance(old, (T.VarcharType, T.CharType)) and isinstance(new, T.StringType):
        return True
    return (a, b) in _WIDER or any(a in s and b in s and s.index(a) < s.index(b) for s in _SCALES)


@dataclass
class SchemaDiff:
    """Columns by what happened to them; names compare without case."""

    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    widened: list[str] = field(default_factory=list)
    narrowed: list[str] = field(default_factory=list)
    incompatible: list[str] = field(default_factory=list)

    @property
    def verdict(self) -> str:
        if self.removed or self.narrowed or self.incompatible:
            return "INCOMPATIBLE"
        return "REQUIRES_MIGRATION" if self.added or self.widened else "COMPATIBLE"

    @property
    def estimated_ms(self) -> int:
        return ADD_MS * len(self.added) + WIDEN_MS * len(self.widened)

    def steps(self) -> list[str]:
        """What a migration does, and how each step is undone."""
        return [f"add {c} (undo: drop {c})" for c in self.added] + [f"widen {c} (undo: cast {c} back)" for c in self.widened]


def diff(old: T.StructType, new: T.StructType) -> SchemaDiff:
    before, after, out = {f.name.lower(): f for f in old}, {f.name.lower(): f for f in new}, SchemaDiff()
    out.added = [f.name for f in new if f.name.lower() not in before]
    out.removed = [f.name for f in old if f.name.lower() not in after]
    for name, f in before.items():
        if name in after and f.dataType != after[name].dataType:
            a, b = f.dataType, after[name].dataType
            (out.widened if widens(a, b) else out.narrowed if widens(b, a) else out.incompatible).append(f.name)
    return out


def evolve(df: DataFrame, to: T.StructType, defaults: dict[str, Column] | None = None) -> DataFrame:
    """df with the columns and types of ``to``; added columns get their default or null.  Incompatible changes raise ValueError."""
    found = diff(df.schema, to)
    if found.verdict == "INCOMPATIBLE":
        raise ValueError(f"removed {found.removed}, narrowed {found.narrowed}, incompatible {found.incompatible}")
    defaults, have = defaults or {}, {c.lower(): c for c in df.columns}
    value = lambda f: F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else defaults.get(f.name, F.lit(None))
    return df.select(*[value(f).cast(f.dataType).alias(f.name) for f in to])
