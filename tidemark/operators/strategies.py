"""Incremental strategies: append by watermark, upsert with conflict rules, snapshot, change data capture, and a choice among them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import load

CONFLICTS = ("latest_wins", "source_wins", "target_wins", "manual")


class ConflictError(ValueError):
    """Source and target disagree and the rule is to ask."""


@dataclass(frozen=True)
class LoadPattern:
    """What is known of a load: shares of rows and properties of its source."""

    insert_rate: float = 0.0
    update_rate: float = 0.0
    delete_rate: float = 0.0
    change_rate: float = 0.0
    rows: int = 0
    bytes: int = 0
    has_primary_key: bool = False
    has_change_flag: bool = False
    needs_history: bool = False
    tolerates_duplicates: bool = False


# Milliseconds a row, and weight of a strategy that can handle a load.
COST_MS = {"append": 0.1, "upsert": 0.5, "snapshot": 0.3, "cdc": 0.8}
WEIGHTS = {"append": 1.0, "cdc": 0.9, "upsert": 0.7, "snapshot": 0.5}


def can_handle(strategy: str, p: LoadPattern) -> bool:
    if strategy == "append":
        return p.insert_rate > 0.8 and p.update_rate < 0.1 and p.delete_rate < 0.1 and not p.tolerates_duplicates
    if strategy == "upsert":
        return p.has_primary_key and p.update_rate > 0 and not p.needs_history
    if strategy == "snapshot":
        return p.rows < 1_000_000 and p.change_rate > 0.5
    if strategy == "cdc":
        return p.has_change_flag and p.has_primary_key and p.delete_rate > 0
    raise ValueError(f"unknown strategy {strategy!r}")


def estimated_seconds(strategy: str, p: LoadPattern) -> float:
    return COST_MS[strategy] * p.rows / 1000


def choose(p: LoadPattern) -> str:
    """The strategy of the highest weight that can handle the load: quick and small loads weigh more; append if none can."""
    scores = {}
    for name, weight in WEIGHTS.items():
        if can_handle(name, p):
            scores[name] = weight + 0.2 * (estimated_seconds(name, p) < 10) + 0.1 * (p.bytes < 100 << 20)
    return max(scores, key=scores.get, default="append")


def append_since(target: DataFrame | None, fresh: DataFrame, by: str, watermark: Column | None) -> DataFrame:
    """The target and the fresh rows beyond the watermark; the filter reaches the fresh rows' scan."""
    return load.append(target, fresh if watermark is None else fresh.filter(F.col(by) > watermark))


def upsert_with(target: DataFrame | None, source: DataFrame, keys: Sequence[str], conflict: str = "source_wins", time_column: str | None = None) -> DataFrame:
    """Upsert where ``conflict`` says which side keeps a key that both have.

    latest_wins compares ``time_column`` (the source wins ties and over null);
    manual raises ConflictError if a common key has differing rows.
    """
    if conflict not in CONFLICTS:
        raise ValueError(f"conflict {conflict!r} is none of {', '.join(CONFLICTS)}")
    if conflict == "latest_wins" and not time_column:
        raise ValueError("latest_wins needs a time column")
    if target is None:
        return source
    same = list(keys)
    if conflict == "target_wins":
        return load.append(target, load.without_keys(source, target, same))
    if conflict == "manual":
        known = target.select(*same, F.struct(*[F.col(c) for c in target.columns if c in source.columns]).alias("_t"))
        now = source.select(*same, F.struct(*[F.col(c) for c in target.columns if c in source.columns]).alias("_s"))
        if not now.join(known, same).filter(~F.col("_s").eqNullSafe(F.col("_t"))).isEmpty():
            raise ConflictError(f"source and target differ for the same {', '.join(keys)}")
        return load.upsert(target, source, keys)
    if conflict == "latest_wins":
        known = target.select(*same, F.col(time_column).alias("_known"))
        source = source.join(known, same, "left").filter(F.col("_known").isNull() | (F.col(time_column) >= F.col("_known"))).select(*source.columns)
        return load.upsert(target, source, keys, order_by=time_column)
    return load.upsert(target, source, keys)


def apply_changes(target: DataFrame | None, changes: DataFrame, keys: Sequence[str], operation: str = "op", order_by: str = "ts") -> DataFrame:
    """The target after a change stream: the last event of a key decides.

    Events are D (delete), U or I (the new row); other values are an error of
    the source and ignored.  Null keys never match and are inserted.  Of events
    of one key at one time a deletion counts as the last.
    """
    events = changes.filter(F.col(operation).isin("D", "U", "I"))
    last = load.latest(events, keys, order_by, then=F.col(operation) == "D")
    rows = last.filter(F.col(operation) != "D").drop(operation)
    if target is None:
        return rows
    rows = rows.select(*[c for c in rows.columns if c in target.columns])
    kept = load.without_keys(target, last, keys)
    return kept.unionByName(load.conform(rows, target))
