"""Data quality rules, evaluated in one pass over a table."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("completeness", "uniqueness", "validity", "consistency", "timeliness", "accuracy", "integrity")
# Weight of a failed rule by severity.
SEVERITIES = {"info": 0.1, "warning": 0.5, "error": 1.0, "critical": 2.0}


@dataclass(frozen=True)
class Rule:
    """A measure (an aggregate over the table) that must not exceed a threshold."""

    name: str
    measure: Column
    threshold: float = 0.0
    category: str = "validity"
    severity: str = "error"
    enabled: bool = True

    def __post_init__(self):
        if self.category not in CATEGORIES or self.severity not in SEVERITIES:
            raise ValueError(f"rule {self.name}: unknown category or severity")


def _share(failing: Column) -> Column:
    """Share of rows for which a predicate holds; 0 in an empty table."""
    return F.coalesce(F.count_if(failing) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))


def null_rate(column: str, most: float = 0.1) -> Rule:
    return Rule(f"null_check_{column}", _share(F.col(column).isNull()), most, "completeness", "warning")


def duplicate_rate(*columns: str, most: float = 0.0) -> Rule:
    """Share of rows beyond the first of each combination of columns."""
    rate = F.coalesce(1 - F.countDistinct(F.struct(*columns)) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))
    return Rule(f"duplicate_check_{'_'.join(columns)}", rate, most, "uniqueness", "error")


def negative_rate(column: str, most: float = 0.0) -> Rule:
    return Rule(f"negative_values_{column}", _share(F.col(column) < 0), most, "validity", "warning")


def freshness_hours(column: str, now: datetime, most: float = 24.0) -> Rule:
    """Hours from the last time to now; an empty table counts as infinitely old."""
    hours = (F.lit(now).cast("timestamp").cast("double") - F.max(F.col(column).cast("timestamp")).cast("double")) / 3600
    return Rule(f"data_freshness_{column}", F.coalesce(hours, F.lit(float("inf"))), most, "timeliness", "error")


def future_rate(column: str, now: datetime, most: float = 0.0) -> Rule:
    return Rule(f"future_timestamps_{column}", _share(F.col(column) > F.lit(now).cast("timestamp_ntz")), most, "timeliness", "warning")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose key has no parent; null keys refer to nothing and are not orphans."""
    known = parent.select(F.col(parent_key).alias("_parent")).distinct()
    return child.filter(F.col(key).isNotNull()).join(known, F.col(key) == F.col("_parent"), "left_anti")


class Validator:
    """A set of rules by name."""

    def __init__(self, *rules: Rule):
        self.rules = {r.name: r for r in rules}

    def add(self, rule: Rule) -> None:
        self.rules[rule.name] = rule

    def remove(self, name: str) -> None:
        self.rules.pop(name, None)

    def enable(self, name: str, on: bool = True) -> None:
        self.rules[name] = replace(self.rules[name], enabled=on)

    def results(self, df: DataFrame) -> DataFrame:
        """rule, category, severity, value, threshold, passed: one aggregation for all enabled rules."""
        rules = [r for r in self.rules.values() if r.enabled]
        row = lambda r, at: F.struct(F.lit(r.name).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.col(f"m{at}").alias("value"), F.lit(float(r.threshold)).alias("threshold"), (F.col(f"m{at}") <= r.threshold).alias("passed"))
        measured = df.agg(F.count("*").alias("_rows"), *[r.measure.cast("double").alias(f"m{at}") for at, r in enumerate(rules)])
        return measured.select(F.explode(F.array(*[row(r, at) for at, r in enumerate(rules)])).alias("r")).select("r.*")

    def score(self, df: DataFrame) -> DataFrame:
        """One row: score (the weighted share of passed rules, 1 without rules), passed and failed."""
        weight = F.lit(0.0)
        for name, w in SEVERITIES.items():
            weight = F.when(F.col("severity") == name, w).otherwise(weight)
        rated = self.results(df).withColumn("_w", weight)
        total = F.sum("_w")
        good = F.sum(F.when(F.col("passed"), F.col("_w")).otherwise(0.0))
        return rated.agg(F.coalesce(good / F.nullif(total, F.lit(0.0)), F.lit(1.0)).alias("score"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def load_passes(score: float, failed: int, least: float = 0.8) -> bool:
    """Whether a load is accepted: a high score and no failed rule."""
    return score >= least and failed == 0
