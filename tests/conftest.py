"""One session for all tests, and a comparison of results."""

from __future__ import annotations

import math
import os
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value of either engine in one form."""
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return int(value) if value == math.floor(value) and abs(value) < 1e15 else round(value, 6)
    if hasattr(value, "isoformat"):
        return str(value)[:10] if str(value)[11:] in ("", "00:00:00") else str(value)
    return value


@pytest.fixture(scope="session")
def rows():
    """Rows of a DataFrame as sorted tuples, columns in order of name."""

    def collect(df):
        names = sorted(df.columns)
        return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)

    return collect
