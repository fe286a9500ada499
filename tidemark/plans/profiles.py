"""Profiles: variables, connections and Spark settings of an environment, from JSON or TOML."""

from __future__ import annotations

import json
import os
import tomllib
from pathlib import Path

from pyspark.sql import SparkSession

from tidemark.plans import variables
from tidemark.sources.registry import SPECS


class ProfileError(ValueError):
    """A profile with faults; the message lists all."""


def load(path: str, name: str | None = None) -> dict:
    """A profile, with references to environment variables put in; ``name`` picks one of several in a file."""
    text = Path(path).read_text()
    found = tomllib.loads(text) if path.endswith(".toml") else json.loads(text)
    if name is not None:
        if name not in found:
            raise ProfileError(f"{path} has no profile {name!r}")
        found = found[name]
    found = variables.substitute(found, os.environ)
    faults = errors(found)
    if faults:
        raise ProfileError("; ".join(faults))
    return found


def errors(profile: dict) -> list[str]:
    """Unknown sections, and connections without a known type."""
    out = [f"unknown section {k!r}" for k in profile if k not in ("variables", "connectors", "spark", "store")]
    for name, c in profile.get("connectors", {}).items():
        if c.get("type", "").lower() not in SPECS:
            out.append(f"connection {name!r} has type {c.get('type')!r}")
    return out


def session(profile: dict, app: str = "tidemark") -> SparkSession:
    """A session with the profile's Spark settings."""
    return SparkSession.builder.appName(app).config(map={k: str(v) for k, v in profile.get("spark", {}).items()}).getOrCreate()
