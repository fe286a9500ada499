"""Masking of personal data in columns and in log text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns without look-around, which Java's and other regex engines read alike.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "card": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "phone": r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\b",
    "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
}
SECRETS = {"password": r"(?i)(password\s*[=:]\s*)[^\s,;]+", "api_key": r"(?i)(api[_-]?key\s*[=:]\s*)[^\s,;]+"}
SENSITIVE = {"password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "authorization", "ssn", "credit_card", "card_number", "cvv", "pin"}


def mask(text: Column, kinds: tuple[str, ...] = tuple(PATTERNS)) -> Column:
    """The text with each match replaced by its kind in brackets, in the order of ``kinds``."""
    for kind in kinds:
        text = F.regexp_replace(text, PATTERNS[kind], f"[{kind.upper()}]")
    return text


def counts(text: Column, kinds: tuple[str, ...] = tuple(PATTERNS)) -> dict[str, Column]:
    """Matches of each kind; 0 for null."""
    return {kind: F.coalesce(F.size(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), 0)), F.lit(0)).cast("bigint") for kind in kinds}


def mask_text(text: str) -> str:
    """The same for a log line, with values of passwords and keys too."""
    for name, pattern in SECRETS.items():
        text = re.sub(pattern, rf"\1[{name.upper()}]", text)
    for kind, pattern in PATTERNS.items():
        text = re.sub(pattern, f"[{kind.upper()}]", text)
    return text


def mask_fields(record: dict) -> dict:
    """A log record with sensitive fields hidden and strings masked, at any depth."""
    value = lambda v: mask_fields(v) if isinstance(v, dict) else [value(x) for x in v] if isinstance(v, list) else mask_text(v) if isinstance(v, str) else v
    return {k: "[REDACTED]" if k.lower() in SENSITIVE else value(v) for k, v in record.items()}
