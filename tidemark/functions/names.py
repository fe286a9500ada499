"""Safe SQL names."""

from __future__ import annotations

import re

_RESERVED = {"all", "alter", "and", "as", "by", "create", "cross", "delete", "distinct", "drop", "except", "from", "full", "group", "having", "in", "inner", "insert", "intersect", "into", "is", "join", "left", "like", "not", "null", "on", "or", "order", "outer", "right", "select", "set", "table", "truncate", "union", "update", "where", "with"}


def check_name(name: str) -> str:
    """The name if it is a plain identifier (dots between parts) and no keyword, else ValueError."""
    for part in name.split("."):
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,127}", part):
            raise ValueError(f"{name!r} is not a plain name")
        if part.lower() in _RESERVED:
            raise ValueError(f"{part!r} is a keyword")
    return name


def quote(name: str) -> str:
    """Any name in backticks."""
    return "`" + name.replace("`", "``") + "`"


def literal(value) -> str:
    """A Python value as SQL: NULL, TRUE, numbers, and quoted text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
