"""Variables of a pipeline: ${name}, ${name|default} and $name, with a fixed precedence."""

from __future__ import annotations

import difflib
import os
import re
from collections.abc import Mapping

from tidemark.functions.names import literal

_REFERENCE = re.compile(r"\$\{\s*([A-Za-z_]\w*)\s*(?:\|([^}]*))?\}|\$([A-Za-z_]\w*)")


class VariableError(ValueError):
    """A variable without a value, with names that look alike."""


def resolved(cli: Mapping | None = None, profile: Mapping | None = None, pipeline: Mapping | None = None, env: Mapping | None = None) -> dict:
    """One mapping; the command line is over the profile, that over the pipeline, that over the environment."""
    return {**(os.environ if env is None else env), **(pipeline or {}), **(profile or {}), **(cli or {})}


def substitute(value, variables: Mapping, as_sql: bool = False):
    """Text, and text in lists and dicts (keys too), with references replaced.

    A reference without value or default stays as it is.  ``as_sql`` writes
    values as SQL literals; else as plain text.
    """
    if isinstance(value, dict):
        return {substitute(k, variables): substitute(v, variables, as_sql) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return type(value)(substitute(v, variables, as_sql) for v in value)
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        name, default = m[1] or m[3], m[2]
        if name in variables:
            return literal(variables[name]) if as_sql else "" if variables[name] is None else str(variables[name])
        if default is None:
            return m[0]
        plain = default.strip()
        plain = plain[1:-1] if len(plain) > 1 and plain[0] == plain[-1] and plain[0] in "'\"" else plain
        return literal(plain) if as_sql else plain

    return _REFERENCE.sub(one, value)


def missing(text: str, variables: Mapping) -> list[str]:
    """Names that have neither value nor default, in order."""
    return list(dict.fromkeys(n for a, default, b in _REFERENCE.findall(text) if (n := a or b) not in variables and not default))


def check(text: str, variables: Mapping) -> None:
    """Raise VariableError for names without a value."""
    lost = missing(text, variables)
    if lost:
        near = {n: difflib.get_close_matches(n, [*variables], 1) for n in lost}
        raise VariableError("; ".join(f"${{{n}}} has no value" + (f" (did you mean {m[0]}?)" if m else "") for n, m in near.items()))
