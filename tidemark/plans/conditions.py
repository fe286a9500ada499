"""Conditions that choose branches of a pipeline before it runs."""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Mapping

from tidemark.plans.variables import _REFERENCE

_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_QUOTED = re.compile(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")")


class ConditionError(ValueError):
    """A condition that can't be decided."""


def evaluate(text: str, variables: Mapping) -> bool:
    """``${env} == 'prod' and not ${dry}``: comparisons and and/or/not (any case) of variables and literals.

    An unknown variable is null.  Text that reads as a number or as true or
    false is one.  ``=`` is an error, and so is a result that is no boolean.
    """
    names: dict[str, object] = {}

    def named(m: re.Match) -> str:
        name, default = m[1] or m[3], m[2]
        key = f"v{len(names)}_"
        names[key] = _typed(variables.get(name, default.strip(" '\"") if default else None))
        return f" {key} "

    def words(part: str) -> str:
        part = re.sub(r"\b(and|or|not)\b", lambda m: m[1].lower(), part, flags=re.I)
        part = re.sub(r"\btrue\b", "True", re.sub(r"\bfalse\b", "False", re.sub(r"\bnull\b", "None", part, flags=re.I), flags=re.I), flags=re.I)
        if re.search(r"(?<![=!<>])=(?!=)", part):
            raise ConditionError(f"use == to compare, not =, in {text!r}")
        return part

    unquoted = re.sub(r"(['\"])(\$\{[^}]*\})\1", r"\2", text)
    parts = _QUOTED.split(_REFERENCE.sub(named, unquoted))
    source = "".join(p if at % 2 else words(p) for at, p in enumerate(parts)).strip()
    try:
        value = _value(ast.parse(source, mode="eval").body, names)
    except SyntaxError:
        raise ConditionError(f"{text!r} is no condition") from None
    if not isinstance(value, bool):
        raise ConditionError(f"{text!r} is {value!r}, neither true nor false")
    return value


def _typed(value):
    if isinstance(value, str):
        if value.lower() in ("true", "false"):
            return value.lower() == "true"
        if re.fullmatch(r"[+-]?\d+", value):
            return int(value)
        if re.fullmatch(r"[+-]?\d*\.\d+", value):
            return float(value)
    return value


def _value(node: ast.AST, names: dict):
    if isinstance(node, ast.Constant):
        return _typed(node.value)
    if isinstance(node, ast.Name):
        if node.id in names:
            return names[node.id]
        raise ConditionError(f"{node.id!r} is neither a variable (${{{node.id}}}) nor quoted")
    if isinstance(node, ast.UnaryOp):
        inner = _value(node.operand, names)
        if isinstance(node.op, ast.USub) and isinstance(inner, (int, float)):
            return -inner
        if isinstance(node.op, ast.Not):
            return not inner
    if isinstance(node, ast.BoolOp):
        every = isinstance(node.op, ast.And)
        for part in node.values:
            if bool(_value(part, names)) != every:
                return not every
        return every
    if isinstance(node, ast.Compare):
        left = _value(node.left, names)
        for op, right_node in zip(node.ops, node.comparators, strict=True):
            right = _value(right_node, names)
            if type(op) not in _COMPARE:
                break
            ordered = not isinstance(op, (ast.Eq, ast.NotEq))
            if ordered and (left is None or right is None or isinstance(left, str) != isinstance(right, str)):
                return False
            if not _COMPARE[type(op)](left, right):
                return False
            left = right
        else:
            return True
    raise ConditionError(f"{ast.unparse(node)} is not allowed in a condition")
