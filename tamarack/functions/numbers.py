"""Numeric comparison of a text with a number, as SQL. Texts that are no numbers compare false."""

from __future__ import annotations

import math
import re

from .sqltext import sql_str

OPERATORS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
_INTEGER = r"\A\s*[+-]?[0-9]+\s*\z"
_FLOAT = r"\A[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|(?i)inf|(?i)infinity|(?i)nan)\z"
_PY_FLOAT = re.compile(r"[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|inf|infinity|nan)", re.IGNORECASE)


def operator_of(modifiers: tuple[str, ...]) -> str | None:
    """Of several the first of gt, gte, lt, lte."""
    return next((sql for name, sql in OPERATORS.items() if name in modifiers), None)


def number_of(text: str) -> float | None:
    return float(text) if _PY_FLOAT.fullmatch(text) else None


def compare(value: str, operator: str, number: int | float | str | bool) -> str | None:
    """SQL; None if the rule's value is a text that is no number, which is then matched as text."""
    if isinstance(number, bool):
        return "false"
    as_float = float(number) if not isinstance(number, str) else number_of(number)
    if as_float is None:
        return None
    if math.isnan(as_float):
        return "false"
    limit = f"double({sql_str(repr(as_float))})" if math.isfinite(as_float) else f"double('{'' if as_float > 0 else '-'}Infinity')"
    # NaN compares false with all numbers, unlike in SQL, where it is the largest.
    plain = f"(lower({value}) NOT IN ('nan', '+nan', '-nan') AND try_cast(regexp_replace({value}, '(?i)\\\\A([+-]?)inf(inity)?\\\\z', '$1Infinity') AS DOUBLE) {operator} {limit})".replace("$1", "\\u00241")
    floating = f"CASE WHEN {value} RLIKE {sql_str(_FLOAT)} THEN {plain} ELSE false END"
    if not isinstance(number, int):
        return f"coalesce({floating}, false)"
    whole = f"try_cast(trim({value}) AS BIGINT)"
    return f"coalesce(CASE WHEN {value} RLIKE {sql_str(_INTEGER)} AND {whole} IS NOT NULL THEN {whole} {operator} {number}L ELSE {floating} END, false)"
