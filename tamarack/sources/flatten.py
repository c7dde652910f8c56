"""Nested JSON to flat fields of text. Python, as no built-in function keeps numbers and collisions as is wanted.

Objects give dotted paths, in order of their keys' UTF-8; an array of one scalar gives its own path; longer arrays give a path for each element
and, under the array's path, its scalars joined by line feeds; an empty array and null give the empty text. Of colliding
paths the first stays. Deeper than max_depth, or at max_fields fields, is an error.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from typing import Any

from ..errors import FlattenError


@dataclass(frozen=True)
class FlattenOptions:
    max_depth: int = 64
    max_fields: int = 10_000


#: Nesting that the parser itself refuses.
PARSER_DEPTH = 127


def parse_json(text: str) -> Any:
    def refuse(word: str) -> None:
        raise ValueError(f"{word} is no JSON")

    def number(text: str) -> float:
        value = float(text)
        if math.isinf(value):
            raise ValueError("a number is out of range")
        return value

    def integer(text: str) -> int | float:
        value = int(text) if len(text) < 25 else None
        return value if value is not None and -(1 << 63) <= value < 1 << 64 and text != "-0" else number(text)

    try:
        value = json.loads(text, parse_float=number, parse_int=integer, parse_constant=refuse)
    except (ValueError, RecursionError) as error:
        raise FlattenError("json_parse", str(error)) from error
    level, depth = [value], 0
    while level := [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]:
        depth += 1
        if depth > PARSER_DEPTH:
            raise FlattenError("json_parse", "nested too deeply")
    return value


def float_text(value: float) -> str:
    """The shortest digits, positional from 1e-5 to below 1e16, else with a plain exponent."""
    if value == 0:
        return "-0.0" if math.copysign(1, value) < 0 else "0.0"
    head, _, exponent = f"{value!r}".partition("e")
    sign, digits = ("-" if head[0] == "-" else ""), head.lstrip("-")
    whole, _, fraction = digits.partition(".")
    fraction = "" if fraction == "0" else fraction
    point = len(whole) + int(exponent or 0)
    plain = (whole + fraction).lstrip("0")
    point -= len(whole + fraction) - len(plain)
    plain = plain.rstrip("0") or "0"
    if 0 < point <= 16:
        return f"{sign}{plain[:point].ljust(point, '0')}.{plain[point:] or '0'}"
    if -5 < point <= 0:
        return f"{sign}0.{'0' * -point}{plain}"
    return f"{sign}{plain[0]}{'.' + plain[1:] if len(plain) > 1 else ''}e{point - 1}"


def _scalar(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return float_text(value) if isinstance(value, float) else str(value)


def flatten_value(value: Any, options: FlattenOptions = FlattenOptions()) -> dict[str, str]:
    if not isinstance(value, dict):
        raise FlattenError("flatten_not_object", "the top level is no object")
    out: dict[str, str] = {}

    def put(path: str, text: str) -> None:
        if len(out) >= options.max_fields:
            raise FlattenError("flatten_fields", f"more than {options.max_fields} fields")
        out.setdefault(path, text)

    def walk(node: Any, path: str, depth: int) -> None:
        if depth > options.max_depth:
            raise FlattenError("flatten_depth", f"deeper than {options.max_depth}")
        if isinstance(node, dict):
            for key in sorted(node, key=lambda k: k.encode("utf-8", "surrogatepass")):
                walk(node[key], f"{path}.{key}" if path else key, depth + 1)
        elif isinstance(node, list):
            scalars = [_scalar(x) for x in node if not isinstance(x, (dict, list))]
            if len(node) == 1 and scalars:
                put(path, scalars[0])
            elif not node:
                put(path, "")
            else:
                for i, x in enumerate(node):
                    walk(x, f"{path}.{i}", depth + 1)
                if scalars:
                    put(path, "\n".join(scalars))
        else:
            put(path, _scalar(node))

    for key in sorted(value, key=lambda k: k.encode("utf-8", "surrogatepass")):
        walk(value[key], key, 1)
    return out


def flatten_text(text: str, options: FlattenOptions = FlattenOptions()) -> dict[str, str]:
    return flatten_value(parse_json(text), options)


def multimap(fields: dict[str, str]) -> dict[str, list[str]]:
    """Values by lower-case key, in order of the original keys."""
    out: dict[str, list[str]] = {}
    for key in sorted(fields):
        out.setdefault(key.lower(), []).append(fields[key])
    return out
