"""Values of rules as text, and the transforms that replace them before matching."""

from __future__ import annotations

import base64
from collections.abc import Callable

DASHES = "-/\u2013\u2014\u2015"


def value_text(value: str | int | float | bool | None) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return float_text(value)
    return str(value)


def float_text(value: float) -> str:
    """Without an exponent, and without a fraction that is zero."""
    if value != value:
        return "NaN"
    if value in (float("inf"), float("-inf")):
        return "inf" if value > 0 else "-inf"
    from decimal import Decimal

    text = format(Decimal(repr(value)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def encoded(text: str) -> list[str]:
    return [base64.b64encode(text.encode()).decode()]


def encoded_offsets(text: str) -> list[str]:
    """What of the encoding does not depend on the 0, 1 or 2 bytes before the text and on what follows it."""
    data, out = text.encode(), []
    for shift in range(3):
        code = base64.b64encode(b" " * shift + data).decode()
        first, spare = (0, 2, 3)[shift], (0, 3, 2)[(shift + len(data)) % 3]
        out.append(code[first : max(len(code) - spare, first)])
    return [c for c in out if c]


def wide(text: str) -> list[str]:
    return ["".join(c + "\0" for c in text)]


def dashes(text: str) -> list[str]:
    if not any(d in text for d in DASHES):
        return [text]
    return list(dict.fromkeys([text, *("".join(d if c in DASHES else c for c in text) for d in DASHES)]))


_BY_NAME: dict[str, Callable[[str], list[str]]] = {"base64": encoded, "base64offset": encoded_offsets, "wide": wide, "windash": dashes}


def transformed(values: list, modifiers: tuple[str, ...]) -> list:
    """The values after the transforms among the modifiers, in their order. What stays as it is keeps its type."""
    for name in modifiers:
        if name in _BY_NAME:
            out: list = []
            for value in values:
                text = value_text(value)
                new = _BY_NAME[name](text) if text else [text]
                out += [value if t == text else t for t in new]
            values = out
    return values
