"""Rules as written: metadata, identifiers with their field tests, and conditions as text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from ..errors import ParseError
from . import yaml_loader
from .condition import WORD

Scalar = str | int | float | bool | None

#: Severity levels with their scores, and states of rules.
LEVELS = {"informational": 0.1, "low": 0.3, "medium": 0.5, "high": 0.7, "critical": 0.9}
STATUSES = ("experimental", "test", "stable", "deprecated", "unsupported")
#: Modifiers of a field.
MODIFIERS = (
    "contains", "startswith", "endswith", "re", "i", "m", "s", "cidr", "all",
    "base64", "base64offset", "wide", "windash", "gt", "gte", "lt", "lte", "exists", "fieldref",
)
TRANSFORMS = ("base64", "base64offset", "wide", "windash")
#: Words in a condition that name no identifier.
RESERVED = {"and", "or", "not", "all", "of", "them", "count", "near", "by", "avg", "sum", "min", "max"}


@dataclass(frozen=True)
class Test:
    """One field with its modifiers and values. The empty field is a keyword: it is any of the event's values."""

    field: str
    values: tuple[Scalar, ...]
    modifiers: tuple[str, ...] = ()


@dataclass(frozen=True)
class Identifier:
    """An OR of groups, each an AND of tests."""

    name: str
    groups: tuple[tuple[Test, ...], ...]


@dataclass(frozen=True)
class LogSource:
    category: str | None = None
    product: str | None = None
    service: str | None = None


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    identifiers: tuple[Identifier, ...]
    conditions: tuple[str, ...]
    logsource: LogSource = LogSource()
    description: str = ""
    status: str = "test"
    level: str = "medium"
    author: str = ""
    date: str = ""
    modified: str = ""
    references: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    falsepositives: tuple[str, ...] = ()
    custom_fields: dict[str, Any] = field(default_factory=dict, hash=False)

    @property
    def score(self) -> float:
        return LEVELS[self.level]


def rule_id(title: str) -> str:
    """The id of a rule that has none: two FNV-1a hashes of its title, forwards and backwards, in the shape of a UUID."""
    prime, mask = 0x100000001B3, (1 << 64) - 1

    def fnv(data: bytes, start: int) -> int:
        for byte in data:
            start = ((start ^ byte) * prime) & mask
        return start

    data = title.encode()
    head, tail = fnv(data, 0xCBF29CE484222325), fnv(data[::-1], 0x14650FB0739D0383)
    parts = (head >> 32, head >> 16 & 0xFFFF, head & 0xFFF | 0x4000, tail >> 48 & 0x3FFF | 0x8000, tail & 0xFFFFFFFFFFFF)
    return "{:08x}-{:04x}-{:04x}-{:04x}-{:012x}".format(*parts)


def parse_rule(text: str) -> Rule:
    """A rule from one YAML document."""
    data = yaml_loader.load(text)
    if not isinstance(data, dict):
        raise ParseError("yaml", "a rule is a mapping")
    title = _text(data, "title", required=True)
    if not title:
        raise ParseError("missing_field", "title")
    detection = data.get("detection")
    if not isinstance(detection, dict):
        raise ParseError("yaml", "detection is missing or no mapping")
    identifiers = tuple(_identifier(str(name), body) for name, body in detection.items() if name != "condition")
    conditions = _conditions(detection)
    if not identifiers:
        raise ParseError("empty_detection", "detection has no identifier")
    for condition in conditions:
        _check_condition(condition, [i.name for i in identifiers])
    level, status = _choice(data, "level", LEVELS, "medium"), _choice(data, "status", STATUSES, "test")
    known = {"title", "id", "description", "status", "level", "author", "date", "modified", "references", "tags", "logsource", "detection", "falsepositives"}
    return Rule(
        id=_text(data, "id") or rule_id(title), title=title, identifiers=identifiers, conditions=conditions, logsource=_logsource(data.get("logsource")),
        description=_text(data, "description"), status=status, level=level, author=_text(data, "author"), date=_text(data, "date"), modified=_text(data, "modified"),
        references=_texts(data, "references"), tags=_texts(data, "tags"), falsepositives=_texts(data, "falsepositives"),
        custom_fields={str(k): v for k, v in data.items() if k not in known},
    )


def split_documents(text: str) -> list[str]:
    """Documents between lines that begin with ---; empty ones are left out, and one bad document spoils no other."""
    plain = re.sub(r"\r\n?", "\n", text)
    return [d for d in (part.strip() for part in plain.split("\n---")) if d not in ("", "---")]


def parse_rules(text: str) -> list[Rule | ParseError]:
    out: list[Rule | ParseError] = []
    for document in split_documents(text):
        try:
            out.append(parse_rule(document))
        except ParseError as error:
            out.append(error)
    return out


def _text(data: dict, key: str, required: bool = False) -> str:
    value = data.get(key)
    if value is None:
        if required and key not in data:
            raise ParseError("yaml", f"{key} is missing")
        return ""
    if not isinstance(value, str):
        raise ParseError("yaml", f"{key} is no text")
    return value


def _texts(data: dict, key: str) -> tuple[str, ...]:
    value = data.get(key)
    if value is None:
        return ()
    if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
        raise ParseError("yaml", f"{key} is no list of texts")
    return tuple(value)


def _choice(data: dict, key: str, allowed: Any, default: str) -> str:
    value = data.get(key, default)
    if value not in allowed:
        raise ParseError("yaml", f"{key} is {value!r}")
    return value


def _logsource(value: Any) -> LogSource:
    if value is None:
        return LogSource()
    if not isinstance(value, dict):
        raise ParseError("yaml", "logsource is no mapping")
    parts = {k: value.get(k) for k in ("category", "product", "service")}
    if any(v is not None and not isinstance(v, str) for v in parts.values()):
        raise ParseError("yaml", "logsource has values that are no texts")
    return LogSource(**parts)


def _conditions(detection: dict) -> tuple[str, ...]:
    value = detection.get("condition")
    if isinstance(value, str):
        return (value,)
    if isinstance(value, list) and all(isinstance(v, str) for v in value):
        return tuple(value)
    raise ParseError("yaml", "condition is missing or neither a text nor a list of texts")


def _check_condition(condition: str, names: list[str]) -> None:
    if "|" in condition:
        raise ParseError("validation", f"aggregation after a pipe is not supported: {condition!r}")
    for word in re.findall(WORD, condition):
        if word.lower() in RESERVED or word.isdecimal() and word.isascii():
            continue
        found = any(n.startswith(word[:-1]) for n in names) if word.endswith("*") else word in names
        if not found:
            raise ParseError("invalid_condition", f"{word!r} is in a condition but not in detection")


def _scalar(value: Any) -> Scalar:
    if isinstance(value, (dict, list)):
        raise ParseError("validation", "a value is a list or mapping inside a list")
    if isinstance(value, int) and not isinstance(value, bool) and not -(1 << 63) <= value < 1 << 63:
        return float(value)
    return value


def _identifier(name: str, body: Any) -> Identifier:
    if isinstance(body, dict):
        return Identifier(name, (_group(name, body),))
    if not isinstance(body, list):
        return Identifier(name, ((Test("", (_scalar(body),), ("contains",)),),))
    if not body:
        raise ParseError("empty_detection", f"{name} is an empty list")
    if all(isinstance(item, dict) for item in body):
        return Identifier(name, tuple(_group(name, item) for item in body))
    return Identifier(name, ((Test("", tuple(_scalar(v) for v in body), ("contains",)),),))


def _group(name: str, body: dict) -> tuple[Test, ...]:
    tests = []
    for key, value in body.items():
        if not isinstance(key, str):
            raise ParseError("validation", f"{name} has a key that is no text")
        column, *modifiers = key.split("|")
        modifiers = [m.lower() for m in modifiers]
        for i, modifier in enumerate(modifiers):
            if modifier not in MODIFIERS or modifier in ("i", "m", "s") and "re" not in modifiers[:i]:
                raise ParseError("invalid_modifier", f"{name}.{column}: {modifier}")
        values = value if isinstance(value, list) else [value]
        tests.append(Test(column, tuple(_scalar(v) for v in values), tuple(modifiers)))
    return tuple(tests)
