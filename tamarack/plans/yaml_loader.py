"""YAML of rules: core-schema scalars (no dates, no yes/no, no sexagesimals) and no duplicate keys."""

from __future__ import annotations

import re
from typing import Any

import yaml

from ..errors import ParseError


class _Loader(yaml.SafeLoader):
    pass


_Loader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789"),
    ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+0123456789."),
    ("null", r"^(?:~|null|Null|NULL|)$", "~nN\0"),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), list(_first) + ([""] if _tag == "null" else []))


def _mapping(loader: _Loader, node: yaml.MappingNode) -> dict:
    out: dict = {}
    for key_node, value_node in node.value:
        key = loader.construct_object(key_node, deep=True)
        try:
            known = key in out
        except TypeError as error:
            raise ParseError("yaml", f"a mapping key that is no scalar: {error}") from error
        if known:
            raise ParseError("yaml", f"duplicate key {key!r}")
        out[key] = loader.construct_object(value_node, deep=True)
    return out


def _int(loader: _Loader, node: yaml.ScalarNode) -> int:
    text = loader.construct_scalar(node)
    return int(text, 8) if text.startswith("0o") else int(text, 16) if text.startswith("0x") else int(text)


_Loader.add_constructor("tag:yaml.org,2002:map", _mapping)
_Loader.add_constructor("tag:yaml.org,2002:int", _int)


def load(text: str) -> Any:
    try:
        return yaml.load(text, Loader=_Loader)  # noqa: S506  a SafeLoader with fewer resolvers
    except ParseError:
        raise
    except (yaml.YAMLError, ValueError, RecursionError) as error:
        raise ParseError("yaml", str(error)) from error
