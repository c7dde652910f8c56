"""Errors of rules, conditions, the engine and the flattener. `kind` names the case."""

from __future__ import annotations


class RuleError(ValueError):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


class ParseError(RuleError):
    """kind: yaml, missing_field, empty_detection, invalid_modifier, invalid_condition or validation."""


class ConditionError(RuleError):
    """kind: unexpected_token, empty_condition or duplicate_identifier."""


class CompileError(RuleError):
    """kind: invalid_regex or unsupported_value."""


class EngineError(RuleError):
    """kind: parse, condition or regex, with the cause chained."""


class FlattenError(RuleError):
    """kind: json_parse, flatten_not_object, flatten_depth or flatten_fields."""
