"""Detection rules over Spark DataFrames: rules compile to SQL predicates, events are a DataFrame, alerts are a DataFrame."""

from .errors import CompileError, ConditionError, EngineError, FlattenError, ParseError, RuleError
from .operators.engine import RuleSet, detect, detect_batch, detect_count

__all__ = ["CompileError", "ConditionError", "EngineError", "FlattenError", "ParseError", "RuleError", "RuleSet", "detect", "detect_batch", "detect_count"]
