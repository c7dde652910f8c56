"""Rules as SQL text over one of two layouts of events.

Columns: an event is a row, its fields are columns; a null is an absent field. Map: an event has a map from lower-case keys to
all values of the key. Every test is wrapped so that it is true or false and never null, so NOT of an absent field is true.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.fields import FieldMapping
from ..functions.linear import Unsupported, automaton_of, is_risky
from ..functions.network import in_network
from ..functions.numbers import compare, operator_of
from ..functions.regex import java_regex
from ..functions.sqltext import all_of, any_of, sql_name, sql_str
from ..functions.transforms import transformed, value_text
from ..functions.wildcard import java_pattern, literal_of
from .condition import Node
from .rules import Identifier, LogSource, Scalar, Test

#: The function that a session has to have for patterns that could backtrack for ever: (values, patterns, modifiers, every) to boolean.
LINEAR_MATCH = "tamarack_linear_match"

#: SQL of a test of one value, given SQL of the value and of its lower case.
Predicate = Callable[[str, str], str]


@dataclass
class Columns:
    """columns: the names of the event's fields."""

    columns: list[str]
    mapping: FieldMapping
    #: Names of the columns that are to hold results of automata beforehand, by their SQL, as array functions cannot call Python.
    linear: dict[str, str] | None = None
    #: Fields that only tests by name see, not those of all fields.
    named: list[str] = field(default_factory=list)

    def _found(self, field: str) -> list[str]:
        keys = self.mapping.keys_of(field)
        return [c for c in (*self.columns, *self.named) if c.lower() in keys]

    def present(self, field: str) -> str:
        return any_of([f"{sql_name(c)} IS NOT NULL" for c in self._found(field)])

    def _text(self, column: str) -> str:
        return f"CAST({sql_name(column)} AS STRING)"

    def any(self, field: str, test: Predicate) -> str:
        found = self._found(field) if field else self.columns
        return any_of([f"coalesce({test(self._text(c), f'lower({self._text(c)})')}, false)" for c in found])

    def array(self, field: str) -> str:
        """All values of the field."""
        found = self._found(field) if field else self.columns
        return f"array_compact(array({', '.join(map(self._text, found))}))" if found else "CAST(array() AS ARRAY<STRING>)"

    def has(self, field: str, test: str) -> str:
        """test, if the field is present."""
        return all_of([self.present(field) if field else any_of([f"{sql_name(c)} IS NOT NULL" for c in self.columns]), test])

    def first(self, field: str) -> str:
        found = [self._text(c) for c in self._found(field)]
        return f"coalesce({', '.join(found)})" if found else "CAST(NULL AS STRING)"


@dataclass
class MapEvents:
    """column: the name of a MAP<STRING, ARRAY<STRING>>."""

    column: str
    mapping: FieldMapping
    linear: dict[str, str] | None = field(default_factory=dict)

    def _values(self, field: str) -> str:
        parts = [f"{sql_name(self.column)}[{sql_str(k)}]" for k in self.mapping.keys_of(field)]
        return parts[0] if len(parts) == 1 else f"concat({', '.join(f'coalesce({p}, array())' for p in parts)})"

    def present(self, field: str) -> str:
        return any_of([f"coalesce(map_contains_key({sql_name(self.column)}, {sql_str(k)}), false)" for k in self.mapping.keys_of(field)])

    def array(self, field: str) -> str:
        return f"coalesce({self._values(field) if field else f'flatten(map_values({sql_name(self.column)}))'}, array())"

    def any(self, field: str, test: Predicate) -> str:
        values = self._values(field) if field else f"flatten(map_values({sql_name(self.column)}))"
        return f"coalesce(exists({values}, v -> coalesce({test('v', 'lower(v)')}, false)), false)"

    def has(self, field: str, test: str) -> str:
        return all_of([self.present(field) if field else f"coalesce(size({sql_name(self.column)}) > 0, false)", test])

    def first(self, field: str) -> str:
        return f"get({self._values(field)}, 0)"


Layout = Columns | MapEvents


def value_test(value: Scalar, modifiers: tuple[str, ...]) -> Predicate:
    """One value of a rule against one of an event."""
    text = value_text(value)
    if "re" in modifiers:
        pattern = sql_str(java_regex(text, modifiers))
        return lambda raw, low: f"{raw} RLIKE {pattern}"
    if value is None:
        return lambda raw, low: f"{raw} = ''"
    operator = operator_of(modifiers)
    if operator and compare("x", operator, value) is not None:
        return lambda raw, low: compare(raw, operator, value) or "false"
    if "cidr" in modifiers:
        return lambda raw, low: in_network(raw, text)
    folded = text.lower()
    plain = literal_of(folded)
    kind = next((m for m in ("contains", "startswith", "endswith") if m in modifiers), "exact")
    if plain is None:
        pattern = sql_str(java_pattern(folded, before=kind in ("contains", "endswith"), after=kind in ("contains", "startswith")))
        return lambda raw, low: f"{low} RLIKE {pattern}"
    literal = sql_str(plain)
    if kind == "exact":
        return lambda raw, low: f"{low} = {literal}"
    return lambda raw, low: f"{kind}({low}, {literal})"


def needs_linear(test: Test) -> bool:
    """Whether a pattern of the test is left to the automaton."""
    if "re" not in test.modifiers:
        return False
    for value in transformed(list(test.values), test.modifiers):
        text = value_text(value)
        java_regex(text, test.modifiers)
        try:
            if is_risky(text) and automaton_of(text, test.modifiers):
                return True
        except Unsupported:
            continue
    return False


def _expects_presence(test: Test) -> bool:
    value = test.values[0] if test.values else True
    if isinstance(value, (bool, int)):
        return bool(value)
    return value not in ("false", "0") if isinstance(value, str) else True


def test_sql(test: Test, layout: Layout) -> str:
    modifiers, every = test.modifiers, "all" in test.modifiers
    if "exists" in modifiers:
        present = layout.present(test.field)
        return present if _expects_presence(test) else f"(NOT {present})"
    if "fieldref" in modifiers:
        kind = next((m for m in ("contains", "startswith", "endswith") if m in modifiers), None)
        own = f"lower({layout.first(test.field)})"
        parts = []
        for value in test.values:
            other = f"lower({layout.first(value_text(value))})"
            parts.append(f"coalesce({f'{kind}({own}, {other})' if kind else f'{own} = {other}'}, false)")
        return layout.has(test.field, all_of(parts)) if every else any_of(parts)
    values = transformed(list(test.values), modifiers)
    if not values:
        return layout.has(test.field, "true") if every else "false"
    if needs_linear(test):
        listed = lambda items: f"array({', '.join(map(sql_str, items))})"
        call = f"coalesce({LINEAR_MATCH}({layout.array(test.field)}, {listed([value_text(v) for v in values])}, {listed(modifiers)}, {str(every).lower()}), false)"
        if layout.linear is None:
            return call
        return sql_name(layout.linear.setdefault(call, f"__linear{len(layout.linear)}"))
    tests = [value_test(v, modifiers) for v in values]
    join = all_of if every else any_of
    return layout.any(test.field, lambda raw, low: join([f"coalesce({t(raw, low)}, false)" for t in tests]))


def cost(test: Test) -> int:
    """Cheap tests come first in a conjunction."""
    weight = 1
    for names, w in ((("exists",), 0), (("startswith", "endswith"), 2), (("gt", "gte", "lt", "lte", "fieldref"), 3), (("contains",), 4), (("cidr",), 8), (("re",), 12)):
        if any(n in test.modifiers for n in names):
            weight = w
    return (weight * max(1, len(test.values))) * (10 if not test.field else 1)


def identifier_sql(identifier: Identifier, layout: Layout) -> str:
    groups = [all_of([test_sql(t, layout) for t in sorted(group, key=cost)]) for group in identifier.groups]
    return any_of(groups)


def condition_sql(node: Node, identifiers: dict[str, str]) -> str:
    match node:
        case ("id", name):
            return identifiers[name]
        case ("not", inner):
            return f"(NOT {condition_sql(inner, identifiers)})"
        case ("of", count, names):
            parts = [identifiers[n] for n in names]
            need = count or len(parts)
            if not parts or need > len(parts):
                return "false"
            if need == 1 and count:
                return any_of(parts)
            if need == len(parts):
                return all_of(parts)
            return f"({' + '.join(f'int({p})' for p in parts)} >= {need})"
        case (word, nodes):
            return (all_of if word == "and" else any_of)([condition_sql(n, identifiers) for n in nodes])
    raise AssertionError(node)


def logsource_sql(source: LogSource, layout: Layout) -> str:
    """Each part that the rule names must be the event's, which is under event_category or category, and so on."""
    parts = []
    for part in ("category", "product", "service"):
        want = getattr(source, part)
        if want is not None:
            found = f"coalesce({layout.first(f'event_{part}')}, {layout.first(part)})"
            parts.append(f"coalesce(lower({found}) = {sql_str(want.lower())}, false)")
    return all_of(parts)
