"""What an event needs for a rule to hold: one of some last parts of a path, so that few rules are tested on an event.

A test `Image|endswith: '\\tool.exe'` can hold only where the field's last part after a backslash is tool.exe. From such tests
follows, through identifiers and conditions, a set of last parts of one field without which a rule cannot hold. That is necessary,
not sufficient: rules whose last part is there are tested as before, and rules without such a need are always tested. So no match is lost.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from ..functions.sqltext import sql_str
from ..functions.transforms import value_text
from ..functions.wildcard import literal_of
from .condition import Node
from .emit import Layout
from .rules import Identifier, Test

#: Fields, each with last parts of which the event's field must have one; each field alone is necessary.
Need = dict[str, frozenset[str]]

#: Rules that stand behind one test of last parts.
PART = 32


def _both(needs: Iterable[Need]) -> Need:
    """All hold, so each need stands; of two for one field the smaller."""
    out: Need = {}
    for need in needs:
        for field, names in need.items():
            if field not in out or len(names) < len(out[field]):
                out[field] = names
    return out


def _either(needs: list[Need]) -> Need:
    """One of them holds: only fields that each needs, with the last parts of all."""
    fields = set.intersection(*(set(n) for n in needs)) if needs else set()
    return {f: frozenset().union(*(n[f] for n in needs)) for f in fields}


def _of_test(test: Test) -> Need:
    if not test.field or not test.values or set(test.modifiers) != {"endswith"}:
        return {}
    plain = [literal_of(value_text(v).lower()) if isinstance(v, str) else None for v in test.values]
    if any(p is None or "\\" not in p for p in plain):
        return {}
    return {test.field: frozenset(p.rsplit("\\", 1)[1] for p in plain)}


def _of_identifier(identifier: Identifier) -> Need:
    return _either([_both(map(_of_test, group)) for group in identifier.groups])


def _of_node(node: Node, identifiers: dict[str, Need]) -> Need:
    match node:
        case ("id", name):
            return identifiers[name]
        case ("not", _):
            return {}
        case ("of", count, names):
            parts = [identifiers[n] for n in names]
            return _both(parts) if (count or len(parts)) == len(parts) else _either(parts)
        case ("and", nodes):
            return _both(_of_node(n, identifiers) for n in nodes)
        case (_, nodes):
            return _either([_of_node(n, identifiers) for n in nodes])
    raise AssertionError(node)


def need_of(identifiers: Iterable[Identifier], nodes: Iterable[Node]) -> tuple[str, frozenset[str]] | None:
    """The field and its last parts of which a rule needs one, the fewest if there are several fields; None if it needs none."""
    known = {i.name: _of_identifier(i) for i in identifiers}
    need = _either([_of_node(n, known) for n in nodes])
    return min(need.items(), key=lambda x: (len(x[1]), x[0])) if need else None


def parts_of(needs: dict[int, tuple[str, frozenset[str]] | None]) -> list[tuple[tuple[str, frozenset[str]] | None, list[int]]]:
    """Places of rules with their needs to parts: a field with the last parts of all the part's rules, and their places.

    Rules of similar last parts come together. The places that need none are the last part.
    """
    by_field: dict[str, list[int]] = defaultdict(list)
    for place, need in needs.items():
        if need:
            by_field[need[0]].append(place)
    out: list[tuple[tuple[str, frozenset[str]] | None, list[int]]] = []
    for field, places in by_field.items():
        places.sort(key=lambda p: (min(needs[p][1]), p))
        for at in range(0, len(places), PART):
            own = places[at : at + PART]
            out.append(((field, frozenset().union(*(needs[p][1] for p in own))), own))
    rest = [p for p, need in needs.items() if not need]
    return [*out, (None, rest)] if rest else out


def need_sql(field: str, names: frozenset[str], layout: Layout) -> str:
    """Whether the field has one of the last parts. More than a few literals are looked up by hash."""
    listed = ", ".join(map(sql_str, sorted(names)))
    return layout.any(field, lambda raw, low: f"substring_index({low}, {sql_str(chr(92))}, -1) IN ({listed})")
