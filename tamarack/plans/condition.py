"""Conditions: identifiers with and, or, not, parentheses and quantifiers, parsed into nested tuples.

A node is ("id", name), ("not", node), ("and", nodes), ("or", nodes) or ("of", count, names); count 0 is all.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..errors import ConditionError

WORD = r"[\w.*-]+"
_TOKEN = re.compile(rf"\s*(?:(?P<mark>[(),|])|(?P<word>{WORD})|(?P<other>\S))")
_KEYWORDS = {"and", "or", "not", "of", "all", "them"}

Node = tuple


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text), kind being the keyword or mark itself, `number`, `name`, `invalid` or, last, `end`."""
    out = []
    for m in _TOKEN.finditer(text):
        if word := m["word"]:
            kind = word.lower() if word.lower() in _KEYWORDS else "number" if word.isdecimal() and word.isascii() else "name"
            out.append((kind, word))
        else:
            out.append((m["mark"] or "invalid", m["mark"] or m["other"]))
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str, names: list[str]):
        self.tokens, self.names, self.at = tokens(text), names, 0

    def peek(self) -> str:
        return self.tokens[self.at][0]

    def take(self, *kinds: str) -> str:
        kind, text = self.tokens[self.at]
        if kind not in kinds:
            raise ConditionError("unexpected_token", f"expected {' or '.join(kinds)}, got {text or 'the end'!r}")
        self.at += 1
        return text

    def chain(self, word: str, below: Callable[[], Node]) -> Node:
        nodes = [below()]
        while self.peek() == word:
            self.take(word)
            nodes.append(below())
        return nodes[0] if len(nodes) == 1 else (word, tuple(nodes))

    def expression(self) -> Node:
        return self.chain("or", lambda: self.chain("and", self.negation))

    def negation(self) -> Node:
        negated = False
        while self.peek() == "not":
            self.take("not")
            negated = not negated
        node = self.primary()
        return ("not", node) if negated else node

    def primary(self) -> Node:
        kind = self.peek()
        text = self.take("(", "number", "all", "name")
        if kind == "(":
            node = self.expression()
            self.take(")")
            return node
        if kind == "name":
            return ("id", text)
        self.take("of")
        return ("of", int(text) if kind == "number" else 0, tuple(self.target()))

    def matching(self, pattern: str) -> list[str]:
        if "*" not in pattern:
            return [pattern]
        return [n for n in self.names if n.startswith(pattern.rstrip("*"))]

    def target(self) -> list[str]:
        kind = self.peek()
        text = self.take("them", "name", "(")
        if kind == "them":
            return list(self.names)
        if kind == "name":
            return self.matching(text)
        out: list[str] = []
        while True:
            for name in self.matching(self.take("name")):
                if name in out:
                    raise ConditionError("duplicate_identifier", f"{name} is twice in a list")
                out.append(name)
            if self.take(",", ")") == ")":
                return out


def compile_condition(text: str, names: list[str]) -> Node:
    if not text.strip():
        raise ConditionError("empty_condition", "the condition is empty")
    parser = _Parser(text, names)
    node = parser.expression()
    parser.take("end")
    return node


def names_in(node: Node) -> set[str]:
    match node:
        case ("id", name):
            return {name}
        case ("not", inner):
            return names_in(inner)
        case ("of", _, names):
            return set(names)
        case (_, nodes):
            return set().union(*(names_in(n) for n in nodes))
    raise AssertionError(node)


def evaluate(node: Node, true: Callable[[str], bool]) -> bool:
    """The node's truth where `true` tells that of identifiers."""
    match node:
        case ("id", name):
            return true(name)
        case ("not", inner):
            return not evaluate(inner, true)
        case ("of", count, names):
            return sum(map(true, names)) >= (count or max(1, len(names)))
        case ("and", nodes):
            return all(evaluate(n, true) for n in nodes)
        case ("or", nodes):
            return any(evaluate(n, true) for n in nodes)
    raise AssertionError(node)
