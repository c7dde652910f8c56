"""Regular expressions in time linear in the text: all states of an automaton at once.

For patterns whose repetitions nest or overlap, on which a backtracking matcher may take for ever. A pattern becomes instructions,
and a text is read once with the set of instructions that may be next; repeated characters make known sets, whose successors are kept.
"""

from __future__ import annotations

import re
from functools import lru_cache

try:
    from re import _constants as C
    from re import _parser as parser
except ImportError:  # older versions
    import sre_constants as C
    import sre_parse as parser

#: Repetitions are written out up to so many instructions.
MOST = 20_000
_KEPT = 4096


class Unsupported(ValueError):
    pass


def is_risky(pattern: str) -> bool:
    """A repetition without bound inside or after another one that it can trade characters with."""
    try:
        tree = parser.parse(pattern, re.UNICODE)
    except (re.error, RecursionError, OverflowError):
        return False

    def unbounded(node) -> int:
        """How many unbounded repetitions the node has at most on a path, 99 if some nest."""
        total = 0
        for op, arg in node:
            if op in (C.MAX_REPEAT, C.MIN_REPEAT):
                low, high, body = arg
                inner = unbounded(body)
                wide = high is C.MAXREPEAT or high > 9
                if wide and (inner or any(o is C.BRANCH for o, _ in _flat(body))):
                    return 99
                total += inner * min(high, 99) if not wide else 1
            elif op is C.SUBPATTERN:
                total += unbounded(arg[3])
            elif op is C.BRANCH:
                total += max(unbounded(b) for b in arg[1])
        return min(total, 99)

    return unbounded(tree) > 4


def _flat(node):
    for op, arg in node:
        yield op, arg
        if op is C.SUBPATTERN:
            yield from _flat(arg[3])


class Automaton:
    """Instructions are (character test), (split, a, b), (assert, kind) and match."""

    def __init__(self, pattern: str, flags: int = 0):
        self.code: list[tuple] = []
        tree = parser.parse(pattern, flags | re.UNICODE)
        self._emit(tree, tree.state.flags)
        self.code.append(("match",))
        self.known: dict[tuple[frozenset, str, bool], frozenset] = {}

    def _add(self, *instruction) -> int:
        if len(self.code) > MOST:
            raise Unsupported("the pattern is too large")
        self.code.append(instruction)
        return len(self.code) - 1

    def _emit(self, node, flags: int) -> None:
        for op, arg in node:
            if op in (C.LITERAL, C.NOT_LITERAL, C.ANY, C.IN):
                self._add("char", _test(op, arg, flags))
            elif op is C.SUBPATTERN:
                _, on, off, body = arg
                self._emit(body, flags & ~off | on)
            elif op is C.BRANCH:
                self._branch([lambda b=b: self._emit(b, flags) for b in arg[1]])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                low, high, body = arg
                for _ in range(low):
                    self._emit(body, flags)
                if high is C.MAXREPEAT:
                    split = self._add("split", len(self.code) + 1, None)
                    self._emit(body, flags)
                    self._add("jump", split)
                    self.code[split] = ("split", split + 1, len(self.code))
                else:
                    splits = []
                    for _ in range(high - low):
                        splits.append(self._add("split", len(self.code) + 1, None))
                        self._emit(body, flags)
                    for s in splits:
                        self.code[s] = ("split", s + 1, len(self.code))
            elif op is C.AT:
                self._add("at", arg, bool(flags & re.MULTILINE))
            else:
                raise Unsupported(str(op))

    def _branch(self, parts: list) -> None:
        ends = []
        for i, part in enumerate(parts):
            last = i == len(parts) - 1
            split = None if last else self._add("split", len(self.code) + 1, None)
            part()
            if not last:
                ends.append(self._add("jump", None))
                self.code[split] = ("split", split + 1, len(self.code))
        for e in ends:
            self.code[e] = ("jump", len(self.code))

    def _closure(self, starts: set[int], before: str, after: str) -> set[int]:
        """Instructions reached without reading; before and after are the characters around, empty at the ends."""
        seen, stack = set(), list(starts)
        while stack:
            i = stack.pop()
            if i in seen:
                continue
            seen.add(i)
            match self.code[i]:
                case ("split", a, b):
                    stack += [a, b]
                case ("jump", a):
                    stack.append(a)
                case ("at", kind, multi):
                    if _at(kind, multi, before, after):
                        stack.append(i + 1)
        return seen

    def search(self, text: str) -> bool:
        current: set[int] = set()
        before, last = "", len(self.code) - 1
        for at in range(len(text) + 1):
            after = text[at] if at < len(text) else ""
            key = (frozenset(current), before, after)
            found = self.known.get(key)
            if found is None:
                closed = self._closure(current | {0}, before, after)
                found = frozenset({-1}) if last in closed else frozenset(i + 1 for i in closed if self.code[i][0] == "char" and after and self.code[i][1](after))
                if len(self.known) < _KEPT:
                    self.known[key] = found
            if -1 in found:
                return True
            current, before = set(found), after
        return False


def _word(c: str) -> bool:
    return bool(c) and (c.isalnum() or c == "_")


def _at(kind, multi: bool, before: str, after: str) -> bool:
    if kind is C.AT_BEGINNING_STRING or kind is C.AT_BEGINNING:
        return not before or multi and kind is C.AT_BEGINNING and before == "\n"
    if kind is C.AT_END_STRING or kind is C.AT_END:
        return not after or multi and kind is C.AT_END and after == "\n"
    if kind is C.AT_BOUNDARY:
        return _word(before) != _word(after)
    return _word(before) == _word(after)


def _test(op, arg, flags: int):
    """A test of one character, by a pattern of one item, which is the standard matcher's in constant time."""
    if op is C.ANY:
        return (lambda c: True) if flags & re.DOTALL else (lambda c: c != "\n")
    ignore = bool(flags & re.IGNORECASE)
    if op is C.LITERAL or op is C.NOT_LITERAL:
        same = {chr(arg), *((chr(arg).lower(), chr(arg).upper(), chr(arg).casefold()) if ignore else ())}
        return (lambda c: c in same or ignore and c.lower() in same) if op is C.LITERAL else (lambda c: not (c in same or ignore and c.lower() in same))
    negate = bool(arg) and arg[0][0] is C.NEGATE
    items = arg[1:] if negate else arg
    kinds = {C.CATEGORY_DIGIT: str.isdecimal, C.CATEGORY_SPACE: str.isspace, C.CATEGORY_WORD: _word}
    opposite = {C.CATEGORY_NOT_DIGIT: C.CATEGORY_DIGIT, C.CATEGORY_NOT_SPACE: C.CATEGORY_SPACE, C.CATEGORY_NOT_WORD: C.CATEGORY_WORD}

    def one(c: str) -> bool:
        for kind, value in items:
            if kind is C.LITERAL and ord(c) == value or kind is C.RANGE and value[0] <= ord(c) <= value[1]:
                return True
            if kind is C.CATEGORY and (kinds[value](c) if value in kinds else not kinds[opposite[value]](c)):
                return True
        return False

    return lambda c: negate != (one(c) or ignore and (one(c.lower()) or one(c.upper())))


@lru_cache(maxsize=256)
def automaton_of(pattern: str, modifiers: tuple[str, ...]) -> Automaton:
    """For a rule's pattern, with the flags that its modifiers mean."""
    multi, dot = "m" in modifiers, "s" in modifiers
    flags = (re.MULTILINE if multi else 0) | (re.DOTALL if dot else 0)
    if not (pattern.startswith("(?") and not flags):
        flags |= re.IGNORECASE
    return Automaton(pattern.replace(r"\z", r"\Z"), flags)


def search(pattern: str, modifiers: tuple[str, ...], text: str) -> bool:
    return automaton_of(pattern, modifiers).search(text)
