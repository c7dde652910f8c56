"""What rules mean, in plain Python over one event, independent of the SQL that the engine emits."""

from __future__ import annotations

import base64
import ipaddress
import re

from tamarack.functions.fields import FieldMapping
from tamarack.plans.condition import compile_condition, evaluate
from tamarack.plans.rules import Rule, Test

FLOAT = re.compile(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)\Z", re.IGNORECASE | re.ASCII)


def as_text(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v:.20f}".rstrip("0").rstrip(".")
    return str(v)


def glob(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and pattern[i + 1 : i + 2] in ("*", "?", "\\") and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 1
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return out


def expand(values: list, modifiers) -> list:
    for m in modifiers:
        if m == "base64":
            values = [base64.b64encode(as_text(v).encode()).decode() if as_text(v) else v for v in values]
        elif m == "wide":
            values = ["".join(c + "\0" for c in as_text(v)) if as_text(v) else v for v in values]
        elif m == "windash":
            out = []
            for v in values:
                out.append(v)
                out += [t for d in "-/–—―" if (t := re.sub("[-/–—―]", d, as_text(v))) != as_text(v)]
            values = list(dict.fromkeys(out))
        elif m == "base64offset":
            out = []
            for v in values:
                if not as_text(v):
                    out.append(v)
                    continue
                for k in range(3):
                    data = b" " * k + as_text(v).encode()
                    code = base64.b64encode(data).decode()
                    out.append(code[(0, 2, 3)[k] : len(code) - (0, 3, 2)[len(data) % 3]])
            values = [v for v in out if v != ""]
    return values


def holds(value, modifiers, raw: str) -> bool:
    text = as_text(value)
    if "re" in modifiers:
        flags = (re.MULTILINE if "m" in modifiers else 0) | (re.DOTALL if "s" in modifiers else 0)
        if not (text.startswith("(?") and not flags):
            flags |= re.IGNORECASE
        return re.search(text.replace("$", r"\Z") if not flags & re.MULTILINE else text, raw, flags) is not None
    if value is None:
        return raw == ""
    op = next((o for o in ("gt", "gte", "lt", "lte") if o in modifiers), None)
    if op:
        compare = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}[op]
        if isinstance(value, bool):
            return False
        if isinstance(value, int) and re.fullmatch(r"[+-]?[0-9]+", raw.strip()) and -(2**63) <= int(raw) < 2**63:
            return compare(int(raw), value)
        if not isinstance(value, str) or FLOAT.match(value):
            return bool(FLOAT.match(raw)) and compare(float(raw), float(value))
    if "cidr" in modifiers:
        if "/" not in text or "%" in raw:
            return False
        try:
            return ipaddress.ip_address(raw.strip()) in ipaddress.ip_network(text, strict=False)
        except ValueError:
            return False
    body = glob(text.lower())
    before = ".*" if "contains" in modifiers or "endswith" in modifiers and "startswith" not in modifiers else ""
    after = ".*" if "contains" in modifiers or "startswith" in modifiers else ""
    return re.fullmatch(before + body + after, raw.lower(), re.DOTALL) is not None


def test_holds(test: Test, event: dict[str, list[str]], mapping: FieldMapping) -> bool:
    if test.field:
        values = [v for k in mapping.keys_of(test.field) for v in event.get(k, [])]
    else:
        values = [v for vs in event.values() for v in vs]
    if "exists" in test.modifiers:
        want = test.values[0] if test.values else True
        expected = bool(want) if isinstance(want, (bool, int)) else want not in ("false", "0")
        return bool(values) == expected
    join = all if "all" in test.modifiers else any
    if "fieldref" in test.modifiers:
        if not values:
            return False

        def same(name) -> bool:
            other = [v for k in mapping.keys_of(as_text(name)) for v in event.get(k, [])]
            if not other:
                return False
            a, b = values[0].lower(), other[0].lower()
            return b in a if "contains" in test.modifiers else a.startswith(b) if "startswith" in test.modifiers else a.endswith(b) if "endswith" in test.modifiers else a == b

        return join(same(n) for n in test.values)
    wanted = expand(list(test.values), test.modifiers)
    return any(join(holds(w, test.modifiers, v) for w in wanted) for v in values)


test_holds.__test__ = False


def rule_holds(rule: Rule, event: dict[str, str | None], mapping: FieldMapping | None = None) -> bool:
    mapping = mapping or FieldMapping()
    folded: dict[str, list[str]] = {}
    for k, v in event.items():
        if v is not None:
            folded.setdefault(k.lower(), []).append(v)
    for part in ("category", "product", "service"):
        want = getattr(rule.logsource, part)
        got = folded.get(f"event_{part}") or folded.get(part) or [None]
        if want is not None and (got[0] or "").lower() != want.lower():
            return False
    true = {i.name: any(all(test_holds(t, folded, mapping) for t in g) for g in i.groups) for i in rule.identifiers}
    return any(evaluate(compile_condition(c, list(true)), true.__getitem__) for c in rule.conditions)
