"""Wildcards: * is any run, ? is one character, a backslash makes these and itself literal, and else stands for itself."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\\([*?\\])|(\*)|(\?)|(.)", re.DOTALL)
_MARKS = re.compile(r"([^0-9A-Za-z_\s\x80-\U0010FFFF])")


def tokens(pattern: str) -> list[tuple[str, str]]:
    """(kind, character), kind being run, one or literal."""
    out = []
    for escaped, run, one, plain in _TOKEN.findall(pattern):
        out.append(("run", "*") if run else ("one", "?") if one else ("literal", escaped or plain))
    return out


def literal_of(pattern: str) -> str | None:
    """The text that a pattern without wildcards stands for; None if it has some."""
    found = tokens(pattern)
    return "".join(c for _, c in found) if all(k == "literal" for k, _ in found) else None


def quoted(text: str) -> str:
    return _MARKS.sub(r"\\\1", text)


def java_pattern(pattern: str, before: bool = False, after: bool = False) -> str:
    """A regular expression to search for. before, after: text may stand before or after what the pattern matches.

    Between runs each part is taken where it first occurs, in an atomic group: no other choice can help a later part, so time stays
    linear in the text for each part.
    """
    found = tokens(pattern)
    parts: list[str] = [""]
    for kind, c in found:
        if kind == "run":
            parts.append("")
        else:
            parts[-1] += "." if kind == "one" else quoted(c)
    parts = ([""] if before else []) + parts + ([""] if after else [])
    if len(parts) == 1:
        return rf"(?s)\A{parts[0]}\z"
    first, *middle, last = parts
    body = "".join(f"(?>.*?{p})" for p in middle if p)
    return rf"(?s)\A{first}{body}" + (rf".*{last}\z" if last else "")
