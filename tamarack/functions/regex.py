"""Regular expressions of rules, in a linear-time Unicode dialect, as Java patterns.

Refused, so that the rule is: look-around, back-references, possessive and atomic groups, \\Q, \\G, \\Z, \\h, \\R, \\X and others
that the dialect lacks. Rewritten: the dollar sign outside multi-line mode to \\z, named groups, and POSIX classes.
Java's Unicode classes, Unicode case and unix lines are set, so that classes, case and line ends mean the same.
"""

from __future__ import annotations

import re

from ..errors import CompileError

_ESCAPES = set("dDwWsSbBAznrtfvapPxu") | set(".+*?()|[]{}^$\\-#&~/\"'`<>=!@%,:; _")
_POSIX = {"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\x20\t", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z", "word": r"\w", "xdigit": "0-9A-Fa-f"}


def _fail(pattern: str, why: str) -> CompileError:
    return CompileError("invalid_regex", f"{why}: {pattern!r}")


def java_regex(pattern: str, modifiers: tuple[str, ...] = ()) -> str:
    """The pattern as the modifiers have it: case does not count, unless the pattern begins with (? and no m or s is given."""
    multi, dot = "m" in modifiers, "s" in modifiers
    verbatim = pattern.startswith("(?") and not multi and not dot
    body = _translated(pattern, multi)
    flags = "uUd" + ("" if verbatim else "i") + ("m" if multi else "") + ("s" if dot else "")
    return f"(?{flags}){body}"


def _translated(pattern: str, multi: bool) -> str:
    out: list[str] = []
    stack = [multi]
    at, n, quantified = 0, len(pattern), False
    while at < n:
        c = pattern[at]
        if c == "\\":
            at, text = _escape(pattern, at)
            out.append(text)
        elif c == "[":
            at, text = _class(pattern, at)
            out.append(text)
        elif c == "(":
            at, text, multi_here, closed = _group(pattern, at, stack[-1])
            out.append(text)
            if closed:
                stack[-1] = multi_here
            else:
                stack.append(multi_here)
            quantified = False
            continue
        elif c == ")":
            if len(stack) == 1:
                raise _fail(pattern, "a parenthesis closes nothing")
            stack.pop()
            out.append(c)
            at += 1
        elif c == "$":
            out.append("$" if stack[-1] else r"\z")
            at += 1
        elif c in "*+?" or c == "{" and re.match(r"\{\d+(,\d*)?\}", pattern[at:]):
            m = re.match(r"[*+?]|\{\d+(?:,\d*)?\}", pattern[at:])
            if quantified and c in "+" or not out:
                raise _fail(pattern, "a quantifier follows nothing or is possessive")
            text = m[0]
            at += len(text)
            if pattern[at : at + 1] == "?":
                text, at = text + "?", at + 1
            if pattern[at : at + 1] == "+":
                raise _fail(pattern, "possessive quantifiers are not supported")
            out.append(text)
            quantified = True
            continue
        else:
            out.append("\\" + c if c in "{}]" else c)
            at += 1
        quantified = False
    if len(stack) > 1:
        raise _fail(pattern, "a parenthesis is not closed")
    text = "".join(out)
    try:
        re.compile(_as_python(text))
    except (re.error, OverflowError, RecursionError) as error:
        raise _fail(pattern, str(error)) from error
    return text


def _as_python(text: str) -> str:
    """Near enough for errors of structure."""
    text = re.sub(r"\\[pP](\{[^}]*\}|.)", "a", text)
    text = re.sub(r"\\x\{[0-9A-Fa-f]+\}", "a", text).replace(r"\z", r"\Z").replace("(?<", "(?P<")
    text = re.sub(r"\(\?[a-zA-Z-]*:", "(?:", text)
    return re.sub(r"\(\?[a-zA-Z-]*\)", "", text).replace("&&", "").replace("[[", r"[\[")


def _escape(pattern: str, at: int) -> tuple[int, str]:
    if at + 1 >= len(pattern):
        raise _fail(pattern, "it ends in a backslash")
    c = pattern[at + 1]
    if c not in _ESCAPES:
        raise _fail(pattern, f"\\{c} is not supported")
    if c in "pP":
        m = re.match(r"\\[pP](\{\^?[\w=: -]+\}|[A-Z])", pattern[at:])
        if not m:
            raise _fail(pattern, "a class by property is malformed")
        return at + len(m[0]), m[0]
    if c == "x":
        m = re.match(r"\\x(\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{2})", pattern[at:])
        if not m:
            raise _fail(pattern, "a hexadecimal escape is malformed")
        return at + len(m[0]), m[0]
    if c == "u":
        m = re.match(r"\\u(?:\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{4}))", pattern[at:])
        if not m:
            raise _fail(pattern, "a Unicode escape is malformed")
        return at + len(m[0]), f"\\x{{{m[1] or m[2]}}}"
    if c == "v":
        return at + 2, r"\x0B"
    return at + 2, "\\" + c if not c.isspace() and c != "_" else ("\\x20" if c == " " else c)


def _class(pattern: str, at: int) -> tuple[int, str]:
    out, i, n = ["["], at + 1, len(pattern)
    if pattern[i : i + 1] == "^":
        out.append("^")
        i += 1
    first = True
    while i < n:
        c = pattern[i]
        if c == "]" and not first:
            return i + 1, "".join([*out, "]"])
        if m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:]):
            if m[2] not in _POSIX:
                raise _fail(pattern, f"there is no class {m[2]}")
            out.append(f"[{m[1]}{_POSIX[m[2]]}]")
            i += len(m[0])
        elif c == "[":
            i, text = _class(pattern, i)
            out.append(text)
        elif c == "\\":
            i, text = _escape(pattern, i)
            out.append(text)
        elif pattern.startswith(("--", "~~"), i):
            raise _fail(pattern, "differences of classes are not supported")
        else:
            out.append("\\]" if c == "]" else c if pattern.startswith("&&", i) or c != "&" else "\\&")
            if pattern.startswith("&&", i):
                out.append("&")
                i += 1
            i += 1
        first = False
    raise _fail(pattern, "a class is not closed")


def _group(pattern: str, at: int, multi: bool) -> tuple[int, str, bool, bool]:
    """The place after the opening, its text, multi-line mode inside, and whether it was flags only."""
    if pattern[at + 1 : at + 2] != "?":
        return at + 1, "(", multi, False
    if m := re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[at:]):
        return at + len(m[0]), f"(?<{re.sub('[^A-Za-z0-9]', '', m[1]) or 'g'}>", multi, False
    m = re.match(r"\(\?([imsux]*)(-[imsx]+)?([:)])", pattern[at:])
    if not m or m[0] in ("(?)", "(?-)"):
        raise _fail(pattern, "look-around, atomic groups and other flags are not supported")
    on, off = m[1], m[2] or ""
    return at + len(m[0]), m[0], (multi or "m" in on) and "m" not in off, m[3] == ")"
