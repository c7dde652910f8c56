"""SQL text from untrusted values. All literals of rules pass through sql_str, all names through sql_name."""

from __future__ import annotations


def sql_str(text: str) -> str:
    """A string literal. Whatever is not plain printable ASCII is escaped, and so is $, which would begin a variable."""
    out = []
    for c in text:
        code = ord(c)
        if c in "\\'":
            out.append("\\" + c)
        elif 0x20 <= code < 0x7F and c != "$":
            out.append(c)
        elif code <= 0xFFFF:
            out.append(f"\\u{code:04X}")
        else:
            out.append(f"\\U{code:08X}")
    return f"'{''.join(out)}'"


def sql_name(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def any_of(parts: list[str]) -> str:
    """Parts joined by OR; false if there are none."""
    return "false" if not parts else parts[0] if len(parts) == 1 else f"({' OR '.join(parts)})"


def all_of(parts: list[str]) -> str:
    return "true" if not parts else parts[0] if len(parts) == 1 else f"({' AND '.join(parts)})"
