"""Networks: is an address, as text, in a network? As SQL over built-in functions."""

from __future__ import annotations

import ipaddress

from .sqltext import sql_str

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"\A{_OCTET}(\.{_OCTET}){{3}}\z"
_SPACE = r"\A\s+|\s+\z"


def parse_network(text: str) -> tuple[int, int, int] | None:
    """Version, address and prefix of net/prefix; None if it is none."""
    head, slash, tail = text.partition("/")
    if not slash or not tail.isdecimal() or not tail.isascii() or "%" in head:
        return None
    try:
        address = ipaddress.ip_address(head)
    except ValueError:
        return None
    prefix = int(tail)
    return None if prefix > address.max_prefixlen else (address.version, int(address), prefix)


def in_network(value: str, network: str) -> str:
    """SQL for: the text of `value`, without white space around it, is an address of the network. A bad network has none."""
    found = parse_network(network)
    if found is None:
        return "false"
    version, address, prefix = found
    text = f"regexp_replace({value}, {sql_str(_SPACE)}, '')"
    return _in_v4(text, address, prefix) if version == 4 else _in_v6(text, address, prefix)


def _in_v4(text: str, address: int, prefix: int) -> str:
    valid = f"{text} RLIKE {sql_str(V4)}"
    if prefix == 0:
        return f"coalesce({valid}, false)"
    part = lambda i: f"CAST(split_part({text}, '.', {i}) AS BIGINT)"
    number = f"({part(1)} * 16777216 + {part(2)} * 65536 + {part(3)} * 256 + {part(4)})"
    shift = 32 - prefix
    return f"CASE WHEN {valid} THEN shiftright({number}, {shift}) = {address >> shift} ELSE false END"


def _in_v6(text: str, address: int, prefix: int) -> str:
    # A tail in dotted form becomes two groups; then :: is filled with zeros, and the groups with leading zeros make 32 digits.
    dotted = rf"\A(.*:)({_OCTET}(?:\.{_OCTET}){{3}})\z"
    octet = lambda i: f"lpad(lower(hex(CAST(split_part(regexp_extract(t, {sql_str(dotted)}, 2), '.', {i}) AS INT))), 2, '0')"
    plain = f"CASE WHEN t RLIKE {sql_str(dotted)} THEN concat(regexp_extract(t, {sql_str(dotted)}, 1), {octet(1)}, {octet(2)}, ':', {octet(3)}, {octet(4)}) ELSE t END"
    group = "[0-9A-Fa-f]{1,4}"
    full, short = rf"\A{group}(:{group}){{7}}\z", rf"\A({group}(:{group})*)?::({group}(:{group})*)?\z"
    groups = lambda side: f"filter(split({side}, ':'), g -> g <> '')"
    left, right = groups("split_part(p, '::', 1)"), groups("split_part(p, '::', 2)")
    filled = f"CASE WHEN p RLIKE {sql_str(full)} THEN split(p, ':') WHEN p RLIKE {sql_str(short)} AND size({left}) + size({right}) <= 7 THEN concat({left}, array_repeat('0', 8 - size({left}) - size({right})), {right}) END"
    digits = f"array_join(transform({filled}, g -> lpad(lower(g), 4, '0')), '')"
    whole, bits = divmod(prefix, 4)
    want = f"{address:032x}"
    test = f"substring(d, 1, {whole}) = {sql_str(want[:whole])}"
    if bits:
        test += f" AND shiftright(CAST(conv(substring(d, {whole + 1}, 1), 16, 10) AS INT), {4 - bits}) = {int(want[whole], 16) >> (4 - bits)}"
    let = lambda name, of, body: f"transform(array({of}), {name} -> {body})[0]"
    return f"coalesce({let('t', text, let('p', plain, let('d', digits, test)))}, false)"
