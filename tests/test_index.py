"""Rules behind tests of last parts of paths match what they match without them."""

import pytest

from tamarack.operators.engine import RuleSet, index_statistics, indexed_names
from tamarack.plans import index
from tamarack.plans.index import need_of, parts_of
from tamarack.queries import rule, rule_set, synthetic_pack

from .test_engine import EVENTS, check


def need(body, condition="s"):
    own = rule_set(rule(body, condition)).compiled[0]
    return need_of(own.rule.identifiers, own.nodes)


@pytest.mark.parametrize("body, condition, want", [
    ("s:\n  Image|endswith: ['\\A.exe', '\\sys\\b.exe']", "s", ("Image", {"a.exe", "b.exe"})),
    ("s:\n  Image|endswith: 'a.exe'", "s", None), ("s:\n  Image|endswith: ['\\a.exe', 'b']", "s", None), ("s:\n  Image|endswith: '\\a*.exe'", "s", None),
    ("s:\n  Image|endswith: '\\a.exe'", "not s", None), ("s:\n  Image|contains: '\\a.exe'", "s", None),
    ("s:\n  - Image|endswith: '\\a.exe'\n  - User: x", "s", None),
    ("s:\n  - Image|endswith: '\\a.exe'\n  - Image|endswith: '\\b.exe'\n    User: x", "s", ("Image", {"a.exe", "b.exe"})),
    ("s:\n  Image|endswith: '\\a.exe'\nt:\n  Image|endswith: '\\b.exe'", "s or t", ("Image", {"a.exe", "b.exe"})),
    ("s:\n  Image|endswith: ['\\a.exe', '\\c.exe']\nt:\n  Note|endswith: '\\b.exe'", "s and t", ("Note", {"b.exe"})),
    ("s:\n  Image|endswith: '\\a.exe'\nt:\n  Note|endswith: '\\b.exe'", "1 of them", None),
    ("s:\n  Image|endswith: '\\a.exe'\nt:\n  Image|endswith: '\\b.exe'\nu:\n  Image|endswith: '\\'", "2 of them", ("Image", {"a.exe", "b.exe", ""})),
])
def test_needs(body, condition, want):
    found = need(body, condition)
    assert found == want if want is None else (found[0], set(found[1])) == want


def test_no_match_is_lost(spark, monkeypatch):
    """Values with and without backslashes, at their end, in other case, under several names, in both layouts."""
    monkeypatch.setattr(index, "PART", 2)
    events = [*EVENTS, {"Image": "\\cmd.exe"}, {"Image": "cmd.exe"}, {"Image": "C:\\"}, {"Image": "\\"}, {"Image": ""}, {"Image": "C:\\x\\ÉTÉ.EXE", "User": "nobody"}, {"Image": "a\\b\\CMD.EXE", "Note": "z\\b.exe"}]
    tails = ["\\cmd.exe", "\\powershell.exe", "\\été.exe", "\\", "\\b\\cmd.exe", "\\system32\\cmd.exe"]
    texts = [rule(f"s:\n  Image|endswith: '{a}'\nt:\n  Note|endswith: ['\\b.exe', '{b}']\nu:\n  User: nobody", c) for a, b in zip(tails, tails[1:] + tails[:1], strict=True) for c in ("s", "not s", "s and not u", "s or t", "1 of them", "2 of them", "all of (s, t)", "s or u")]
    assert len(check(spark, texts, events)) > 50


def test_parts():
    pack = synthetic_pack(100)
    assert index_statistics(pack) == {"rules": 101, "indexed": 101, "tests": 5, "names": 101}
    assert indexed_names(pack)[0] == "bitsadmin.exe"
    assert parts_of({}) == [] and parts_of({3: None}) == [(None, [3])]
    assert index_statistics(RuleSet()) == {"rules": 0, "indexed": 0, "tests": 0, "names": 0}
