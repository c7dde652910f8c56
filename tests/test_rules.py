import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.errors import CompileError, ConditionError, EngineError, ParseError
from tamarack.functions import linear, regex, sqltext, transforms, wildcard
from tamarack.functions.fields import FieldMapping
from tamarack.operators.engine import RuleSet
from tamarack.plans.condition import compile_condition, evaluate
from tamarack.plans.rules import parse_rule, parse_rules, rule_id

BASE = "title: t\nlogsource: {product: windows}\ndetection:\n  sel:\n    CommandLine|contains: x\n  condition: sel\n"


def test_metadata():
    r = parse_rule("title: T\nid: i\nlevel: high\nstatus: stable\ndate: 2024-01-15\ntags: [a, b]\nreferences: [u]\nfalsepositives: [none]\nextra: {k: 1}\nauthor: No\n" + BASE.split("\n", 1)[1])
    assert (r.id, r.level, r.score, r.status, r.date, r.tags, r.author) == ("i", "high", 0.7, "stable", "2024-01-15", ("a", "b"), "No")
    assert r.custom_fields == {"extra": {"k": 1}}
    assert parse_rule(BASE).level == "medium" and parse_rule(BASE).status == "test"


def test_generated_id_is_stable_and_shaped():
    a = rule_id("Suspicious")
    assert a == rule_id("Suspicious") != rule_id("suspicious")
    assert a[14] == "4" and a[19] in "89ab" and len(a) == 36


@pytest.mark.parametrize("text, kind", [
    ("detection: {sel: {a: 1}, condition: sel}", "yaml"),
    ("title: ''\ndetection: {sel: {a: 1}, condition: sel}", "missing_field"),
    ("title: t", "yaml"),
    ("title: t\ndetection: {condition: sel}", "empty_detection"),
    ("title: t\ndetection: {sel: [], condition: sel}", "empty_detection"),
    ("title: t\ndetection: {sel: {a|nope: 1}, condition: sel}", "invalid_modifier"),
    ("title: t\ndetection: {sel: {a|i: 1}, condition: sel}", "invalid_modifier"),
    ("title: t\ndetection: {sel: {a: 1}, condition: other}", "invalid_condition"),
    ("title: t\ndetection: {sel: {a: 1}, condition: '1 of x*'}", "invalid_condition"),
    ("title: t\ndetection: {sel: {a: 1}, condition: 'sel | count() > 5'}", "validation"),
    ("title: t\nlevel: huge\ndetection: {sel: {a: 1}, condition: sel}", "yaml"),
    ("title: t\ntags: a\ndetection: {sel: {a: 1}, condition: sel}", "yaml"),
    ("title: t\ntitle: u\ndetection: {sel: {a: 1}, condition: sel}", "yaml"),
    ("title: t\ndetection: {sel: [{a: 1}, b], condition: sel}", "validation"),
    ("title: [", "yaml"),
])
def test_rejects(text, kind):
    with pytest.raises(ParseError) as e:
        parse_rule(text)
    assert e.value.kind == kind


def test_documents_split_and_fail_alone():
    found = parse_rules(BASE.replace("\n", "\r\n") + "\n---\n" + "title: [" + "\n---\n\n---\n" + BASE.replace("title: t", "title: u"))
    assert [getattr(f, "title", "error") for f in found] == ["t", "error", "u"]


def test_a_failed_rule_leaves_the_set_alone():
    rules = RuleSet()
    rules.load_rule(BASE)
    for bad, kind in ((BASE.replace("condition: sel", "condition: sel and"), "condition"), (BASE.replace("|contains: x", "|re: '('"), "regex"), ("x", "parse")):
        with pytest.raises(EngineError) as e:
            rules.load_rule(bad)
        assert e.value.kind == kind
    assert rules.rule_count == 1 and rules.rule_list()[0][1] == "t"
    ids, errors = rules.load_rules(BASE + "\n---\nx\n---\n" + BASE)
    assert len(ids) == 2 and len(errors) == 1 and rules.rule_count == 3


def test_dead_conditions_warn():
    rules = RuleSet()
    rules.load_rule(BASE.replace("condition: sel", "condition: sel and count"))
    assert "never holds" in rules.warnings[0]


NAMES = ["a", "b", "sel_1", "sel_2"]


@pytest.mark.parametrize("text, true, want", [
    ("a or b and not a", {"a"}, True), ("not a and b", {"b"}, True), ("not (a or b)", {"b"}, False), ("NOT a AND B" .replace("B", "b"), {"b"}, True),
    ("1 of sel_*", {"sel_2"}, True), ("2 of sel*", {"sel_2"}, False), ("all of sel*", {"sel_1", "sel_2"}, True), ("0 of them", {"a"}, False),
    ("1 of them", {"b"}, True), ("3 of them", {"a", "b"}, False), ("all of (a, b)", {"a", "b"}, True), ("1 of (a, sel*)", {"sel_1"}, True), ("not not a", {"a"}, True),
    ("all of zz*", set(), False), ("5 of (a,b)", {"a", "b"}, False),
])
def test_conditions(text, true, want):
    assert evaluate(compile_condition(text, NAMES), lambda n: n in true) is want


@pytest.mark.parametrize("text, kind", [("", "empty_condition"), ("a and", "unexpected_token"), ("a b", "unexpected_token"), ("(a", "unexpected_token"), ("1 a", "unexpected_token"), ("1 of", "unexpected_token"), ("1 of (a,)", "unexpected_token"), ("1 of (a,a)", "duplicate_identifier"), ("1 of (sel*, sel_1)", "duplicate_identifier"), ("a & b", "unexpected_token"), ("all", "unexpected_token")])
def test_condition_errors(text, kind):
    with pytest.raises(ConditionError) as e:
        compile_condition(text, NAMES)
    assert e.value.kind == kind


def test_deep_conditions():
    assert evaluate(compile_condition("(" * 60 + "a" + ")" * 60, NAMES), lambda n: True)


def test_wildcards():
    assert wildcard.literal_of(r"a\*b\?c\\d\e") == r"a*b?c\d\e"
    assert wildcard.literal_of("a*") is None
    assert wildcard.java_pattern("*a?*", before=True, after=True) == r"(?s)\A(?>.*?a.)"
    assert wildcard.java_pattern("a*b*c") == r"(?s)\Aa(?>.*?b).*c\z"


def test_transforms():
    assert transforms.encoded("foo") == ["Zm9v"]
    assert transforms.encoded_offsets("foobar") == ["Zm9vYmFy", "Zvb2Jhc", "mb29iYX"]
    assert transforms.wide("ab") == ["a\0b\0"]
    assert transforms.dashes("-a /b") == ["-a /b", "-a -b", "/a /b", "–a –b", "—a —b", "―a ―b"]
    assert transforms.transformed([None, "", 5], ("base64",)) == [None, "", "NQ=="]
    assert [transforms.value_text(v) for v in (1.0, 1.5, True, None, -3)] == ["1", "1.5", "true", "", "-3"]


@pytest.mark.parametrize("bad", [r"(?=a)", r"(?<!a)b", r"(a)\1", "(a", "a)", "a++", "(?>a)", r"\Qa\E", "*a", "[z-a]", "[a", r"\p{", "a{3,2}", r"\h", "(?U)a"])
def test_regex_refusals(bad):
    with pytest.raises(CompileError):
        regex.java_regex(bad)


def test_regex_translation():
    assert regex.java_regex("a$") == r"(?uUdi)a\z"
    assert regex.java_regex("^a$", ("re", "m")) == "(?uUdim)^a$"
    assert regex.java_regex("(?:a|b)") == "(?uUd)(?:a|b)"
    assert regex.java_regex("[[:digit:]]+") == "(?uUdi)[[0-9]]+"


def test_mapping():
    m = FieldMapping()
    assert len(m) == 105 and m.translate("commandline") == "command_line" and m.translate("Other") == "Other" and m.translate("type") == "audit_type"
    assert m.enrich({"command_line": "x"}) == {"command_line": "x", "commandline": "x"}
    assert m.enrich({"command_line": "x", "commandline": "y"}) == {"command_line": "x", "commandline": "y"}
    m.add_mappings({"A": "z", "B": "z"})
    assert m.enrich({"z": "1"})["a"] == "1" and len(FieldMapping.empty()) == 0


def test_sql_literals_escape_everything():
    assert sqltext.sql_str("a'b\\c") == "'a\\'b\\\\c'"
    assert sqltext.sql_str("${x}\n\0") == "'\\u0024{x}\\u000A\\u0000'"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", ".", "[ab]", "[^a]", r"\w", "(?:a|b)", "(?:ab)", "^", "$", r"\b", "(?:a*)", "*", "+", "?", "{1,3}", "|"]), max_size=7), st.text(alphabet="ab1 \n", max_size=8))
def test_automata_agree_with_backtracking(parts, text):
    pattern = "".join(parts)
    try:
        want = re.search(pattern.replace("$", r"\Z"), text) is not None
    except re.error:
        return
    try:
        assert linear.Automaton(pattern).search(text) == want
    except linear.Unsupported:
        assert re.search(r"[*+?}]\+", pattern)


def test_risk():
    assert all(map(linear.is_risky, ["(a+)+$", "(a|aa)+$", "(.*a){12}$", "(a*)*"])) and not any(map(linear.is_risky, ["a+b*", ".*a.*b", "(ab){3}", "(?:a|b)c"]))
