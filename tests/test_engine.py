import json
import random
import time
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarack.functions.sqltext import sql_str
from tamarack.operators import reports
from tamarack.operators.engine import RuleSet, compile_rule, detect, detect_batch, detect_count
from tamarack.plans.rules import Rule
from tamarack.queries import rule, rule_set, synthetic_pack
from tamarack.sources import generator, sinks
from tamarack.sources.events import flatten_lines, from_maps, from_table, read_lines

from .spec_matcher import rule_holds

COLUMNS = ["Image", "CommandLine", "User", "Port", "Ip", "Note", "category", "product"]


def frame(spark, events):
    return spark.createDataFrame([(i, *(e.get(c) for c in COLUMNS)) for i, e in enumerate(events)], "event_id long, " + ", ".join(f"{c} string" for c in COLUMNS))


def hits(df, rules):
    return {(r["event_id"], r["rule_idx"]) for r in detect(df, rules).select("event_id", "rule_idx").collect()}


def check(spark, texts, events):
    """Both layouts against the plain meaning."""
    rules = rule_set(*texts)
    want = {(i, j) for i, e in enumerate(events) for j, c in enumerate(rules.compiled) if rule_holds(c.rule, e)}
    df = frame(spark, events)
    assert hits(df, rules) == want
    assert hits(from_table(df), rules) == want
    return want


EVENTS = [
    {"Image": "C:\\Windows\\System32\\cmd.exe", "CommandLine": "cmd.exe -c WHOAMI /all", "User": "LAB\\ann", "Port": "443", "Ip": "10.1.2.3", "category": "process_creation", "product": "windows"},
    {"Image": "C:\\tools\\powershell.exe", "CommandLine": "powershell –enc SQBFAFgA\nnext line", "User": "", "Port": "8080.5", "Ip": "2001:db8::7", "product": "Windows"},
    {"Image": "/usr/bin/été", "CommandLine": "Straße ΟΔΥΣΣΕΥΣ *?\\", "Port": " 42 ", "Ip": " 192.168.1.1 ", "Note": "C:\\Windows\\System32\\CMD.exe"},
    {"User": "nobody", "Port": "1d", "Ip": "010.1.2.3", "Note": "evil\r\nend"},
    {"Port": "-7", "Note": "a" * 50, "Ip": "::ffff:10.1.2.3"},
    {},
    {"Port": "inf", "CommandLine": "it's ${env:X} `tick` \"q\"", "Ip": "1.2.3", "User": "NaN"},
    {"Port": "9223372036854775808", "CommandLine": "Zm9vYmFy w\0h\0o\0", "Ip": "fe80::1%eth0", "Image": "powershell.exe"},
]

BODIES = [
    "s:\n  CommandLine|contains: whoami", "s:\n  Image|endswith: 'shell.exe'", "s:\n  Image|endswith: ['\\cmd.exe', '\\\\x.exe']", "s:\n  Image|startswith: 'c:\\win'", "s:\n  Image: '*\\cmd.ex?'", "s:\n  CommandLine|contains: '\\*\\?\\\\'",
    "s:\n  CommandLine|contains: straße", "s:\n  CommandLine|contains: 'οδυσσευς'", "s:\n  CommandLine|re: '^power.*next'", "s:\n  CommandLine|re|s: '^power.*next'", "s:\n  CommandLine|re|m: '^next'", "s:\n  Note|re|m: 'evil$'", "s:\n  Image|re: 'ÉTÉ'", "s:\n  CommandLine|re: '(?:WHO|x)ami'", "s:\n  CommandLine|re: '(?:who|x)ami'",
    "s:\n  Port|gt: 100", "s:\n  Port|gte: 42", "s:\n  Port|lt: 0", "s:\n  Port|lte: 443.0", "s:\n  Port|gt: '8080'", "s:\n  Port|gt: abc", "s:\n  User|gt: 1", "s:\n  Ip|cidr: 10.0.0.0/8", "s:\n  Ip|cidr: 192.168.1.0/31", "s:\n  Ip|cidr: '2001:db8::/33'", "s:\n  Ip|cidr: 0.0.0.0/0", "s:\n  Ip|cidr: '::/0'", "s:\n  Ip|cidr: 'x/8'", "s:\n  Ip|cidr: 10.1.2.3",
    "s:\n  User: null", "s:\n  User: ''", "s:\n  User|exists: true", "s:\n  User|exists: false", "s:\n  User|exists: 'False'", "s:\n  User|exists: 0", "s:\n  Image|fieldref: Note", "s:\n  CommandLine|fieldref|contains: User", "s:\n  Image|fieldref|all: [Note, Image]", "s:\n  Image|fieldref: Missing",
    "s:\n  CommandLine|windash|contains: ' -enc'", "s:\n  CommandLine|base64|contains: foobar", "s:\n  CommandLine|base64offset|contains: oobar", "s:\n  CommandLine|wide|contains: who", "s:\n  CommandLine|contains|all: [cmd, all, '-c']", "s: [whoami, evil]", "s: nobody", "s:\n  '|all': ['*cmd*', '*exe*']", "s: {}", "s:\n  User: []", "s:\n  User|all: []",
    "s:\n  CommandLine|contains: \"it's ${env:X} `tick`\"", "s:\n  Port: 443", "s:\n  Port: [443, ' 42 ']", "s:\n  - User: nobody\n  - Image|contains: tools\n    Port|gt: 8000", "s:\n  COMMAND_LINE|contains: cmd", "s:\n  Note|re: null", "s:\n  Port: true", "s:\n  Port: 8080.5", "s:\n  CommandLine|re|contains: 'cmd\\.'", "s:\n  Port|re: '^-?[0-9]+$'",
]


def test_every_operator_in_both_layouts(spark):
    check(spark, [rule(b, c) for b in BODIES for c in ("s", "not s")], EVENTS)


def test_log_sources(spark):
    texts = [rule("s:\n  Port|exists: true", "s", extra=f"logsource: {{{ls}}}\n") for ls in ("product: WINDOWS", "category: process_creation, product: windows", "service: x", "definition: y", "")]
    found = check(spark, texts, EVENTS)
    assert (1, 0) in found and (1, 1) not in found and (4, 3) in found


def test_product_of_an_image_is_a_log_source(spark):
    df = spark.createDataFrame([(0, "windows", "x")], "event_id long, Product string, CommandLine string")
    assert hits(df, rule_set(rule("s:\n  CommandLine: x", "s", extra="logsource: {product: windows}\n"))) == {(0, 0)}


def test_alerts(spark):
    rules = rule_set(rule("a:\n  User: nobody\nb:\n  Port|exists: true", "a", "one", "level: high\ntags: [t1]\n"), rule("a:\n  User: nobody\nb:\n  Image: x", "a and b", "two").replace("condition: a and b", "condition: [a and b, a, not b]"))
    rows = sorted(detect(frame(spark, EVENTS), rules).filter("event_id = 3").collect(), key=lambda r: r["rule_idx"])
    assert [(r["rule_title"], r["rule_level"], r["score"], r["tags"], r["matched_conditions"], r["matched_identifiers"]) for r in rows] == [("one", "high", 0.7, ["t1"], [0], ["a", "b"]), ("two", "medium", 0.5, [], [1, 2], ["a"])]


def test_equal_ids_are_rules_of_their_own(spark):
    text = rule("a:\n  User: nobody", "a", "one", "id: same\n")
    assert hits(frame(spark, EVENTS), rule_set(text, text)) == {(3, 0), (3, 1)}


def test_counts_batches_and_no_rules(spark):
    df, rules = frame(spark, EVENTS), rule_set(rule("a:\n  Port|exists: true", "a"), rule("a:\n  User: nobody", "a"))
    assert detect_count(df, rules).first()["matches"] == 8
    batch = {r["event_id"]: r for r in detect_batch(df, rules).collect()}
    assert len(batch) == len(EVENTS) and batch[5]["matches"] == [] and [m["rule_idx"] for m in batch[3]["matches"]] == [0, 1] and batch[0]["rules_evaluated"] == 2
    assert detect(df, RuleSet()).count() == 0 and detect_count(df, RuleSet()).first()["matches"] == 0
    assert detect(df.limit(0), rules).count() == 0


def test_keys_that_differ_in_case(spark):
    df = from_maps(spark.createDataFrame([(0, {"image": "a", "Image": "b", "IMAGE": "c"})], "event_id long, event map<string,string>"))
    assert hits(df, rule_set(*(rule(f"s:\n  Image: {x}", "s") for x in "abcd"))) == {(0, 0), (0, 1), (0, 2)}


def test_many_rules_and_order(spark):
    pack = synthetic_pack(450)
    rows = detect(generator.events(spark, 500), pack).collect()
    assert rows and {r["rule_idx"] for r in rows} == {450}
    rules = rule_set(*(rule("s:\n  Port|exists: true", "s") for _ in range(210)))
    one = detect(frame(spark, EVENTS[:1]), rules)
    lines = [r["value"] for r in sinks.ordered(sinks.text(one)).collect()]
    assert len(lines) == 210
    assert [r["rule_idx"] for r in one.orderBy("event_id", "rule_idx").collect()] == list(range(210))


def test_backtracking_stays_fast(spark):
    df = spark.createDataFrame([(0, "a" * 10_000 + "b")], "event_id long, Note string")
    risky = ["(a+)+$", "(a|aa)+$", "(.*a){12}$", "(x+x+)+y"]
    rules = rule_set(*(rule(f"s:\n  Note|re: '{p}'", "s") for p in risky), rule("s:\n  Note: '" + "*a" * 20 + "*c'", "s"), rule("s:\n  Note|re: '(a+)+b$'", "s"))
    df = df.unionByName(spark.createDataFrame([(1, "xxxy")], df.schema))
    detect(df.limit(0), rules).collect()
    began = time.time()
    assert hits(df, rules) == {(1, 3), (0, 5)} == hits(from_table(df), rules)
    assert time.time() - began < 30


def test_adversarial_events(spark):
    events = [{"Note": "x" * 10_000, "User": "\u200b\u202eabc\0"}, {"Note": "\U0001f600 'quote\\"}]
    check(spark, [rule("s:\n  Note|contains: '\U0001f600 ''q'", "s"), rule("s:\n  User|endswith: \"c\\0\"", "s"), rule("s:\n  Note: 'x*x'", "s")], events)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.text(max_size=40))
def test_sql_literals_round_trip(spark, text):
    clean = text.encode("utf-8", "ignore").decode()
    assert spark.sql(f"SELECT {sql_str(clean)} AS x").first()["x"] == clean


def random_rule(rng: random.Random) -> str:
    words = ["cmd", "WHO", "exe", "a", "-", "\\\\", "*", "?", "é", "1", "42", "nobody", ""]
    names = ["s1", "s2", "f1"]
    body = []
    for n in names:
        tests = {}
        for _ in range(rng.randint(1, 2)):
            mods = rng.choice(["", "|contains", "|startswith", "|endswith", "|contains|all", "|windash|contains", "|gt", "|lte", "|exists", "|wide|contains", "|base64|contains"])
            values = [rng.choice(words) + rng.choice(words) for _ in range(rng.randint(1, 3))]
            tests[rng.choice(COLUMNS[:6] + ["missing"]) + mods] = values
        body.append(f"{n}:\n" + "\n".join(f"  {k}: {v!r}" for k, v in tests.items()))
    return rule("\n".join(body), rng.choice(["s1 and not f1", "s1 or s2", "1 of s*", "2 of them", "not 1 of s* or f1", "all of s* and not f1"]))


def test_differential(spark):
    rng = random.Random(7)
    pieces = ["cmd", "who", "EXE", "a", " -", "/", "\\", "é", "1", "42", "", "nobody", "*", "Y21k", "w\0h\0"]
    events = [{c: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 3))) for c in COLUMNS[:6] if rng.random() < 0.8} for _ in range(150)]
    assert check(spark, [random_rule(rng) for _ in range(60)], events)


def test_generator(spark):
    a, b = generator.events(spark, 300).collect(), generator.events(spark, 300).repartition(3).orderBy("event_id").collect()
    assert a == b and len(a[0]) == 18
    assert generator.expected_hits(12345, 1000) == 2000
    assert detect_count(generator.controlled(spark, 12345, 1000), rule_set(rule("s:\n  A4Hit: '1'", "s"))).first()["matches"] == 2000
    record = json.loads(generator.as_windows_records(generator.events(spark, 1)).first()["value"])
    assert record["EventID"] == 1 and isinstance(record["ProcessId"], int) and all(not isinstance(v, (dict, list)) for v in record.values())
    shares = Counter(r["IntegrityLevel"] for r in a)
    assert set(shares) == set(generator.LEVELS)


def test_a_data_set_and_its_twin(spark, tmp_path):
    generator.write_json(generator.events(spark, 50), f"{tmp_path}/flat", f"{tmp_path}/twin")
    flat, twin = (flatten_lines(read_lines(spark, f"{tmp_path}/{x}")) for x in ("flat", "twin"))
    rules = rule_set(rule("s:\n  CommandLine|contains: transfer", "s"))
    assert flat.filter("error is not null").isEmpty() and detect_count(flat, rules).first() == detect_count(twin, rules).first()


def test_batches_with_repeated_keys(spark):
    rows = [(1, "x", "a"), (1, "y", "b"), (None, "x", "c"), (2, "z", "d")]
    df = spark.createDataFrame(rows, "event_id long, name string, other string")
    found = detect_batch(df, rule_set(rule("s:\n  name: x", "s"), rule("s:\n  name: y", "s", "two", "tags: [t]\nlevel: high\n"))).collect()
    assert sorted((str(r["event_id"]), [m["rule_idx"] for m in r["matches"]]) for r in found) == [("1", [0]), ("1", [1]), ("2", []), ("None", [0])]
    one = next(r["matches"][0] for r in found if r["matches"] and r["matches"][0]["rule_idx"] == 1)
    assert (one["rule_title"], one["rule_level"], one["tags"], one["matched_identifiers"], one["matched_conditions"]) == ("two", "high", ["t"], ["s"], [0])


def test_fields_named_like_working_columns(spark):
    names = ["hits", "rule_idx", "__hits0", "place", "details"]
    df = spark.createDataFrame([(1, *names), (2, *("no" for _ in names))], "event_id long, " + ", ".join(f"{n} string" for n in names))
    rules = rule_set(*(rule(f"a:\n  {n}: {n}\nb:\n  {n}: other", "a or b") for n in names))
    found = detect(df, rules, keep=["hits"]).collect()
    assert sorted((r["event_id"], r["rule_idx"], tuple(r["matched_identifiers"]), r["hits"]) for r in found) == [(1, i, ("a",), "hits") for i in range(5)]
    assert [len(r["matches"]) for r in detect_batch(df, rules).orderBy("event_id").collect()] == [5, 0]


def test_the_key_is_a_field_by_name(spark):
    df = spark.createDataFrame([(1, "a"), (2, "1")], "event_id long, name string")
    assert hits(df, rule_set(rule("s:\n  event_id: 1", "s"))) == {(1, 0)}
    assert hits(df, rule_set(rule("keywords:\n  - '1'", "keywords"))) == {(2, 0)}


def test_reports(spark):
    alerts = detect(frame(spark, EVENTS), rule_set(rule("a:\n  Port|exists: true", "a"), rule("a:\n  User: nobody", "a")))
    assert [(r["rule_idx"], r["n"]) for r in reports.top_rules(alerts, 1).collect()] == [(0, 7)]
    a, b = alerts.select("event_id", "rule_idx"), alerts.filter("event_id <> 3").select("event_id", "rule_idx")
    assert reports.compare_hits({"a": a, "b": b}).count() == 2 == reports.symmetric_difference(a, b).count()
    assert {r["rule_idx"]: r["n"] for r in reports.disagreements({"a": a, "b": b}).collect()} == {0: 1, 1: 1}
    assert reports.common_rules({"a": a, "b": b}).distinct().count() == 1
    assert {r["engine"]: r["n"] for r in reports.loaded_counts({"a": a, "b": b}).collect()} == {"a": 8, "b": 6}


def test_rule_as_column(spark):
    df = frame(spark, EVENTS)
    column = compile_rule(rule("s:\n  Port|gt: 100", "not s"), COLUMNS)
    assert [r["event_id"] for r in df.filter(column).orderBy("event_id").collect()] == [2, 3, 4, 5]
    assert isinstance(rule_set(rule("s:\n  a: 1", "s")).compiled[0].rule, Rule)
    assert df.filter(F.lit(True)).count() == len(EVENTS)


@pytest.mark.parametrize("n", [1, 4])
def test_filters_reach_the_scan(spark, tmp_path, n):
    """Only the columns of the rules are read."""
    path = str(tmp_path / "e")
    frame(spark, EVENTS).repartition(n).write.parquet(path)
    plan = detect_count(spark.read.parquet(path).select("event_id", "Port", "User"), rule_set(rule("s:\n  Port|gt: 100", "s")))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<Port:string>" in plan
