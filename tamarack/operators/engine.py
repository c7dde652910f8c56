"""Rule sets and detection: events with rules to alerts."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError, ConditionError, EngineError, ParseError
from ..functions.fields import FieldMapping
from ..functions.sqltext import all_of, any_of, sql_name, sql_str
from ..plans.condition import Node, compile_condition, names_in
from ..functions.linear import search
from ..plans.index import need_of, need_sql, parts_of
from ..plans.emit import LINEAR_MATCH, Columns, Layout, MapEvents, condition_sql, identifier_sql, logsource_sql, needs_linear, test_sql
from ..plans.rules import Identifier, LogSource, Rule, Test, parse_rule, split_documents

#: The map column of events that have one, and rules in one array expression.
FIELDS, CHUNK = "fields", 200
ALERT = "rule_idx int, rule_id string, rule_title string, rule_level string, matched_conditions array<int>, matched_identifiers array<string>, tags array<string>, score double"


@dataclass(frozen=True)
class Compiled:
    rule: Rule
    nodes: tuple[Node, ...]
    warnings: tuple[str, ...] = ()


class RuleSet:
    """Rules in the order of loading. Ids may repeat; the place in the order is what names a rule."""

    def __init__(self, field_mapping: FieldMapping | None = None):
        self.mapping = field_mapping or FieldMapping()
        self.compiled: list[Compiled] = []

    def load_rule(self, text: str) -> str:
        """The id of the rule of one YAML document. After an error the set is as before."""
        try:
            rule = parse_rule(text)
            found = _compile(rule, self.mapping)
        except ParseError as error:
            raise EngineError("parse", str(error)) from error
        except ConditionError as error:
            raise EngineError("condition", str(error)) from error
        except CompileError as error:
            raise EngineError("regex", str(error)) from error
        self.compiled.append(found)
        return rule.id

    def load_rules(self, text: str) -> tuple[list[str], list[EngineError]]:
        """Ids of the rules that load, and the errors of the others."""
        ids, errors = [], []
        for document in split_documents(text):
            try:
                ids.append(self.load_rule(document))
            except EngineError as error:
                errors.append(error)
        return ids, errors

    @property
    def rule_count(self) -> int:
        return len(self.compiled)

    def rule_list(self) -> list[tuple[str, str, str]]:
        """(id, title, level) of each rule."""
        return [(c.rule.id, c.rule.title, c.rule.level) for c in self.compiled]

    @property
    def warnings(self) -> list[str]:
        return [f"{c.rule.title}: {w}" for c in self.compiled for w in c.warnings]

    def table(self, spark: SparkSession) -> DataFrame:
        """The rules' metadata, one row each."""
        rows = [(i, r.id, r.title, r.description, r.status, r.level, r.author, r.date, r.modified, list(r.references), list(r.tags), (r.logsource.category, r.logsource.product, r.logsource.service), list(r.conditions), list(r.falsepositives), {k: str(v) for k, v in r.custom_fields.items()}, r.score) for i, r in enumerate(c.rule for c in self.compiled)]
        schema = "rule_idx int, rule_id string, rule_title string, description string, status string, rule_level string, author string, date string, modified string, references array<string>, tags array<string>, logsource struct<category:string,product:string,service:string>, conditions array<string>, falsepositives array<string>, custom_fields map<string,string>, score double"
        return spark.createDataFrame(rows, schema)


def _compile(rule: Rule, mapping: FieldMapping) -> Compiled:
    names = [i.name for i in rule.identifiers]
    nodes, warnings = [], []
    for condition in rule.conditions:
        node = compile_condition(condition, names)
        if unknown := names_in(node) - set(names):
            warnings.append(f"the condition {condition!r} names {', '.join(sorted(unknown))}, which nothing defines, and never holds")
        else:
            nodes.append(node)
    for identifier in rule.identifiers:
        identifier_sql(identifier, MapEvents(FIELDS, mapping))
        for group in identifier.groups:
            for test in group:
                if "re" in test.modifiers and not {"m", "s"} & set(test.modifiers) and any(str(v).startswith("(?") for v in test.values):
                    warnings.append(f"{identifier.name}.{test.field}: a pattern that begins with (? is sensitive to case")
    return Compiled(rule, tuple(nodes), tuple(warnings))


def _linear_match(values, patterns, modifiers, every):
    flags = tuple(modifiers)
    join = all if every else any
    return any(join(search(p, flags, v) for p in patterns) for v in values)


def prepare(spark: SparkSession, rules: RuleSet) -> None:
    """Gives the session the function for patterns that a backtracking matcher could take for ever on, if a rule has some."""
    if any(needs_linear(t) for c in rules.compiled for i in c.rule.identifiers for g in i.groups for t in g):
        # Called non-deterministic so that the optimizer does not move it into array functions, which cannot call Python.
        spark.udf.register(LINEAR_MATCH, F.udf(_linear_match, "boolean", useArrow=True).asNondeterministic())


def layout_of(events: DataFrame, rules: RuleSet, key: str) -> Layout:
    """Events with a map of arrays in `fields` are in the map layout; of others all columns are fields, the key too for tests that name it."""
    kind = next((f.dataType for f in events.schema if f.name == FIELDS), None)
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.ArrayType):
        return MapEvents(FIELDS, rules.mapping)
    names = [f.name for f in events.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    return Columns([n for n in names if n != key], rules.mapping, {}, [n for n in names if n == key])


def _free(events: DataFrame, name: str) -> str:
    """A name that no column of events has, so that working columns hide no field."""
    taken = {c.lower() for c in events.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _rule_sql(compiled: Compiled, layout: Layout) -> list[str]:
    """SQL of each condition of a rule."""
    identifiers = {i.name: identifier_sql(i, layout) for i in compiled.rule.identifiers}
    return [condition_sql(n, identifiers) for n in compiled.nodes]


def _needs(rules: RuleSet) -> dict[int, tuple[str, frozenset[str]] | None]:
    """Of each rule that can hold what an event must have for it; None where every event may do."""
    return {i: need_of(c.rule.identifiers, c.nodes) for i, c in enumerate(rules.compiled) if c.nodes}


def index_statistics(rules: RuleSet) -> dict[str, int]:
    """How many rules there are, how many are behind tests of last parts, how many such tests, and how many different last parts."""
    needs = {i: n for i, n in _needs(rules).items() if n}
    tests = sum(len(parts_of({i: needs[i] for i in places if i in needs})) for places in _by_source(rules).values())
    return {"rules": rules.rule_count, "indexed": len(needs), "tests": tests, "names": len({(f.lower(), n) for f, names in needs.values() for n in names})}


def indexed_names(rules: RuleSet) -> list[str]:
    """The last parts of paths without which indexed rules cannot hold, ascending."""
    return sorted({n for need in _needs(rules).values() if need for n in need[1]})


def _by_source(rules: RuleSet) -> dict[LogSource, list[int]]:
    groups: dict[LogSource, list[int]] = defaultdict(list)
    for i, c in enumerate(rules.compiled):
        if c.nodes:
            groups[c.rule.logsource].append(i)
    return groups


def _hits(rules: RuleSet, layout: Layout) -> list[str]:
    """SQL of arrays of the places of rules that hold. The test of a log source stands once for its rules, and one of last parts for rules that need them."""
    out, needs = [], _needs(rules)
    for source, places in _by_source(rules).items():
        where = logsource_sql(source, layout)
        for need, own in parts_of({i: needs[i] for i in places}):
            guard = all_of([x for x in (where, need_sql(*need, layout) if need else "true") if x != "true"])
            for at in range(0, len(own), CHUNK):
                each = [f"IF({any_of(_rule_sql(rules.compiled[i], layout))}, {i}, NULL)" for i in own[at : at + CHUNK]]
                array = f"array_compact(array({', '.join(each)}))"
                out.append(array if guard == "true" else f"CASE WHEN {guard} THEN {array} ELSE array() END")
    return out


def matched(events: DataFrame, rules: RuleSet, key: str = "event_id") -> DataFrame:
    """events with `hits`: the places of the rules that hold, ascending. A field of that name is tested before the column takes its place."""
    found, name = _matched(events, rules, layout := layout_of(events, rules, key), _hits(rules, layout))
    found = found.drop(*(layout.linear or {}).values())
    return found if name == "hits" else found.withColumn("hits", F.col(name)).drop(name)


def _matched(events: DataFrame, rules: RuleSet, layout: Layout, parts: list[str]) -> tuple[DataFrame, str]:
    """events with the places of rules that hold, and the name of that column. Results of automata stay as columns, as details may need them."""
    prepare(events.sparkSession, rules)
    name = _free(events, "hits")
    if layout.linear:
        events = events.selectExpr("*", *(f"{sql} AS {name}" for sql, name in layout.linear.items()))
    if not parts:
        return events.withColumn(name, F.array().cast("array<int>")), name
    columns = [_free(events, f"__hits{i}") for i in range(len(parts))]
    wide = events.selectExpr("*", *(f"{p} AS {sql_name(c)}" for p, c in zip(parts, columns, strict=True)))
    return wide.withColumn(name, F.array_sort(F.concat(*(F.col(sql_name(c)) for c in columns)))).drop(*columns), name


def _details(compiled: Compiled, layout: Layout) -> str:
    """SQL of the conditions and identifiers that hold, for an event on which the rule does. What follows from that is not tested again."""
    known = _implied(compiled.nodes[0]) if len(compiled.nodes) == 1 else set()
    conditions = ["0"] if len(compiled.nodes) == 1 else [f"IF({p}, {k}, NULL)" for k, p in enumerate(_rule_sql(compiled, layout))]
    names = [sql_str(x.name) if x.name in known else f"IF({identifier_sql(x, layout)}, {sql_str(x.name)}, NULL)" for x in compiled.rule.identifiers]
    return f"named_struct('conditions', array_compact(array({', '.join(conditions)})), 'identifiers', array_compact(array({', '.join(names)})))"


def _implied(node: Node) -> set[str]:
    """Identifiers that hold whenever the node does."""
    match node:
        case ("id", name):
            return {name}
        case ("and", nodes):
            return set().union(*map(_implied, nodes))
        case ("of", count, names) if count in (0, len(names)):
            return set(names)
    return set()


def _details_of(rules: RuleSet, layout: Layout, place: str) -> str:
    """SQL of the details of the rule whose place is given, by a branch for each rule."""
    details = "CAST(NULL AS STRUCT<conditions: ARRAY<INT>, identifiers: ARRAY<STRING>>)"
    for at in reversed(range(0, rules.rule_count, CHUNK)):
        whens = [f"WHEN {i} THEN {_details(c, layout)}" for i, c in enumerate(rules.compiled[at : at + CHUNK], at) if c.nodes]
        if whens:
            part = f"CASE {place} {' '.join(whens)} END"
            details = part if rules.rule_count <= CHUNK else f"CASE WHEN {place} >= {at} AND {place} < {at + CHUNK} THEN {part} ELSE {details} END"
    return details


def _alert(rules: RuleSet, place: str, details: str) -> list[tuple[str, str]]:
    """Names and SQL of ALERT's columns. The rules' metadata are constant arrays, as large as what the driver holds."""
    own = [c.rule for c in rules.compiled]
    text = lambda x: "CAST(NULL AS STRING)" if x is None else sql_str(x)
    array = lambda values, kind: f"CAST(array({', '.join(values)}) AS ARRAY<{kind}>)"
    of = lambda values, kind: f"get({array(values, kind)}, {place})"
    return [
        ("rule_idx", place),
        ("rule_id", of([text(r.id) for r in own], "STRING")),
        ("rule_title", of([text(r.title) for r in own], "STRING")),
        ("rule_level", of([text(r.level) for r in own], "STRING")),
        ("matched_conditions", f"{details}.conditions"),
        ("matched_identifiers", f"{details}.identifiers"),
        ("tags", of([array(map(text, r.tags), "STRING") for r in own], "ARRAY<STRING>")),
        ("score", of(["CAST(NULL AS DOUBLE)" if r.score is None else f"{float(r.score)!r}D" for r in own], "DOUBLE")),
    ]


def detect(events: DataFrame, rules: RuleSet, key: str = "event_id", keep: list[str] | None = None) -> DataFrame:
    """Alerts: the key, ALERT's columns, and the columns named in keep. One row for each event and rule that holds."""
    layout = layout_of(events, rules, key)
    found, hits = _matched(events, rules, layout, _hits(rules, layout))
    place, details = _free(found, "place"), _free(found, "details")
    found = found.filter(F.size(F.col(sql_name(hits))) > 0).withColumn(place, F.explode(F.col(sql_name(hits))))
    kept = list(dict.fromkeys([key, *(keep or [])]))
    # Details are computed for hits only, each by its rule's branch.
    found = found.selectExpr(*map(sql_name, kept), sql_name(place), f"{_details_of(rules, layout, sql_name(place))} AS {sql_name(details)}")
    alert = [f"{sql} AS {name}" for name, sql in _alert(rules, sql_name(place), sql_name(details))]
    return found.selectExpr(sql_name(key), *alert, *(sql_name(c) for c in kept if c != key))


def detect_count(events: DataFrame, rules: RuleSet, key: str = "event_id", per_event: bool = False) -> DataFrame:
    """The number of matches: one row, or one for each event. No alert is built."""
    layout = layout_of(events, rules, key)
    found, hits = _matched(events, rules, layout, _hits(rules, layout))
    counted = found.select(F.col(sql_name(key)), F.size(F.col(sql_name(hits))).cast("long").alias("matches"))
    return counted if per_event else counted.agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"))


def detect_batch(events: DataFrame, rules: RuleSet, key: str = "event_id") -> DataFrame:
    """A row for each event, also without matches: key, matches (array of alerts, by rule), rules_evaluated.

    Events are told apart by their rows, not by the key, which may repeat or be null; nothing is shuffled.
    """
    layout = layout_of(events, rules, key)
    found, hits = _matched(events, rules, layout, _hits(rules, layout))
    # The inner function gives each hit its details, the outer one its alert.
    details = f"transform({sql_name(hits)}, place_ -> named_struct('place', place_, 'details', {_details_of(rules, layout, 'place_')}))"
    alert = ", ".join(f"'{name}', {sql}" for name, sql in _alert(rules, "one_.place", "one_.details"))
    alerts = f"transform({details}, one_ -> named_struct({alert}))"
    return found.selectExpr(sql_name(key), f"{alerts} AS matches", f"{rules.rule_count} AS rules_evaluated")


def compile_test(test: Test, columns: list[str], mapping: FieldMapping | None = None) -> Column:
    """One field's test as a column over events in columns."""
    return F.expr(test_sql(test, Columns(columns, mapping or FieldMapping())))


def compile_identifier(identifier: Identifier, columns: list[str], mapping: FieldMapping | None = None) -> Column:
    return F.expr(identifier_sql(identifier, Columns(columns, mapping or FieldMapping())))


def compile_rule(text: str, columns: list[str], mapping: FieldMapping | None = None) -> Column:
    """A whole rule, with its log source, as a column over events in columns."""
    rules = RuleSet(mapping)
    rules.load_rule(text)
    if spark := SparkSession.getActiveSession():
        prepare(spark, rules)
    layout = Columns(columns, rules.mapping)
    own = rules.compiled[0]
    return F.expr(all_of([logsource_sql(own.rule.logsource, layout), any_of(_rule_sql(own, layout))]))
