"""Queries over the provided tables, one for each operator, with hand-written SQL that they have to equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import reports
from .operators.engine import RuleSet, detect, detect_batch, detect_count
from .sources import generator, sinks
from .sources.events import ERRORS, accounting, error_samples, flatten_lines, from_table, lines_of
from .sources.flatten import FlattenOptions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rule(body: str, condition: str = "selection", title: str = "r", extra: str = "") -> str:
    """A rule whose detection has the given lines."""
    lines = "\n".join(f"  {line}" for line in body.strip("\n").splitlines())
    return f"title: {title}\n{extra}detection:\n{lines}\n  condition: {condition}\n"


def rule_set(*texts: str) -> RuleSet:
    rules = RuleSet()
    for text in texts:
        rules.load_rule(text)
    return rules


def _simple(name: str, source: str, key: str, columns: list[str], rules: Callable[[], RuleSet], where: str, frame: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A query of one rule that returns the keys that match, and SQL with the same condition."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, source)
        df = (frame(df) if frame else df).select(key, *columns)
        return detect(df, rules(), key).select(F.col(key).alias("k"))

    QUERIES[name] = run
    ORACLE_SQL[name] = where if where.lstrip().upper().startswith(("SELECT", "WITH")) else f"SELECT {key} AS k FROM {source} WHERE {where}"


def _one(body: str, condition: str = "selection") -> Callable[[], RuleSet]:
    return lambda: rule_set(rule(body, condition))


_simple("m0_exact", "events", "event_id", ["event_type"], _one("selection:\n  event_type: PURCHASE"), "event_type = 'purchase'")
_simple("m0_wildcard", "pages", "page_id", ["url"], _one("selection:\n  url: 'http*://*/?*1*'"), "regexp_full_match(lower(url), 'http.*://.*/..*1.*', 's')")
_simple("m1_contains", "documents", "doc_id", ["text"], _one("selection:\n  text|contains: ' The '"), "contains(lower(text), ' the ')")
_simple("m2_startswith", "part", "p_partkey", ["p_type"], _one("selection:\n  p_type|startswith: [stan, 'ECO']"), "starts_with(lower(p_type), 'stan') OR starts_with(lower(p_type), 'eco')")
_simple("m3_endswith", "part", "p_partkey", ["p_type"], _one("selection:\n  p_type|endswith: ium"), "ends_with(lower(p_type), 'ium')")
_simple("m4_re", "documents", "doc_id", ["text"], _one("selection:\n  text|re: '\\b[a-z]{2}th[aeiou]+\\b'"), "regexp_matches(text, '(?i)\\b[a-z]{2}th[aeiou]+\\b')")
_simple("m5_re_i", "documents", "doc_id", ["text"], _one("selection:\n  text|re|i: 'THE.{3}S'"), "regexp_matches(text, '(?i)THE.{3}S')")
_simple("m6_re_m", "documents", "doc_id", ["text"], _one("selection:\n  text|re|m: '^th[a-z]+\\.$'"), "regexp_matches(text, '(?im)^th[a-z]+\\.$')")
_simple("m7_re_s", "documents", "doc_id", ["text"], _one("selection:\n  text|re|s: 'the\\..tion'"), "regexp_matches(text, '(?is)the\\..tion')")
_simple("m9_all", "documents", "doc_id", ["text"], _one("selection:\n  text|contains|all: [' the ', 'tion', 'shed']"), "contains(lower(text), ' the ') AND contains(lower(text), 'tion') AND contains(lower(text), 'shed')")
_simple("m10_base64", "nation", "n_nationkey", ["b"], _one("selection:\n  b|base64|startswith: NATION_1"), "SELECT n_nationkey AS k FROM nation WHERE starts_with(lower(to_base64(encode(upper(n_name)))), lower(to_base64(encode('NATION_1'))))", lambda d: d.withColumn("b", F.base64(F.upper("n_name").cast("binary"))))
_simple("m11_base64offset", "nation", "n_nationkey", ["b"], _one("selection:\n  b|base64offset|contains: 'nation-7'"), "SELECT n_nationkey AS k FROM nation WHERE contains('see nation-' || CAST(n_nationkey AS VARCHAR) || ' now', 'nation-7')", lambda d: d.withColumn("b", F.base64(F.concat(F.lit("see nation-"), F.col("n_nationkey").cast("string"), F.lit(" now")).cast("binary"))))
_simple("m12_wide", "region", "r_regionkey", ["w"], _one("selection:\n  w|wide|contains: SIA"), "SELECT r_regionkey AS k FROM region WHERE contains(lower(r_name), 'sia')", lambda d: d.withColumn("w", F.array_join(F.transform(F.split("r_name", ""), lambda c: F.concat(c, F.lit("\0"))), "")))
_simple("m13_windash", "part", "p_partkey", ["c"], _one("selection:\n  c|windash|contains: ' -size 7'"), "SELECT p_partkey AS k FROM part WHERE starts_with(CAST(p_size AS VARCHAR), '7')", lambda d: d.withColumn("c", F.concat(F.lit("tool "), F.when(F.col("p_partkey") % 2 == 0, "/").otherwise("\u2013"), F.lit("size "), F.col("p_size").cast("string"))))
_simple("m14_gt", "orders", "o_orderkey", ["o_totalprice"], _one("selection:\n  o_totalprice|gt: 250000"), "o_totalprice > 250000")
_simple("m15_gte", "part", "p_partkey", ["p_size"], _one("selection:\n  p_size|gte: 25"), "p_size >= 25")
_simple("m16_lt", "customer", "c_custkey", ["c_acctbal"], _one("selection:\n  c_acctbal|lt: -10.5"), "c_acctbal < -10.5")
_simple("m17_lte", "lineitem", "l_orderkey", ["l_linenumber", "l_quantity"], _one("selection:\n  l_quantity|lte: 2\n  l_linenumber|gte: 3"), "l_quantity <= 2 AND l_linenumber >= 3")
_simple("m20_keyword", "nation", "n_nationkey", ["n_name", "n_regionkey"], _one("keywords: [an, '3']", "keywords"), "contains(lower(n_name), 'an') OR contains(CAST(n_regionkey AS VARCHAR), '3')")
_simple("m22_list", "events", "event_id", ["event_type"], _one("selection:\n  event_type: [click, signup, 'err*']"), "event_type IN ('click', 'signup') OR starts_with(event_type, 'err')")
_simple("m8_cidr", "customer", "c_custkey", ["ip"], _one("selection:\n  ip|cidr: [10.0.4.0/23, 192.168.0.0/16]"), "SELECT c_custkey AS k FROM customer WHERE c_custkey % 65536 BETWEEN 1024 AND 1535", lambda d: d.withColumn("ip", F.concat_ws(".", F.lit("10"), F.lit("0"), (F.floor(F.col("c_custkey") / 256) % 256).cast("string"), (F.col("c_custkey") % 256).cast("string"))))
_simple("m8_cidr6", "customer", "c_custkey", ["ip"], _one("selection:\n  ip|cidr: '2001:db8::1:0/118'"), "SELECT c_custkey AS k FROM customer WHERE c_custkey BETWEEN 0 AND 1023", lambda d: d.withColumn("ip", F.concat(F.lit(" 2001:DB8::1:"), F.hex("c_custkey"))))
_simple("m18_exists", "documents", "doc_id", ["quality"], _one("selection:\n  quality|exists: false"), "SELECT d.doc_id AS k FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE l.doc_id IS NULL")
_simple("m21_null", "conversations", "conv_id", ["turn", "t"], _one("selection:\n  t: null"), "SELECT conv_id AS k FROM conversations WHERE turn % 3 = 0", lambda d: d.withColumn("t", F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, F.col("text"))))
_simple("m19_fieldref", "lineitem", "l_orderkey", ["l_returnflag", "l_linestatus", "l_linenumber"], _one("selection:\n  l_returnflag|fieldref: l_linestatus\nfilter:\n  l_linenumber: 1", "selection or filter"), "lower(l_returnflag) = lower(l_linestatus) OR l_linenumber = 1")
_simple("m19_fieldref_contains", "part", "p_partkey", ["p_name", "w"], _one("selection:\n  p_name|fieldref|contains: w"), "SELECT p_partkey AS k FROM part WHERE contains(lower(p_name), chr(CAST(97 + p_partkey % 26 AS INT)))", lambda d: d.withColumn("w", F.expr("char(65 + p_partkey % 26)")))
_simple("b2_and_or_not", "events", "event_id", ["event_type", "user_id"], _one("a:\n  event_type: click\nb:\n  user_id|gt: 50\nc:\n  event_type: view", "(a and not b) or c and b"), "(event_type = 'click' AND NOT user_id > 50) OR (event_type = 'view' AND user_id > 50)")
_simple("b3_n_of", "part", "p_partkey", ["p_type", "p_size", "p_brand"], _one("s1:\n  p_type|contains: ar\ns2:\n  p_size|lt: 20\ns3:\n  p_brand|endswith: '3'", "2 of s*"), "CAST(contains(lower(p_type), 'ar') AS INT) + CAST(p_size < 20 AS INT) + CAST(ends_with(p_brand, '3') AS INT) >= 2")
_simple("b4_all_of", "part", "p_partkey", ["p_type", "p_size"], _one("s1:\n  p_type|contains: ar\ns2:\n  p_size|lt: 20", "all of them"), "contains(lower(p_type), 'ar') AND p_size < 20")
_simple("b7_explicit_list", "part", "p_partkey", ["p_type", "p_size", "p_brand"], _one("s1:\n  p_type|contains: ar\ns2:\n  p_size|lt: 3\nf:\n  p_brand|endswith: '3'", "1 of (s1, s2) and not 1 of f*"), "(contains(lower(p_type), 'ar') OR p_size < 3) AND NOT ends_with(p_brand, '3')")
_simple("b9_groups", "events", "event_id", ["event_type", "user_id"], _one("selection:\n  - event_type: click\n    user_id|lt: 20\n  - event_type: error"), "(event_type = 'click' AND user_id < 20) OR event_type = 'error'")
_simple("b10_logsource", "documents", "doc_id", ["product", "service", "text"], lambda: rule_set(rule("selection:\n  text|contains: en", extra="logsource:\n  product: FR\n  service: src3\n")), "SELECT doc_id AS k FROM documents WHERE lower(lang) = 'fr' AND lower(source) = 'src3' AND contains(lower(text), 'en')", lambda d: d.withColumnsRenamed({"lang": "product", "source": "service"}))
_simple("p3_field_mapping", "part", "p_partkey", ["command_line"], _one("selection:\n  CommandLine|endswith: all"), "SELECT p_partkey AS k FROM part WHERE ends_with(lower(p_type), 'all')", lambda d: d.withColumnRenamed("p_type", "command_line"))
_simple("s7_event_map", "part", "p_partkey", ["fields"], _one("selection:\n  P_TYPE|contains: ar\n  p_size|gte: 25"), "SELECT p_partkey AS k FROM part WHERE contains(lower(p_type), 'ar') AND p_size >= 25", lambda d: from_table(d.select("p_partkey", "p_type", "p_size"), "p_partkey"))



def _m18(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality").dropDuplicates(["doc_id"])
    df = _table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return detect(df, _one("selection:\n  quality|exists: false")(), "doc_id").select(F.col("doc_id").alias("k"))


QUERIES["m18_exists"] = _m18


def event_rules() -> RuleSet:
    """Rules over `events` of different levels."""
    return rule_set(
        rule("sel:\n  event_type: error\nbig:\n  user_id|gte: 50", "sel", "errors", "id: r-error\nlevel: high\ntags: [t.one, t.two]\n"),
        rule("sel:\n  event_type: purchase\nbig:\n  user_id|gte: 50", "[sel and big, big]", "purchases", "id: r-buy\nlevel: critical\n").replace("condition: [sel and big, big]", "condition:\n    - sel and big\n    - sel and not big"),
        rule("sel:\n  event_type|startswith: sign", "sel", "signups", "id: r-sign\nlevel: low\n"),
        rule("sel:\n  event_type: [view, click]\nfew:\n  user_id|lt: 5", "all of them", "few", "id: r-few\n"),
    )


_HITS = """WITH h AS (
SELECT event_id, user_id, 0 AS rule_idx FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, user_id, 1 FROM events WHERE event_type = 'purchase'
UNION ALL SELECT event_id, user_id, 2 FROM events WHERE event_type = 'signup'
UNION ALL SELECT event_id, user_id, 3 FROM events WHERE event_type IN ('view', 'click') AND user_id < 5),
r(rule_idx, rule_id, rule_title, rule_level, tags, score) AS (VALUES (0, 'r-error', 'errors', 'high', 't.one,t.two', 0.7), (1, 'r-buy', 'purchases', 'critical', '', 0.9), (2, 'r-sign', 'signups', 'low', '', 0.3), (3, 'r-few', 'few', 'medium', '', 0.5))
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(_events(spark, sf_dir), event_rules())
    joined = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("matched_conditions", "matched_identifiers", "tags")]
    return found.select("event_id", "rule_idx", "rule_id", "rule_title", "rule_level", *joined, "score")


def _add(name: str, sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


_add("j5_alerts", _HITS + """SELECT event_id, h.rule_idx, rule_id, rule_title, rule_level,
CASE WHEN h.rule_idx = 1 AND user_id < 50 THEN '1' ELSE '0' END AS matched_conditions,
CASE WHEN h.rule_idx IN (0, 1) AND user_id >= 50 THEN 'sel,big' WHEN h.rule_idx = 3 THEN 'sel,few' ELSE 'sel' END AS matched_identifiers,
tags, CAST(score AS DOUBLE) AS score FROM h JOIN r ON h.rule_idx = r.rule_idx""")(alerts)


@_add("a1_count_per_event", _HITS + "SELECT e.event_id, count(h.rule_idx) AS matches FROM events e LEFT JOIN h ON e.event_id = h.event_id GROUP BY e.event_id")
def _a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_count(_events(spark, sf_dir), event_rules(), per_event=True)


@_add("a2_count_total", _HITS + "SELECT count(*) AS matches FROM h")
def _a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_count(_events(spark, sf_dir), event_rules())


@_add("a6_count_per_rule", _HITS + "SELECT h.rule_idx, rule_id, rule_title, count(*) AS n FROM h JOIN r ON h.rule_idx = r.rule_idx GROUP BY 1, 2, 3")
def _a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.per_rule(detect(_events(spark, sf_dir), event_rules()))


@_add("a6_count_per_level", _HITS + "SELECT rule_level, count(*) AS n, CAST(max(score) AS DOUBLE) AS score FROM h JOIN r ON h.rule_idx = r.rule_idx GROUP BY 1")
def _a6_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.per_level(detect(_events(spark, sf_dir), event_rules()))


@_add("o5_top_rules", _HITS + "SELECT h.rule_idx, rule_id, rule_title, count(*) AS n FROM h JOIN r ON h.rule_idx = r.rule_idx GROUP BY 1, 2, 3 ORDER BY n DESC, h.rule_idx LIMIT 2")
def _o5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_rules(detect(_events(spark, sf_dir), event_rules()), 2)


@_add("s8_batch", _HITS + "SELECT e.event_id, coalesce(string_agg(CAST(h.rule_idx AS VARCHAR), ',' ORDER BY h.rule_idx), '') AS rules, 4 AS rules_evaluated FROM events e LEFT JOIN h ON e.event_id = h.event_id GROUP BY e.event_id")
def _s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_batch(_events(spark, sf_dir), event_rules())
    return found.select("event_id", F.array_join(F.transform("matches", lambda m: m["rule_idx"].cast("string")), ",").alias("rules"), "rules_evaluated")


@_add("j6_compare", "SELECT event_id, 1 AS rule_idx, true AS a, false AS b FROM events WHERE event_type = 'purchase' AND user_id < 50")
def _j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = detect(_events(spark, sf_dir), event_rules()).select("event_id", "rule_idx")
    b = detect(_events(spark, sf_dir).filter("event_type <> 'purchase' or user_id >= 50"), event_rules()).select("event_id", "rule_idx")
    return reports.compare_hits({"a": a, "b": b})


@_add("e4_symmetric_difference", "SELECT event_id, 1 AS rule_idx FROM events WHERE event_type = 'purchase' AND user_id < 50")
def _e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = detect(_events(spark, sf_dir), event_rules()).select("event_id", "rule_idx")
    b = detect(_events(spark, sf_dir).filter("event_type <> 'purchase' or user_id >= 50"), event_rules()).select("event_id", "rule_idx")
    return reports.symmetric_difference(a, b)


@_add("f1_flatten", "SELECT event_id, props->>'$.k' AS k FROM events")
def _f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flatten_lines(lines_of(_table(spark, sf_dir, "events"), "props"))
    return flat.select("event_id", F.col("event")["k"].alias("k"))


@_add("s9_json_rule", "SELECT event_id AS k FROM events WHERE CAST(props->>'$.k' AS INT) >= 90")
def _s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flatten_lines(lines_of(_table(spark, sf_dir, "events"), "props"))
    return detect(flat.filter("error is null"), _one("selection:\n  K|gte: 90")()).select(F.col("event_id").alias("k"))


@_add("a3_accounting", "SELECT count(*) AS events_total, count(*) FILTER (WHERE event_id % 5 > 1) AS events_ok, count(*) FILTER (WHERE event_id % 5 <= 1) AS events_failed, 0 AS io_read, 0 AS line_too_large, count(*) FILTER (WHERE event_id % 5 = 0) AS json_parse, count(*) FILTER (WHERE event_id % 5 = 1) AS flatten_not_object, 0 AS flatten_depth, 0 AS flatten_fields, count(*) FILTER (WHERE event_id % 5 = 1) AS flatten_total FROM events")
def _a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 5
    bad = F.when(n == 0, F.substring("props", 1, 3)).when(n == 1, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    return accounting(flatten_lines(lines_of(_table(spark, sf_dir, "events").select("event_id", bad.alias("line")), "line")))


@_add("k3_text", _HITS + "SELECT event_id, h.rule_idx, rule_level || ' ' || rule_id || ' ' || rule_title AS value FROM h JOIN r ON h.rule_idx = r.rule_idx")
def _k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.text(detect(_events(spark, sf_dir), event_rules()))


@_add("k1_ndjson", _HITS + """SELECT event_id, h.rule_idx, '{"matched_identifiers":["' || CASE WHEN h.rule_idx IN (0, 1) AND user_id >= 50 THEN 'sel","big' WHEN h.rule_idx = 3 THEN 'sel","few' ELSE 'sel' END
|| '"],"rule_id":"' || rule_id || '","rule_level":"' || rule_level || '","rule_title":"' || rule_title || '","score":' || CAST(score AS VARCHAR) || ',"tags":[' || CASE WHEN tags = '' THEN '' ELSE '"' || replace(tags, ',', '","') || '"' END || ']}' AS value
FROM h JOIN r ON h.rule_idx = r.rule_idx""")
def _k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.ndjson(detect(_events(spark, sf_dir), event_rules()))


@_add("s11_controlled_hits", "SELECT count(*) AS matches FROM range(12345) AS t(i) WHERE i % 10000 < 1000")
def _s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = generator.controlled(spark, 12345, 1000)
    return detect_count(events, rule_set(rule("selection:\n  A4Hit: '1'", extra="logsource:\n  product: windows\n  category: process_creation\n")))


def synthetic_pack(n: int) -> RuleSet:
    """n rules over process creation, for load and plan size."""
    rules = RuleSet()
    for i in range(n):
        rules.load_rule(rule(f"sel:\n  Image|endswith: '\\tool{i}.exe'\n  CommandLine|contains: ['-a{i}', 'zz{i}']\nfilter:\n  User: 'nobody{i}'", "sel and not filter", f"tool {i}", "logsource:\n  product: windows\n  category: process_creation\n"))
    rules.load_rule(rule("sel:\n  Image|endswith: '\\bitsadmin.exe'", "sel", "transfers", "logsource:\n  product: windows\n"))
    return rules


def orders_as_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as starts of programs, of which the pack names three quarters."""
    number = (F.col("o_orderkey") % 400).cast("string")
    name = F.when(F.col("o_orderkey") % 400 == 350, "BITSADMIN.exe").otherwise(F.concat(F.lit("Tool"), number, F.lit(".exe")))
    kind = F.col("o_custkey") % 4
    line = F.when(kind == 0, F.concat(F.lit("run -A"), number)).when(kind == 1, F.concat(F.lit("run zz"), number)).otherwise(F.lit("run"))
    own = {"Image": F.concat(F.lit("D:\\bin\\"), name), "CommandLine": line, "User": F.concat(F.lit("Nobody"), (F.col("o_orderkey") % 7).cast("string"))}
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.lit("process_creation").alias("category"), F.lit("windows").alias("product"), *(c.alias(n) for n, c in own.items()))


@_add("j1_rule_pack", """WITH h AS (SELECT CASE WHEN o_orderkey % 400 = 350 THEN 300 ELSE o_orderkey % 400 END AS rule_idx FROM orders
WHERE o_orderkey % 400 = 350 OR (o_orderkey % 400 < 300 AND o_custkey % 4 < 2 AND o_orderkey % 7 <> o_orderkey % 400))
SELECT CAST(rule_idx AS INT) AS rule_idx, CASE WHEN rule_idx = 300 THEN 'transfers' ELSE 'tool ' || rule_idx END AS rule_title, count(*) AS n FROM h GROUP BY 1, 2""")
def _j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.per_rule(detect(orders_as_starts(spark, sf_dir), synthetic_pack(300))).drop("rule_id")


_NESTED = "'{\"a\":{\"b\":' || (event_id % 97) || ',\"c\":\"x' || event_id || '\"},\"d\":[1.50,' || event_id || ',null],\"e\":[],\"f\":null,\"g\":true,\"h\":[{\"i\":' || event_id || '}],\"j\":[\"one\"],\"a.b\":0}'"


@_add("f3_flatten_nested", """SELECT event_id, CAST(event_id % 97 AS VARCHAR) AS a_b, 'x' || event_id AS a_c, '1.5' AS d_0, CAST(event_id AS VARCHAR) AS d_1, '' AS d_2,
'1.5' || chr(10) || event_id || chr(10) AS d, '' AS e, '' AS f, 'true' AS g, CAST(event_id AS VARCHAR) AS h_0_i, 'one' AS j, 11 AS n FROM events""")
def _f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects, arrays, scalars, and a path that collides with a name."""
    flat = flatten_lines(lines_of(_table(spark, sf_dir, "events").select("event_id", F.expr(_NESTED).alias("line")), "line"))
    names = ("a.b", "a.c", "d.0", "d.1", "d.2", "d", "e", "f", "g", "h.0.i", "j")
    return flat.select("event_id", *(F.col("event")[n].alias(n.replace(".", "_")) for n in names), F.size("event").alias("n"))


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three events one is nested too deeply and one has too many fields."""
    n = F.col("event_id") % 3
    line = F.when(n == 0, '{"a":{"b":{"c":{"d":1}}}}').when(n == 1, '{"a":1,"b":2,"c":3,"d":4,"e":5}').otherwise('{"a":{"b":{"c":1}},"d":[1,2]}')
    return flatten_lines(lines_of(_table(spark, sf_dir, "events").select("event_id", line.alias("line")), "line"), FlattenOptions(max_depth=3, max_fields=4))


@_add("f7_flatten_guards", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'flatten_depth' WHEN 1 THEN 'flatten_fields' END AS error, CASE WHEN event_id % 3 = 2 THEN 4 END AS n FROM events")
def _f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guarded(spark, sf_dir).select("event_id", "error", F.when(F.col("error").isNull(), F.size("event")).alias("n"))


@_add("a4_invariant", "SELECT count(*) AS events_total, count(*) AS ok_and_failed, count(*) FILTER (WHERE event_id % 3 < 2) AS by_kind FROM events")
def _a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = accounting(_guarded(spark, sf_dir))
    return row.select("events_total", (F.col("events_ok") + F.col("events_failed")).alias("ok_and_failed"), sum((F.col(k) for k in ERRORS), F.lit(0)).alias("by_kind"))


@_add("o4_first_errors", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'flatten_depth' ELSE 'flatten_fields' END AS error FROM events WHERE event_id % 3 < 2 ORDER BY event_id LIMIT 5")
def _o4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_samples(_guarded(spark, sf_dir), 5)


def _loaded(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Rules that three engines loaded: of the numbers of nations all, even ones, and those that 3 divides."""
    numbers = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("rule_idx"))
    return {"a": numbers, "b": numbers.filter("rule_idx % 2 = 0"), "c": numbers.filter("rule_idx % 3 = 0")}


@_add("e3_common_rules", "SELECT CAST(n_nationkey AS INT) AS rule_idx FROM nation WHERE n_nationkey % 6 = 0")
def _e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.common_rules(_loaded(spark, sf_dir))


@_add("a8_loaded_counts", "SELECT 'a' AS engine, count(*) AS n FROM nation UNION ALL SELECT 'b', count(*) FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'c', count(*) FROM nation WHERE n_nationkey % 3 = 0")
def _a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.loaded_counts(_loaded(spark, sf_dir))


@_add("j6_disagreements", "SELECT 1 AS rule_idx, count(*) AS n FROM events WHERE event_type = 'purchase' AND user_id < 50 HAVING count(*) > 0 UNION ALL SELECT 2, count(*) FROM events WHERE event_type = 'signup' AND user_id >= 50 HAVING count(*) > 0")
def _j6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three engines, of which two each miss some events."""
    a = detect(_events(spark, sf_dir), event_rules()).select("event_id", "rule_idx")
    b = detect(_events(spark, sf_dir).filter("event_type <> 'purchase' or user_id >= 50"), event_rules()).select("event_id", "rule_idx")
    c = detect(_events(spark, sf_dir).filter("event_type <> 'signup' or user_id < 50"), event_rules()).select("event_id", "rule_idx")
    return reports.disagreements({"a": a, "b": b, "c": c})
