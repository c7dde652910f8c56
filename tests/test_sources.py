import io
import json
import sys

import pytest

from tamarack import cli
from tamarack.errors import FlattenError
from tamarack.operators.engine import detect
from tamarack.queries import rule, rule_set
from tamarack.sources import flatten, rule_files, sinks
from tamarack.sources.events import accounting, check_accounting, error_samples, flatten_lines, read_lines
from tamarack.sources.flatten import FlattenOptions, flatten_text
from tamarack.streaming import stream


@pytest.mark.parametrize("text, want", [
    # scalars, and numbers at the ends of their range
    ('{"width":12,"drop":-5,"ratio":0.25,"on":false,"off":true,"none":null}', {"width": "12", "drop": "-5", "ratio": "0.25", "on": "false", "off": "true", "none": ""}),
    (json.dumps({"n": [2**63 - 1, -(2**63), 2**64 - 1]}), {"n": f"{2**63 - 1}\n{-(2**63)}\n{2**64 - 1}", "n.0": str(2**63 - 1), "n.1": str(-(2**63)), "n.2": str(2**64 - 1)}),
    ('{"r":[2.0,3e20,4e-5,5e-9,-0.0]}', {"r": "2.0\n3e20\n0.00004\n5e-9\n-0.0", "r.0": "2.0", "r.1": "3e20", "r.2": "0.00004", "r.3": "5e-9", "r.4": "-0.0"}),
    # empty containers
    ("{}", {}), ('{"box":{}}', {}), ('{"box":[]}', {"box": ""}),
    # arrays: one element, several, objects, both, arrays
    ('{"box":["pen"]}', {"box": "pen"}), ('{"box":["pen",7,null]}', {"box": "pen\n7\n", "box.0": "pen", "box.1": "7", "box.2": ""}),
    ('{"box":[{"in":"x"},{"in":"y"}]}', {"box.0.in": "x", "box.1.in": "y"}), ('{"box":["pen",{"in":"x"}]}', {"box": "pen", "box.0": "pen", "box.1.in": "x"}),
    ('{"grid":[["n","s"],["e"]]}', {"grid.0": "n\ns", "grid.0.0": "n", "grid.0.1": "s", "grid.1": "e"}),
    # a name with a dot against a path, in either order, and a name twice
    ('{"net.port":"dot","net":{"port":"path"}}', {"net.port": "path"}), ('{"net":{"port":"path"},"net.port":"dot"}', {"net.port": "path"}), ('{"k":"first","k":"last"}', {"k": "last"}),
])
def test_flattening(text, want):
    assert flatten_text(text) == want


@pytest.mark.parametrize("text, kind", [("[1]", "flatten_not_object"), ('"x"', "flatten_not_object"), ("{", "json_parse"), ('{"a":NaN}', "json_parse"), ('{"a":1e999}', "json_parse"), ("", "json_parse"), ('{"a":' * 80 + "1" + "}" * 80, "flatten_depth"), ('{"a":' * 200 + "1" + "}" * 200, "json_parse")])
def test_flatten_errors(text, kind):
    with pytest.raises(FlattenError) as e:
        flatten_text(text)
    assert e.value.kind == kind


def test_limits():
    assert flatten_text('{"a":' * 80 + "1" + "}" * 80, FlattenOptions(max_depth=128))
    assert flatten_text('{"a":{"b":{"c":1}}}', FlattenOptions(max_depth=3))
    with pytest.raises(FlattenError):
        flatten_text('{"a":{"b":{"c":{"d":1}}}}', FlattenOptions(max_depth=3))
    ten = {f"k{i}": i for i in range(10)}
    assert len(flatten_text(json.dumps(ten), FlattenOptions(max_fields=10))) == 10
    with pytest.raises(FlattenError):
        flatten_text(json.dumps(ten | {"z": 1}), FlattenOptions(max_fields=10))
    assert flatten.float_text(0.1) == "0.1"


LINES = ['{"CommandLine":"whoami","n":{"x":1}}', '{"CommandLine":"dir"}', '{"broken"', "", "   ", "[1,2]", '{"CommandLine":"cmd /c WHOAMI","user":["a","b"]}', '{"a":' * 70 + "1" + "}" * 70, json.dumps({f"k{i}": 1 for i in range(10_001)})]
PACK = rule("s:\n  CommandLine|contains: whoami", "s", "whoami run", "id: r1\nlevel: high\ntags: [t]\n")


@pytest.fixture
def files(tmp_path):
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "b.yml").write_text(PACK)
    (tmp_path / "rules" / "a.yaml").write_text("title: [")
    (tmp_path / "rules" / "note.txt").write_text("no rule")
    events = tmp_path / "events.jsonl"
    events.write_bytes("\n".join(LINES).encode() + b'\n{"a":"\xff"}\n')
    return tmp_path


def test_accounting(spark, files):
    flat = flatten_lines(read_lines(spark, str(files / "events.jsonl")))
    row = accounting(flat).first().asDict()
    check_accounting(row)
    assert row == {"events_total": 8, "events_ok": 3, "events_failed": 5, "io_read": 0, "line_too_large": 0, "json_parse": 2, "flatten_not_object": 1, "flatten_depth": 1, "flatten_fields": 1, "flatten_total": 3}
    assert [tuple(r) for r in error_samples(flat, 2).collect()] == [(3, "json_parse"), (6, "flatten_not_object")]
    assert accounting(flatten_lines(read_lines(spark, str(files / "events.jsonl")), max_line_bytes=30)).first()["line_too_large"] == 4


def test_rule_folders(spark, files):
    rules, loaded, skipped, _ = rule_files.load_folder(str(files / "rules"))
    assert (rules.rule_count, loaded, skipped) == (1, 1, 1)
    assert [(r["category"], r["n"]) for r in rule_files.load_report(spark, str(files)).collect()] == [("parse", 1)]


def test_sinks(spark, files, tmp_path):
    flat = flatten_lines(read_lines(spark, str(files / "events.jsonl"))).filter("error is null")
    alerts = detect(flat, rule_set(PACK), keep=["event"])
    lines = [json.loads(r["value"]) for r in sinks.ordered(sinks.ndjson(alerts, include_event=True)).collect()]
    assert list(lines[0]) == ["event", "matched_identifiers", "rule_id", "rule_level", "rule_title", "score", "tags"]
    assert lines[0]["event"] == {"CommandLine": "whoami", "n.x": "1"} and lines[1]["event"]["user"] == "a\nb"
    sinks.write(sinks.text(alerts), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["high r1 whoami run"] * 2


def run_cli(monkeypatch, capsys, *args, stdin=b""):
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(stdin)))
    code = cli.main(list(args))
    out = capsys.readouterr()
    return code, out.out.splitlines(), out.err


def test_command_line(spark, files, monkeypatch, capsys):
    base = ["--rules", str(files / "rules")]
    code, out, err = run_cli(monkeypatch, capsys, *base, str(files / "events.jsonl"), "--max-error-samples", "1")
    assert code == 0 and len(out) == 2 and json.loads(out[0])["rule_id"] == "r1"
    assert "rules: 1 loaded, 1 skipped" in err and "events_total=8 events_ok=3 events_failed=5 invariant_ok=true" in err and err.count("ingest_error_sample") == 1
    assert run_cli(monkeypatch, capsys, *base, "--format=text", stdin=LINES[0].encode())[1] == ["high r1 whoami run"]
    code, out, _ = run_cli(monkeypatch, capsys, *base, "--on-error", "fail-fast", str(files / "events.jsonl"))
    assert code == 1 and len(out) == 1
    assert run_cli(monkeypatch, capsys, *base, "/nowhere.jsonl")[0] == 1
    for bad in (["--threads"], [*base, "--max-line-bytes", "0"], [*base, "--format", "xml"], [*base, "--zzz"]):
        with pytest.raises(SystemExit) as e:
            cli.main(bad)
        assert e.value.code == 2


def test_stream_equals_batch(spark, files, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.jsonl").write_text("\n".join(LINES[:4]))
    rules = rule_set(PACK)
    args = str(tmp_path / "out"), str(tmp_path / "state")
    stream.start(stream.detect_stream(stream.json_stream(spark, str(source)), rules), *args, once=True).awaitTermination()
    assert spark.read.parquet(args[0]).count() == 1
    (source / "2.jsonl").write_text("\n".join(LINES[4:]))
    stream.start(stream.detect_stream(stream.json_stream(spark, str(source)), rules), *args, once=True).awaitTermination()
    found = {(r["rule_id"], tuple(r["matched_identifiers"])) for r in spark.read.parquet(args[0]).collect()}
    assert found == {("r1", ("s",))} and spark.read.parquet(args[0]).count() == 2
