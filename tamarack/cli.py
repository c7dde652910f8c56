"""Command line: JSON lines to alerts on the output, counts on the error output.

Codes: 0 success (a closed pipe too), 1 an error of reading, counting or, with --on-error fail-fast, of an event, 2 wrong arguments.
"""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from .operators.engine import detect
from .sources import sinks
from .sources.events import ERRORS, MAX_LINE_BYTES, accounting, check_accounting, error_samples, flatten_lines, read_lines
from .sources.rule_files import load_folder


def positive(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("has to be above 0")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tamarack", description="Detection rules over JSON lines.")
    p.add_argument("--rules", required=True, metavar="DIR", help="folder of YAML rules")
    p.add_argument("--on-error", choices=("continue", "fail-fast"), default="continue")
    p.add_argument("--max-line-bytes", type=positive, default=MAX_LINE_BYTES)
    p.add_argument("--max-error-samples", type=int, default=0)
    p.add_argument("--format", choices=("ndjson", "text"), default="ndjson")
    p.add_argument("--include-event", action="store_true")
    p.add_argument("--flush-alerts", action="store_true", help="flush after each alert")
    p.add_argument("--threads", type=int, default=1, help="local threads; 0 is all cores")
    p.add_argument("events", nargs="?", default="-", help="file of JSON lines; - or nothing is the standard input")
    return p


def _session(threads: int) -> SparkSession:
    active = SparkSession.getActiveSession()
    if active:
        return active
    spark = SparkSession.builder.master(f"local[{threads or '*'}]").appName("tamarack").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spooled = None
    try:
        rules, loaded, skipped, milliseconds = load_folder(args.rules)
        path = args.events
        if path == "-":
            with tempfile.NamedTemporaryFile("wb", suffix=".jsonl", delete=False) as f:
                f.writelines(iter(lambda: sys.stdin.buffer.read(1 << 20), b""))
            path = spooled = f.name
        elif not os.path.exists(path):
            raise OSError(f"cannot open events {path!r}")
        return _run(args, rules, loaded, skipped, milliseconds, path)
    except BrokenPipeError:
        return 0
    except OSError as error:
        print(error, file=sys.stderr)
        return 1
    finally:
        if spooled:
            os.unlink(spooled)


def _run(args: argparse.Namespace, rules, loaded: int, skipped: int, milliseconds: float, path: str) -> int:
    spark, began = _session(args.threads), time.perf_counter()
    flat = flatten_lines(read_lines(spark, path), max_line_bytes=args.max_line_bytes).persist()
    counts = accounting(flat).first().asDict()
    for row in error_samples(flat, args.max_error_samples).collect() if args.max_error_samples > 0 else []:
        print(f'ingest_error_sample: line={row["event_id"]} kind={row["error"]}', file=sys.stderr)
    good = flat.filter("error is null")
    failing = args.on_error == "fail-fast" and counts["events_failed"] > 0
    if failing:
        # What stands before the first bad line is still answered.
        first = flat.filter("error is not null").agg({"event_id": "min"}).first()[0]
        good = good.filter(good.event_id < first)
    alerts = detect(good, rules, keep=["event"])
    lines = sinks.ndjson(alerts, args.include_event) if args.format == "ndjson" else sinks.text(alerts)
    n = 0
    for row in sinks.ordered(lines).toLocalIterator():
        print(row["value"], flush=args.flush_alerts)
        n += 1
    flat.unpersist()
    seconds = time.perf_counter() - began
    report(args, counts, loaded, skipped, milliseconds, n, seconds)
    check_accounting(counts)
    if failing:
        print("an event is bad", file=sys.stderr)
    return int(failing)


def report(args: argparse.Namespace, counts: dict, loaded: int, skipped: int, milliseconds: float, n: int, seconds: float) -> None:
    def say(*parts: object) -> None:
        print(*parts, file=sys.stderr)

    say(f"rules: {loaded} loaded, {skipped} skipped ({milliseconds:.0f} ms) | events: {counts['events_total']} | ok: {counts['events_ok']} failed: {counts['events_failed']} | matches: {n} | threads: {args.threads} | on_error: {args.on_error} | format: {args.format} | include_event: {str(args.include_event).lower()} | max_line_bytes: {args.max_line_bytes} | input: {args.events} | scan: {seconds:.3f}s ({counts['events_total'] / max(seconds, 1e-9):.0f} events/sec)")
    say(f"tier_b_tax: total={seconds:.3f}s (stages run fused and are not timed apart)")
    say("ingest_errors:", *(f"{k}={counts[k]}" for k in ERRORS), f"flatten_total={counts['flatten_total']}", f"total={counts['events_failed']}")
    fits = counts["events_total"] == counts["events_ok"] + counts["events_failed"]
    say(f"ingest_accounting: events_total={counts['events_total']} events_ok={counts['events_ok']} events_failed={counts['events_failed']} invariant_ok={str(fits).lower()}")
