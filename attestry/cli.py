"""Command line: classify test files with recorded answers or a remote model, or evaluate reviewed records."""

from __future__ import annotations

import argparse
import math
import os
import re
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from attestry import taxonomy as X
from attestry.extract import stage
from attestry.functions.evidence import decision, margin
from attestry.operators import discovery, evaluate, report
from attestry.operators.responses import HttpProvider, Provider, RecordedProvider, pinned, predictions
from attestry.runtime import builder, ensure_workers, materialize
from attestry.sources.records import read_records, strict_records

NOTICE = "Source, imports, annotations and features of the tests found are sent to the model's service; test source may hold secrets."
KEY_VARIABLE, URL_VARIABLE = "ATTESTRY_API_KEY", "ATTESTRY_BASE_URL"


def thresholds(confidence: float, margin_: float, bounded: bool) -> tuple[float, float] | None:
    """The pair, or None for 0 and 0 (everything is reviewed); ValueError for one alone and, where bounded, outside [0, 1]."""
    if bounded:
        if not all(not math.isnan(x) and 0 <= x <= 1 for x in (confidence, margin_)):
            raise ValueError("thresholds lie between 0 and 1")
        if (confidence > 0) != (margin_ > 0):
            raise ValueError("give both thresholds or none")
    return (confidence, margin_) if confidence > 0 and margin_ > 0 else None


def seconds(text: str) -> float:
    """Seconds of a duration such as 90s, 1m30s, 500ms or 2h; ValueError for anything else or nothing positive."""
    units = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}
    parts = re.findall(r"([0-9]+(?:\.[0-9]+)?)(ms|h|m|s)", text)
    total = sum(float(n) * units[u] for n, u in parts)
    if "".join(n + u for n, u in parts) != text or total <= 0:
        raise ValueError(f"no positive duration: {text}")
    return total


def recorded_answers(spark: SparkSession, path: str, tests):
    """Recorded answers (test_id, response) joined to tests by their whole id; of several the last line's counts."""
    from attestry.runtime import numbered

    lines = numbered(spark.read.schema("test_id string, response string").json(path), "line")
    last = lines.groupBy("test_id").agg(F.max_by("response", "line").alias("response"))
    keyed = tests.withColumn("test_id", F.concat("path", F.lit("::"), "qualified")).join(last, "test_id", "left")
    return RecordedProvider(keyed.select("seq", "response"))


def classify(spark: SparkSession, paths: list[str], recorded: str | None = None, include=(), exclude=(), limits=None, provider: Provider | None = None, out=None, err=None) -> int:
    """Lists, reads, extracts, asks for or joins answers, decides and prints. 1 if a file was skipped or an answer is faulty."""
    out, err = out or sys.stdout, err or sys.stderr
    ensure_workers(spark)
    listed = discovery.candidates(discovery.list_files(spark, paths, exclude), include, exclude)
    rows = materialize(stage.extracted(discovery.read_files(listed)), "extracted")
    skipped = report.render_skipped(stage.skipped(rows))
    tests = stage.tests(rows).withColumn("seq", F.xxhash64("path", "qualified", "ord"))
    n = tests.limit(X.RUN_TESTS + 1).count()
    if not n:
        out.write(report.render_header())
        err.write(skipped or "no tests found\n")
        return 1 if skipped else 0
    if n > X.RUN_TESTS:
        print(f"more than {X.RUN_TESTS} tests", file=err)
        err.write(skipped)
        return 1
    if provider:
        print(NOTICE, file=err)
    else:
        provider = recorded_answers(spark, recorded, tests)
    answers = materialize(provider.responses(tests), "answers")  # a request is sent once
    done = materialize(predictions(tests, answers), "predicted")
    faults = done.filter("response_error is not null").select("path", "qualified", "response_error").orderBy("path", "ord").collect()  # at most RUN_TESTS rows
    if faults:
        for f in faults:
            print(f"{f.path}::{f.qualified}: {f.response_error}", file=err)
        err.write(skipped)
        return 1
    shown = done.withColumn("decision", decision(F.col("primary"), F.col("confidence"), margin(F.col("probabilities")), *(limits or (None, None))))
    out.write(report.render(report.rows(shown)))
    err.write(skipped)
    return 1 if skipped else 0


def parsed(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="attestry")
    sub = parser.add_subparsers(dest="command", required=True)
    c, e = sub.add_parser("classify"), sub.add_parser("evaluate")
    c.add_argument("paths", nargs="*")
    c.add_argument("--recorded", help="answers as JSON lines of test_id and response")
    c.add_argument("--remote", action="store_true", help=f"ask the service at ${URL_VARIABLE} with the key in ${KEY_VARIABLE}")
    c.add_argument("--include", action="append", default=[])
    c.add_argument("--exclude", action="append", default=[])
    c.add_argument("--format", choices=["table"], default="table")
    c.add_argument("--model", default=X.MODEL)
    c.add_argument("--experimental-model", action="store_true")
    c.add_argument("--concurrency", type=int, default=4)
    c.add_argument("--timeout", type=seconds, default=60.0)
    e.add_argument("--labels", required=True)
    for p in (c, e):
        p.add_argument("--min-confidence", type=float, default=0.0)
        p.add_argument("--min-margin", type=float, default=0.0)
    # flags and paths may stand in any order
    args = list(sys.argv[1:] if argv is None else argv)
    if args[:1] == ["classify"]:
        a = c.parse_intermixed_args(args[1:])
        a.command = "classify"
        return a
    return parser.parse_args(args)


def main(argv: list[str] | None = None) -> int:
    try:
        a = parsed(argv)
        limits = thresholds(a.min_confidence, a.min_margin, bounded=a.command == "classify")
        provider = None
        if a.command == "classify":
            if a.concurrency < 1:
                raise ValueError("concurrency is at least 1")
            if bool(a.recorded) == a.remote:
                raise ValueError("give either --recorded or --remote")
            if a.remote:
                key, url = (os.environ.get(v, "").strip() for v in (KEY_VARIABLE, URL_VARIABLE))
                if not key or not url:
                    raise ValueError(f"{URL_VARIABLE if key else KEY_VARIABLE} is not set")
                if not (a.experimental_model or pinned(a.model)):
                    raise ValueError("the model must be pinned")
                provider = HttpProvider(url, key, a.model, a.concurrency, timeout=a.timeout, experimental=a.experimental_model)
    except ValueError as x:
        print(x, file=sys.stderr)
        return 2
    except SystemExit as x:
        return int(x.code or 0)
    spark = builder().getOrCreate()
    try:
        if a.command == "classify":
            return classify(spark, a.paths, a.recorded, a.include, a.exclude, limits, provider)
        rows = strict_records(read_records(spark, a.labels))
        sys.stdout.write(evaluate.report_text(rows, a.min_confidence, a.min_margin))
        return 0
    except (ValueError, OSError) as x:
        print(x, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
