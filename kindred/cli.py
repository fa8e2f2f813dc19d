"""Command line: python -m kindred.cli tokenize|decrypt|intersect|validate|pprl."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from kindred.operators import evaluate
from kindred.plans import workflows
from kindred.plans.profiles import WORKFLOW, Thresholds, chosen
from kindred.sources import config, sinks, tables


def output_name(prefix: str, first: str, second: str, extension: str = "csv") -> str:
    a, b = (os.path.splitext(os.path.basename(x))[0] for x in (first, second))
    return f"out/{prefix}_{a}_vs_{b}.{extension}"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kindred")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("tokenize")
    t.add_argument("--input", required=True)
    t.add_argument("--output", required=True)
    t.add_argument("--fields", default="", help="method:column,...; all columns by default")
    t.add_argument("--encrypt", action="store_true")
    t.add_argument("--key", default="")
    d = sub.add_parser("decrypt")
    d.add_argument("--input", required=True)
    d.add_argument("--output", required=True)
    d.add_argument("--key", default="")
    d.add_argument("--key-file", default="")
    i = sub.add_parser("intersect")
    v = sub.add_parser("validate")
    w = sub.add_parser("pprl")
    for s in (i, v, w):
        s.add_argument("--first", required=True)
        s.add_argument("--second", required=True)
        s.add_argument("--output", default="")
        s.add_argument("--hamming", type=int, default=None if s is i else 20)
        s.add_argument("--jaccard", type=float, default=None if s is i else 0.32)
    v.add_argument("--truth", required=True)
    return p


def _fields(df, given: list[str]) -> list[str]:
    return given or tables.headers(df)


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("kindred").getOrCreate()
    if a.command == "tokenize":
        df = tables.rows(spark, a.input)
        records = workflows.tokenize(df, _fields(df, [f for f in a.fields.split(",") if f]), order=[tables.POSITION])
        rows = sinks.token_rows(records, WORKFLOW)
        if a.encrypt:
            key = a.key or sinks.new_key_hex()
            sinks.write_encrypted(rows, a.output, key)
            if not a.key:
                sinks.save_key(f"{os.path.splitext(a.output)[0]}.key", key)
        else:
            sinks.save_tokens(rows, a.output)
    elif a.command == "decrypt":
        key = a.key or sinks.load_key(a.key_file or f"{os.path.splitext(a.input)[0]}.key")
        sinks.write_tokens(tables.encrypted_tokens(spark, a.input, key), a.output)
    elif a.command == "intersect":
        first, second = (tables.token_records(tables.last_tokens(tables.tokens_file(spark, x))) for x in (a.first, a.second))
        limits = None if a.hamming is None and a.jaccard is None else Thresholds(a.hamming or 0, a.jaccard or 0.0)
        sinks.write_intersection(workflows.intersect(first, second, limits), a.output or output_name("intersection", a.first, a.second))
    else:
        one, two = config.load_file(a.first), config.load_file(a.second)
        first, second = tables.load(spark, one.database), tables.load(spark, two.database)
        limits = chosen(Thresholds(a.hamming, a.jaccard), *(Thresholds(c.matching.hamming_threshold, c.matching.jaccard_threshold) for c in (one, two)))
        fields = _fields(first, one.database.fields)
        if a.command == "validate":
            parts = workflows.validate(first, second, tables.ground_truth(spark, a.truth), fields, limits)
            parts[0].show(truncate=False)
            evaluate.samples(parts[1]).orderBy("match_type", "place").show(truncate=False)
            sinks.write_report(parts, a.output or output_name("validation", a.first, a.second, "report"))
        else:
            mine, summary = workflows.two_party(*(workflows.tokenize(x, fields) for x in (first, second)), limits)
            if not summary.first()["equal"]:
                raise SystemExit("the parties' results differ")
            sinks.write_matches(mine, a.output or output_name("intersection_results", a.first, a.second, "json"), "json")


if __name__ == "__main__":
    main()
