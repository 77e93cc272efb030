"""Command line: scan a tree and write its reports, or replay a log of steps.

    python -m marlstone.cli scan ROOT OUTPUT
    python -m marlstone.cli replay LOG.json [--max-steps N] [--max-total-tokens N]

A log has one JSON object a line, with the columns that operators.runs.replay takes. The exit code of a replay is 1 with
``--fail-on-nonfinished`` if a run didn't finish.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from marlstone.operators import budget, runs
from marlstone.plans import render, scan

LOG = "run_id string, step int, phase string, prompt string, response string, llm_calls int, stdout string, error string, result string"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="marlstone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = out.add_subparsers(dest="command", required=True)
    tree = commands.add_parser("scan", help="scan a tree")
    tree.add_argument("root")
    tree.add_argument("output")
    log = commands.add_parser("replay", help="replay a log of steps")
    log.add_argument("log")
    log.add_argument("--max-steps", type=int, default=budget.Limits.max_steps)
    log.add_argument("--max-total-tokens", type=int, default=budget.Limits.max_total_tokens)
    log.add_argument("--fail-on-nonfinished", action="store_true")
    return out


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("marlstone").getOrCreate()
    if args.command == "scan":
        got = scan.scan(spark, args.root, args.output)
        counts = got.counts.get
        print(f"{counts['total'] - counts['ignored']} files, {counts['ignored']} ignored; reports in {args.output}")
        return 0
    limits = budget.Limits(max_steps=args.max_steps, max_total_tokens=args.max_total_tokens)
    steps = runs.replay(spark.read.schema(LOG).json(args.log), limits).persist()
    by_run: dict[str, list[dict]] = {}
    for s in steps.select("run_id", "step", "kind", "stdout", "error", "violation").orderBy("run_id", "step").toLocalIterator():
        by_run.setdefault(s["run_id"], []).append({k: s[k] for k in ("step", "kind", "stdout", "error", "violation")})
    sums = {r["run_id"]: r.asDict() for r in budget.totals(steps).collect()}
    finished = True
    for r in runs.results(steps).orderBy("run_id").toLocalIterator():
        print(render.result_json(r["status"], r["result"], by_run[r["run_id"]], r["error"], sums[r["run_id"]]))
        finished &= r["status"] == "finished"
    return 1 if args.fail_on_nonfinished and not finished else 0


if __name__ == "__main__":
    sys.exit(main())
