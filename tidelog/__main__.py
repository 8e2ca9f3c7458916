"""Commands: read a log, show what is stored of a run, look values up, totals and history."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import store
from .plans.compress import compress
from .sources import logs


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidelog")
    out.add_argument("--store", default="runs", help="folder of stored runs")
    verbs = out.add_subparsers(dest="verb", required=True)
    verbs.add_parser("read", help="shorten logs").add_argument("path")
    for verb in ("raw", "get", "debug"):
        one = verbs.add_parser(verb)
        one.add_argument("run_id")
        one.add_argument("rest", nargs="*")
    verbs.add_parser("stats")
    verbs.add_parser("history").add_argument("--limit", type=int, default=10)
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """What a command prints. KeyError where a run is unknown."""
    if args.verb == "read":
        return [r["compressed"] or "" for r in compress(logs.read_logs(spark, args.path)).orderBy("run_id").toLocalIterator()]
    if args.verb == "raw":
        return [logs.load_run(spark, args.store, args.run_id)]
    if args.verb == "get":
        held = {r["id"]: r["value"] for r in logs.load_run(spark, args.store, args.run_id, "records") or []}
        return [held.get(x, "(not found)") for x in args.rest]
    if args.verb == "debug":
        return [f"{r['name']}\t{r['length']}" for r in logs.list_files(spark, f"{args.store}/{args.run_id}").orderBy("path").collect()]
    runs = store.usual(logs.read_runs(spark, args.store)).withColumnRenamed("run_id", "id").withColumn("cmd", F.col("command"))
    if args.verb == "stats":
        return [store.dashboard_text(runs, runs.select(F.lit("run").alias("subcommand"))).first()["text"]]
    return [r["line"] for r in store.history_lines(runs, args.limit).orderBy("rank").collect()]


def main() -> int:
    args = parser().parse_args()
    try:
        print(*run(SparkSession.builder.appName("tidelog").getOrCreate(), args), sep="\n")
    except KeyError as missing:
        print(missing, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
