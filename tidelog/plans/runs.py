"""Captured commands to stored runs: track, gate, short text, meta and invocation record, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import commands, routing
from ..operators import lines as ln
from .compress import compress

PASSED = r"(?i)=+\s*\d+\s+passed"


def green_texts(runs: DataFrame) -> DataFrame:
    """``run_id`` and ``green``: texts cleaned only where that is safe."""
    lines = ln.green(ln.split_lines(runs, "run_id", "raw"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return lines.groupBy("run_id").agg(F.array_join(rows, "\n").alias("green"))


def execute(captures: DataFrame, root: str = "~/.tidelog", home: str = "", **options) -> DataFrame:
    """What each captured command's run is stored as.

    ``captures``: ``run_id``, ``command``, ``in_shell``, ``stdout``, ``stderr``, ``exit_code``, ``timestamp``. Daemons have not run: exit code 2 and no
    text. Output of passthrough commands, of inline code and JSON for machines is cleaned only where that is safe; passed tests
    become one line; all else is compressed. Adds ``track``, ``base``, ``raw``, ``route``, ``compressed``, ``raw_chars``, ``compressed_chars``,
    ``compression_ratio``, ``preview`` and ``hint`` (null where none is due).
    """
    tracked = commands.classify(captures, shell=F.col("in_shell"))
    raw = F.when(F.col("track") == "daemon_warn", F.lit("")).otherwise(t.merge_output(F.col("stdout"), F.col("stderr")))
    code = F.when(F.col("track") == "daemon_warn", 2).otherwise(F.col("exit_code"))
    rows = tracked.withColumns({"raw": raw, "exit_code": code})
    passing = F.coalesce(routing.passes_through(F.col("track"), F.col("base"), F.col("raw")), F.lit(False))
    passed = (F.col("track") == "pytest_native") & (F.col("exit_code") == 0) & F.col("raw").rlike(PASSED)
    rows = rows.withColumns({"passing": passing, "passed": F.coalesce(passed, F.lit(False))})
    short = compress(rows.where("NOT passing AND NOT passed").select("run_id", "raw"), "run_id", "raw", **options).select("run_id", "route", F.col("compressed").alias("short"))
    made = rows.join(short, "run_id", "left").join(green_texts(rows.where("passing")), "run_id", "left")
    shown = F.when(F.col("passing"), F.coalesce("green", F.lit(""))).when(F.col("passed"), t.pytest_success(F.col("raw"))).otherwise(F.coalesce("short", "raw"))
    made = made.withColumn("compressed", shown).drop("short", "green")
    n, m = F.length("raw"), F.length("compressed")
    due = routing.wants_raw_hint(F.col("track"), F.col("raw"), F.col("compressed"), F.col("passed"), F.lit(False)) & ~F.col("passing")
    hint = routing.raw_hint(F.concat(F.lit(f"{root}/runs/"), F.col("run_id"), F.lit("/raw.txt")), home)
    ratio = F.when(n == 0, F.lit(1.0)).otherwise(m / n)
    sized = {"route": F.coalesce("route", F.lit("passthrough")), "raw_chars": n.cast("long"), "compressed_chars": m.cast("long"), "compression_ratio": ratio, "preview": t.preview(F.col("compressed")), "hint": F.when(due, hint)}
    return made.withColumns(sized).drop("passing", "passed")


def invocations(runs: DataFrame, subcommand: str = "run") -> DataFrame:
    """The invocation record of each run."""
    return runs.select("timestamp", F.lit(subcommand).alias("subcommand"), "run_id", "track", F.col("command").alias("cmd"), "exit_code", "raw_chars", "compressed_chars", F.lit(False).alias("experimental"))
