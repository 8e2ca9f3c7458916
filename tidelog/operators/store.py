"""Analytics over stored runs and invocations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def usual(rows: DataFrame) -> DataFrame:
    """Without experimental rows."""
    return rows.where(~F.coalesce(F.col("experimental"), F.lit(False)))


def dashboard(runs: DataFrame) -> DataFrame:
    """One row: runs, characters before and after, ratio (1 without any), saved, tokens."""
    n = runs.agg(F.count("*").alias("total_runs"), F.coalesce(F.sum("raw_chars"), F.lit(0)).alias("raw_chars"), F.coalesce(F.sum("compressed_chars"), F.lit(0)).alias("compressed_chars"))
    saved = F.greatest(F.lit(0).cast("long"), F.col("raw_chars") - F.col("compressed_chars"))
    ratio = F.when(F.col("raw_chars") == 0, F.lit(1.0)).otherwise(F.col("compressed_chars") / F.col("raw_chars"))
    return n.select("*", saved.alias("chars_saved"), ratio.alias("compression_ratio"), F.floor(saved / 4).alias("tokens_saved"))


def counts_by(rows: DataFrame, column: str, other: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column), F.lit(other)).alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def history(runs: DataFrame, limit: int = 10) -> DataFrame:
    """The latest runs with their saving in per cent."""
    saved = F.greatest(F.col("raw_chars") - F.col("compressed_chars"), F.lit(0))
    pct = F.when(F.col("raw_chars") > 0, F.round(saved * 100.0 / F.col("raw_chars"))).otherwise(0.0)
    top = runs.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)
    return top.select("id", "timestamp", pct.cast("int").alias("saved_pct"), F.format_string("%d->%d", "raw_chars", "compressed_chars").alias("chars"), t.preview(F.col("preview"), 24).alias("content"))


def first_by_id(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key: the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


# The dashboard's and the history's words and widths.
DASHBOARD = ("Session stats", "  Runs:           %,d", "  Raw chars:      %,d", "  Compressed:     %,d", "  Chars saved:    %,d", "  Ratio:          %.2f%%", "  Tokens saved:   ~%,d (chars/4)")
WIDTHS = {"id": 6, "saved": 12, "chars": 16, "date": 8, "cmd": 24, "content": 24}


def dashboard_text(runs: DataFrame, invoked: DataFrame) -> DataFrame:
    """The dashboard as one text: totals, then runs by track and invocations by subcommand, the most frequent first."""
    total = dashboard(runs).select(F.format_string("\n".join(DASHBOARD), "total_runs", "raw_chars", "compressed_chars", "chars_saved", F.col("compression_ratio") * 100, "tokens_saved").alias("head"))

    def block(rows: DataFrame, column: str, title: str) -> DataFrame:
        n = rows.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("name")).agg(F.count("*").alias("n"))
        each = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "name", "n")))
        shown = F.array_join(F.transform(each, lambda x: F.format_string("\n    %s: %d", x["name"], x["n"])), "")
        return n.agg(F.when(F.count("*") > 0, F.concat(F.lit(f"\n  {title}:"), shown)).otherwise("").alias(title))

    both = total.join(block(runs, "track", "Tracks")).join(block(invoked, "subcommand", "Subcommands"))  # one row each
    return both.select(F.concat("head", "Tracks", "Subcommands", F.lit("\n")).alias("text"))


def history_lines(runs: DataFrame, limit: int = 10) -> DataFrame:
    """The latest runs as lines of fixed width: ``rank`` and ``line``."""
    top = runs.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("timestamp"), F.desc("id"))))
    saved = F.greatest(F.col("raw_chars") - F.col("compressed_chars"), F.lit(0)) * 100.0 / F.when(F.col("raw_chars") > 0, F.col("raw_chars"))
    pad = lambda x, name: F.rpad(x, WIDTHS[name], " ")
    cells = [pad(F.col("id"), "id"), pad(F.format_string("%.0f%% saved", F.bround(F.coalesce(saved, F.lit(0.0)), 0)), "saved"), pad(F.format_string("%d->%d", "raw_chars", "compressed_chars"), "chars"), pad(t.short_date(F.col("timestamp")), "date"), t.clip(t.strip(F.coalesce("cmd", F.lit(""))), WIDTHS["cmd"]), t.clip(F.coalesce("preview", F.lit("")), WIDTHS["content"])]
    return top.select("rank", F.concat_ws(" ", *cells).alias("line"))
