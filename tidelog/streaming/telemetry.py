"""Running totals over a stream of invocations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def savings(invocations: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per window and subcommand: invocations and characters saved; late rows wait for the watermark. Works on batches too."""
    timed = invocations.withColumn("at", F.to_timestamp("timestamp")).withWatermark("at", late)
    saved = F.sum(F.greatest(F.lit(0).cast("long"), F.col("raw_chars") - F.col("compressed_chars")))
    return timed.groupBy(F.window("at", every), "subcommand").agg(F.count("*").alias("n"), saved.alias("chars_saved"))
