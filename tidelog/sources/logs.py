"""Readers and writers for captured logs, stored runs and invocation records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TELEMETRY = "timestamp string, subcommand string, run_id string, track string, cmd string, exit_code int, raw_chars long, compressed_chars long, latency_ms double, experimental boolean, distill_called boolean, rtk_used boolean"
RUN_META = "id string, timestamp string, cmd string, track string, exit_code int, raw_chars long, compressed_chars long, compression_ratio double, preview string, raw_path string, experimental boolean"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``run_id`` (the path) and ``text``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("run_id"), F.col("value").alias("text"))


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TELEMETRY).json(path)


def stream_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(TELEMETRY).json(path)


def read_run_metas(spark: SparkSession, *paths: str) -> DataFrame:
    """Meta files of stored runs; of those that share an id, the one from the first path stays."""
    from functools import reduce

    from ..operators.store import first_by_id

    each = [spark.read.schema(RUN_META).option("multiLine", True).json(p).withColumn("_from", F.lit(i)) for i, p in enumerate(paths)]
    return first_by_id(reduce(DataFrame.unionByName, each), "id", "_from").drop("_from")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def save_runs(runs: DataFrame, path: str) -> None:
    """Append rows of runs, with their sizes and ratio, under a folder for each track."""
    raw, packed = F.length("raw"), F.length("compressed")
    sized = runs.withColumns({"raw_chars": raw.cast("long"), "compressed_chars": packed.cast("long"), "compression_ratio": F.when(raw == 0, F.lit(1.0)).otherwise(packed / raw)})
    sized.write.mode("append").partitionBy("track").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs under a folder that ``save_runs`` wrote."""
    return spark.read.parquet(path)


def load_run(spark: SparkSession, path: str, run_id: str, what: str = "raw") -> str:
    """One column (``raw``, ``compressed``, ``records``, ...) of a stored run; KeyError where there is no such run."""
    found = read_runs(spark, path).where(F.col("run_id") == run_id).select(F.col(what).alias("x")).first()
    if found is None:
        raise KeyError(f"no run {run_id!r}")
    return found["x"]


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder, with their sizes; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


def log_invocations(rows: DataFrame, path: str) -> None:
    """Append rows of invocations as lines of JSON; columns that the rows lack are null, others are kept."""
    known = [c.split()[0] for c in TELEMETRY.split(", ")]
    lacking = {c: F.lit(None).cast(c_type) for c, c_type in (x.split() for x in TELEMETRY.split(", ")) if c not in rows.columns}
    rows.withColumns(lacking).select(*known, *[c for c in rows.columns if c not in known]).write.mode("append").json(path)


def save_stages(tables: dict[str, DataFrame], path: str) -> None:
    """Snapshots of stages, one folder each, in order of the dict."""
    for i, (name, table) in enumerate(tables.items()):
        table.write.mode("overwrite").parquet(f"{path}/{i + 1:02d}_{name}")


def stage_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a stage did to each run: lines and characters before and after."""
    size = lambda rows, when: rows.groupBy("run_id").agg(F.count("line").alias(f"lines_{when}"), F.coalesce(F.sum(F.length("line")), F.lit(0)).alias(f"chars_{when}"))
    return size(before, "before").join(size(after, "after"), "run_id", "left").na.fill(0)
