"""What the operators of this subpackage share: word rules, the shared folder, tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_names(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that a table does not have."""
    taken, out, i = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if f"tmp{i}" not in taken:
            out.append(f"tmp{i}")
        i += 1
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, or one set here for a local session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidelog-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tidelog/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back: each row is computed once and survives lost executors."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, what))
    return spark.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, each: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Join rows with a table that has at most one row for each key, whatever share of the rows a key holds.

    Adaptive execution splits a hot key only where both sides are dealt out for the join. A table aggregated by the key is
    dealt out by it already and would be joined as it lies; one bit of the key's hash, as a further key, has it dealt out anew.
    """
    mark = F.hash(*key).bitwiseAND(1).alias("_hot")
    return rows.select("*", mark).join(each.select("*", mark), [*key, "_hot"], how).drop("_hot")


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def each_text(texts: pa.Array) -> Iterator[str | None]:
    """The texts of a batch one at a time: a worker holds the batch's bytes, not a string for each of its rows beside them."""
    return (x.as_py() for x in texts)


def whole_runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """From batches of rows sorted by ``key``, frames that hold each key's rows together."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch[key].to_numpy()
        if values[0] == values[-1] and (not kept or kept[-1][key].iat[-1] == values[-1]):
            kept.append(batch)
            continue
        cut = int((values != values[-1]).nonzero()[0][-1]) + 1 if values[0] != values[-1] else 0
        yield pd.concat([*kept, batch.iloc[:cut]], ignore_index=True)
        kept = [batch.iloc[cut:]]
    if kept:
        yield pd.concat(kept, ignore_index=True)
