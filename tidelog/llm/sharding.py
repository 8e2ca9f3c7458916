"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

How many rows each part of the input sends to each shard is drawn first, without replacement, so that the shards' sizes are
exact; then each part permutes its rows, deals them out by its row of the matrix, and each shard permutes what it got.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, written

SHARDS, SEED, ROWS_IN_PART, MOST_PARTS, STRETCH = 8, 11, 4096, 65_536, 4096


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One exact draw; beyond the library's bound by inversion, over all values with a mass that a double can hold."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if n and good + bad else 0
    low, high = max(0, n - bad), min(n, good)
    mean = n * good / (good + bad)
    spread = math.sqrt(max(1.0, mean * (bad / (good + bad)) * (good + bad - n) / max(1, good + bad - 1)))
    k = np.arange(max(low, math.floor(mean - 40 * spread)), min(high, math.ceil(mean + 40 * spread)) + 1, dtype=np.float64)
    log = np.r_[0, np.cumsum(np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - n + k[:-1] + 1))]
    mass = np.cumsum(np.exp(log - log.max()))
    return int(k[np.searchsorted(mass, rng.random() * mass[-1])])


def communication_matrix(counts: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Row counts from each part to each shard: a draw from the law that a uniform permutation of all rows induces."""
    rng, total = np.random.default_rng(seed), sum(counts)
    room, out = [total // shards + (i < total % shards) for i in range(shards)], []
    for n in counts:
        row, rest = [], sum(room)
        for i in range(shards):
            rest -= room[i]
            row.append(_hypergeometric(rng, room[i], rest, n - sum(row)))
        room = [a - b for a, b in zip(room, row, strict=True)]
        out.append(row)
    return out


def _told_apart(rows: DataFrame) -> DataFrame:
    """Rows alike in ``_h`` and ``_g`` numbered from 0 in ``_twin``; others have 0 there.

    Twins are numbered by stretches of ``STRETCH`` rows as they lie, and stretches by running counts, so that not even a third of
    all rows being alike brings many into one task. Which of the twins gets which number makes no difference to the result.
    """
    many = rows.groupBy("_h", "_g").count().where("count > 1").select("_h", "_g")
    if many.isEmpty():
        return rows.withColumn("_twin", F.lit(0).cast("long"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    twins = join_hot(rows.select("_row", "_h", "_g"), many, ["_h", "_g"]).withColumn("_cell", F.floor(F.col("_row") / STRETCH))
    before = Window.partitionBy("_h", "_g").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = twins.groupBy("_h", "_g", "_cell").count().select("_h", "_g", "_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    turn = F.row_number().over(Window.partitionBy("_h", "_g", "_cell").orderBy("_row")) - 1
    each = twins.withColumn("_turn", turn).join(starts, ["_h", "_g", "_cell"]).select("_row", (F.col("_start") + F.col("_turn")).alias("_twin"))
    return rows.join(each, "_row", "left").withColumn("_twin", F.coalesce("_twin", F.lit(0).cast("long"))).drop("_row")


def shuffle(rows: DataFrame, key: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All rows with two more columns, ``shard`` and ``slot``: a seeded uniform permutation cut into ``shards`` shards.

    Shards' counts are at most one apart; slots are gapless from 0 in each. ``key``: the columns that seed a row's place,
    nulls among them allowed; rows equal in all of them are interchangeable. An empty table gives no rows. Names that
    begin with ``_`` are reserved. ``rows`` must come out alike whenever they are read, as a stored table does. The same rows, keys and seed give the same shards however the rows are partitioned.
    The driver gets a count for each of at most ``MOST_PARTS`` parts.
    """
    keys = [F.col(f"`{c}`") for c in key]
    hashes = lambda *more: {"_h": F.xxhash64(F.lit(seed), *keys, *more), "_g": F.xxhash64(F.lit(seed + 1), *keys, *more)}
    rows = _told_apart(rows.withColumns(hashes())).withColumns(hashes(F.col("_twin"))).drop("_twin")
    total = rows.count()
    parts = min(MOST_PARTS, max(1, -(-total // ROWS_IN_PART)))
    rows = rows.withColumn("_part", F.pmod(F.col("_h"), F.lit(parts)).cast("int"))
    counts = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}
    order = sorted(counts)
    ends = [[sum(r[: i + 1]) for i in range(shards)] for r in communication_matrix([counts[p] for p in order], shards, seed)]
    matrix = rows.sparkSession.createDataFrame(list(zip(order, ends, strict=True)), "_part int, _ends array<long>")
    own = Window.partitionBy("_part").orderBy("_h", "_g", *keys)
    rows = rows.withColumn("_turn", F.row_number().over(own) - 1).join(matrix, "_part")
    cells = max(1, parts // shards)
    rows = rows.withColumns({"shard": F.size(F.filter("_ends", lambda e: e <= F.col("_turn"))), "_cell": F.pmod(F.shiftrightunsigned("_g", 16), F.lit(cells)).cast("int")}).drop("_part", "_ends", "_turn", "_h")
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_cell").count().select("shard", "_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("_g", *keys)) - 1
    return rows.withColumn("_turn", place).join(starts, ["shard", "_cell"]).withColumn("slot", F.col("_start") + F.col("_turn")).drop("_cell", "_g", "_turn", "_start")


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's place in the shuffle: ``doc_id``, ``size`` (UTF-8 bytes plus 1; null text: 1), ``text_crc32`` (null text: 0), ``law`` (``rows``), ``shard``, ``slot``.

    Texts themselves stay where they are; see ``write_shards``. Repeated rows each get a slot; other columns are ignored.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32")), "places")
    return shuffle(rows, ["doc_id", "text_crc32"], shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"))


def write_shards(rows: DataFrame, key: list[str], path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write whole rows as ``path/shard=N`` in slot order; a shard's rows are split by ranges of slots, so no task holds a shard."""
    placed = shuffle(rows, key, shards, seed)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
