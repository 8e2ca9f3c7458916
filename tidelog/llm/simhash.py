"""SimHash near-dedup by multi-index hashing.

A fingerprint of 64 bits is cut into ``SEGMENTS`` segments. If two fingerprints differ in at most ``RADIUS`` bits, then in
at least one segment they differ in at most ``RADIUS // SEGMENTS`` bits. Each distinct fingerprint is stored under each of
its segments, and asks for every value in the small Hamming ball around each of its segments; what a value's row of the table
brings together is held against the complete distance. Rows of the table that many fingerprints share are split by the other
segments' bits: of ``RADIUS + 1`` blocks of these, two fingerprints within ``RADIUS`` have one in common.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each_text, free_names, join_hot, whole_runs, written
from .components import connected_components

RADIUS, SEGMENTS, SHINGLE, SEED = 3, 2, 3, 42
#: Runs of up to so many rows are compared by shifting; longer ones by a search that visits each row once.
SMALL = 8
#: A row of the table is split if more fingerprints than about so many ask for it.
HOT = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the XXH64 of the text's shingles (repeats included); 0 for null or no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: max(1, len(words) - shingle + 1)], ends[min(shingle, len(words)) - 1 :]
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)
        h = np.array([xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in spans], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(map(fingerprint, each_text(texts)), pa.int64())


def simhash(text: Column) -> Column:
    """The fingerprint of a text as a signed long."""
    return F.arrow_udf(_fingerprints, "long")(text)


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _search(h: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among h; each row is compared once with those not yet reached."""
    found, left = [], h.copy()
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                new = left[near]
                found += [(int(x), int(y)) for y in new]
                front += list(new)
                left = left[~near]
    return found


def _links(batches: Iterator[pd.DataFrame], radius: int = RADIUS) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(bucket=batch["key"].to_numpy() >> 1)

    for rows_of in whole_runs(rows(), "bucket"):
        bucket, away = rows_of["bucket"].to_numpy(), rows_of["key"].to_numpy() & 1
        h = rows_of["fp"].to_numpy().view(np.uint64)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        count = np.diff(np.r_[first, len(bucket)])
        use = (count > 1) & (away[first] == 0)  # sorted: those at home come first
        keep = np.repeat(use, count)
        bucket, h, count = bucket[keep], h[keep], count[use]
        if not len(h):
            continue
        size, out = np.repeat(count, count), []
        for d in range(1, SMALL):
            x, y = h[:-d], h[d:]
            near = (bucket[:-d] == bucket[d:]) & (size[d:] <= SMALL) & (np.bitwise_count(x ^ y) <= radius)
            out.append(np.stack([x[near], y[near]], 1).view(np.int64))
        for at, n in zip((np.cumsum(count) - count)[count > SMALL], count[count > SMALL], strict=True):
            if pairs := _search(h[at : at + n], radius):
                out.append(np.array(pairs, np.uint64).view(np.int64))
        a = np.unique(np.concatenate(out), axis=0)
        yield pd.DataFrame({"a": a[:, 0], "b": a[:, 1]})


def hamming_links(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, hot: int = HOT) -> DataFrame:
    """Edges ``a``, ``b`` whose components are those of all pairs of the distinct longs in column ``fp`` within ``radius`` bits."""
    width, ball = 64 // segments, radius // segments
    if ball > 1:
        raise ValueError("a ball of more than one bit isn't enumerated: take more segments")
    spark = fps.sparkSession
    fps = fps.select("fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # the ball multiplies rows: by number, so that they aren't packed together
    one = lambda i: F.lit(1 << i).cast("long")
    home = lambda s, value: F.lit(s << width).cast("long").bitwiseOR(value)
    flips = [None, *range(width if ball else 0)]
    parts = [F.shiftrightunsigned("fp", s * width).bitwiseAND((1 << width) - 1) for s in range(segments)]
    around = lambda bucket: F.array(*[bucket if i is None else bucket.bitwiseXOR(one(i)) for i in flips])
    probes = fps.select("fp", F.explode(F.array(*[F.struct(home(s, p if i is None else p.bitwiseXOR(one(i))).alias("bucket"), F.lit(int(i is not None)).alias("away")) for s, p in enumerate(parts) for i in flips])).alias("x"))
    # a bucket is asked for by those at home in it and in its ball; if none of these buckets holds more than a share of hot, it is not
    full = fps.select(F.explode(F.array(*[home(s, p) for s, p in enumerate(parts)])).alias("bucket")).groupBy("bucket").count().where(F.col("count") > hot // len(flips))
    asked = full.select(F.explode(around(F.col("bucket"))).alias("bucket"), "count").groupBy("bucket").agg(F.sum("count").alias("n")).where(F.col("n") > hot).select("bucket", F.lit(True).alias("split"))
    probes = join_hot(probes.select("fp", "x.bucket", "x.away"), written(asked, "hot"), ["bucket"], "left")
    bits = (64 - width) // (radius + 1)
    turns = [(s + 1) * width % 64 for s in range(segments)]
    rest = [F.col("fp") if not t else F.shiftrightunsigned("fp", t).bitwiseOR(F.shiftleft("fp", 64 - t)) for t in turns]
    others = reduce(lambda x, s: F.when(F.shiftrightunsigned("bucket", width) == s, rest[s]).otherwise(x), range(1, segments), rest[0])
    blocks = F.array(*[F.lit((k + 1) << bits).cast("long").bitwiseOR(F.shiftrightunsigned(others, k * bits).bitwiseAND((1 << bits) - 1)) for k in range(radius + 1)])
    sub = F.explode(F.when(F.col("split"), blocks).otherwise(F.array(F.lit(0).cast("long"))))
    keyed = probes.select("fp", "bucket", "away", sub.alias("sub"))
    room = bits + (radius + 2).bit_length()
    key = F.shiftleft(F.shiftleft("bucket", room).bitwiseOR(F.col("sub")), 1).bitwiseOR(F.col("away").cast("long"))
    dealt = keyed.select(key.alias("key"), "fp").repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    return dealt.mapInPandas(lambda batches: _links(batches, radius), "a long, b long")


def _grouped(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows as ``doc_id``, ``h`` (hash of the text), ``fp``; and for each fingerprint its component's ``root`` and least doc_id."""
    marks = written(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), simhash(F.col(text)).alias("fp")), "simhash")
    distinct = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(hamming_links(distinct))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marks, join_hot(rooted, roots, ["root"]).select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Link documents whose fingerprints differ in ``RADIUS`` bits or fewer; one row per row of ``docs``.

    Returns ``doc_id``, ``fingerprint`` (16 lowercase hex digits) and ``component_id``, the smallest doc_id reachable by
    links, itself included. Null and empty texts have fingerprint zero, which links like any other. A null doc_id gets
    its group's smallest one, null if the group has none. Repeated rows stay; other columns are ignored; an empty table gives
    no rows. Only distinct fingerprints are compared, so exact copies, however many, cost one row; within a large group
    of near ones a spanning forest is emitted, never all pairs.
    """
    marks, named = _grouped(docs, doc_id, text)
    return join_hot(marks, named, ["fp"]).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep one row of each group of near copies: that with the smallest doc_id, or of rows that share it, or have none, that with the least hash of its text.

    All columns stay, whatever their names. Rows alike in doc_id and text count as copies of one another, so one of them stays.
    An empty table gives no rows. Decisions are per row: a row goes only if its own text has a copy.
    """
    marks, named = _grouped(docs, doc_id, text)
    rows = join_hot(marks, named.select("fp", "root"), ["fp"]).groupBy("root", "doc_id", "h").agg(F.count("*").alias("n"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "n")).alias("x"))
    id_, h, n = free_names(docs, 3)
    best = written(best.select(F.col("x.doc_id").alias(id_), F.col("x.h").alias(h), F.col("x.n").alias(n)), "kept")
    kept = docs.alias("d").join(best.alias("k"), F.col(f"d.`{doc_id}`").eqNullSafe(F.col(f"k.{id_}")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col(f"k.{h}")))
    several = kept.where(F.col(n) > 1).dropDuplicates([id_, h])  # repeated rows
    return kept.where(F.col(n) == 1).union(several).select(*[F.col(f"`{c}`") for c in docs.columns])
