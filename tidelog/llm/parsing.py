"""Document fingerprints by locally consistent parsing.

Runs of equal symbols become one symbol. Deterministic coin tossing then labels each symbol by the lowest bit in which it differs
from the one before it, again and again until fewer than six labels are left; local maxima of the labels, and minima
that no maximum adjoins, open phrases. A phrase's name is a hash of its symbols, and the names are the next level's
symbols. Where a phrase begins depends on a few symbols around it, so equal substrings share all names but those at their ends,
wherever they stand. A fingerprint has, for each level, the least of the phrase names that fall into each of its slots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rolling import between, mix, prefix

#: Slots of each level, from single characters to phrases of some fifty.
SLOTS = (4, 4, 8, 24, 24)
ROUNDS, EMPTY, CHUNK = 4, 0xFFFF, 1_500_000
#: Texts of more characters are parsed block by block; symbols in a block.
LONG, SYMBOLS = 1 << 20, 1 << 18
#: Bytes of text in a range of documents, about; ranges are made up of parts, FINE of them for each.
RANGE_BYTES, FINE = 64 << 20, 8
NO_ID = -(2**63)


def _collapse(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal symbols as one symbol; first: marks each text's first symbol."""
    opens = first.copy()
    opens[1:] |= x[1:] != x[:-1]
    start = np.flatnonzero(opens)
    return _with_length(x[start], np.diff(np.r_[start, len(x)])), first[start]


def _with_length(symbol: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Symbols of runs; lone ones stay as they are."""
    many = length > 1
    out = symbol.copy()
    out[many] = mix(out[many] + length[many].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _phrases(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases open; neighbours within a text differ."""
    label = x
    for _ in range(ROUNDS):
        before = np.r_[np.uint64(0), label[:-1]]
        before[first] = label[first] ^ np.uint64(1)
        differ = label ^ before
        low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        label = low * np.uint64(2) + (label >> low & np.uint64(1))
    small = label.astype(np.int8)
    last = np.r_[first[1:], True]
    left, right = np.r_[np.int8(-1), small[:-1]], np.r_[small[1:], np.int8(-1)]
    inner = ~(first | last)
    high = inner & (small > left) & (small > right)
    low_ = inner & (small < left) & (small < right)
    low_ &= ~(np.r_[False, high[:-1]] | np.r_[high[1:], False])
    return first | high | low_


def levels(texts: list[str], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n levels of all texts, without empty ones: names, and marks of each text's first."""
    x = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.zeros(len(x), bool)
    first[np.cumsum(size) - size] = True
    yield mix(x), first
    for level in range(1, n):
        x, first = _collapse(x, first)
        start = np.flatnonzero(_phrases(x, first))
        x, first = between(prefix(x), start, np.r_[start[1:], len(x)]), first[start]
        yield mix(x + np.uint64(level)), first


def _runs(blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """As ``_collapse``, of one text in blocks: each block's last run waits for the next block."""
    symbol, length = np.empty(0, np.uint64), 0
    for x in blocks:
        x = np.concatenate([symbol, x])
        opens = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        size = np.diff(np.r_[opens, len(x)])
        size[0] += max(0, length - 1)
        out = _with_length(x[opens], size)[:-1]
        symbol, length = x[-1:], int(size[-1])
        if len(out):
            yield out
    if length:
        yield _with_length(symbol, np.array([length]))


def _next_level(blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Hashes of the phrases of one text whose symbols come in blocks. What a block's end may still change waits for the next one."""
    context = ROUNDS + 3
    held, open_at, begins = np.empty(0, np.uint64), 0, True
    for x in chain(_runs(blocks), [None]):
        held = held if x is None else np.concatenate([held, x])
        if not len(held):
            return
        first = np.zeros(len(held), bool)
        first[0] = begins
        starts = np.flatnonzero(_phrases(held, first)[: len(held) if x is None else max(0, len(held) - 3)])
        cuts = np.array([open_at, *starts[starts > open_at], *[len(held)] * (x is None)], np.int64)
        if len(cuts) > 1:
            yield between(prefix(held), cuts[:-1], cuts[1:])
        drop = max(0, int(cuts[-1]) - context)
        held, open_at, begins = held[drop:], int(cuts[-1]) - drop, begins and not drop


def _long_print(text: str, block: int = SYMBOLS) -> np.ndarray:
    """The fingerprint of one text, a block at a time on all levels: memory doesn't grow with the text."""
    least = [np.full(slots, np.iinfo(np.uint64).max, np.uint64) for slots in SLOTS]

    def watched(blocks: Iterator[np.ndarray], level: int) -> Iterator[np.ndarray]:
        for x in blocks:
            names = mix(x + np.uint64(level))
            np.minimum.at(least[level], (names % np.uint64(SLOTS[level])).astype(np.int64), names)
            yield x

    blocks = watched((np.frombuffer(text[i : i + block].encode("utf-32-le"), np.uint32).astype(np.uint64) for i in range(0, len(text), block)), 0)
    for level in range(1, len(SLOTS)):
        blocks = watched(_next_level(blocks), level)
    for _ in blocks:
        pass
    found = np.concatenate(least)
    return np.where(found < np.iinfo(np.uint64).max, mix(found) % np.uint64(EMPTY), np.uint64(EMPTY)).astype(np.uint16)


def fingerprints(texts: list[str], long: int = LONG) -> np.ndarray:
    """A row of ``sum(SLOTS)`` 16-bit values for each text; EMPTY where no phrase fell. Texts of more than ``long`` characters are parsed block by block."""
    out = np.full((len(texts), sum(SLOTS)), EMPTY, np.uint16)
    for i, t in enumerate(texts):
        if len(t) > long:
            out[i] = _long_print(t)
    full = [i for i, t in enumerate(texts) if t and len(t) <= long]
    if full:
        at = 0
        for slots, (names, first) in zip(SLOTS, levels([texts[i] for i in full], len(SLOTS)), strict=True):
            key = (np.cumsum(first) - 1) * slots + (names % np.uint64(slots)).astype(np.int64)
            least = np.full(len(full) * slots, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, key, names)
            value = np.where(least < np.iinfo(np.uint64).max, mix(least) % np.uint64(EMPTY), np.uint64(EMPTY))
            out[full, at : at + slots] = value.astype(np.uint16).reshape(-1, slots)
            at += slots
    return out


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The part of the slots filled in either that agree; 1 where both are wholly empty."""
    used = (a != EMPTY) | (b != EMPTY)
    return np.where(used.any(1), ((a == b) & used).sum(1) / np.maximum(used.sum(1), 1), 1.0)


def as_text(prints: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in prints.astype(">u2")]


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as lowercase hex; null counts as empty, and an empty text has an empty fingerprint of its own."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(as_text(np.concatenate([fingerprints([t]) for t in texts.fillna("")] or [np.empty((0, sum(SLOTS)), np.uint16)])))

    return F.pandas_udf(run, "string")(text)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1."""
    slots = F.transform(F.sequence(F.lit(0), F.lit(sum(SLOTS) - 1)), lambda i: F.struct(F.substring(a, i * 4 + 1, F.lit(4)).alias("x"), F.substring(b, i * 4 + 1, F.lit(4)).alias("y")))
    used = F.filter(slots, lambda s: (s["x"] != "ffff") | (s["y"] != "ffff"))
    return F.when(F.size(used) == 0, F.lit(1.0)).otherwise(F.size(F.filter(used, lambda s: s["x"] == s["y"])) / F.size(used))


def edited(text: str, other: str) -> str:
    """The last third of a text gives way to as much of another's beginning."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def _compare(rows: list[tuple], heir: tuple) -> pd.DataFrame:
    """rows: (doc_id, text) in order; heir: what follows the last."""
    texts = [t for _, t in rows] + [heir[1]]
    changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    prints = fingerprints(texts + changed)
    own, next_, other = prints[: len(rows)], prints[1 : len(texts)], prints[len(texts) :]
    return pd.DataFrame(
        {"doc_id": pd.array([i for i, _ in rows], "Int64"), "n_chars": list(map(len, texts[:-1])), "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed]}
        | {"fingerprint": as_text(own), "edited_fingerprint": as_text(other), "near_edited": alike(own, other), "near_next": alike(own, next_)}
    )


def _follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by part and place; each is held against the one after it, a part's last against a guest."""
    rows, size, last = [], 0, None
    for batch in batches:
        ids = [None if x is None or x != x else int(x) for x in batch["doc_id"].astype(object)]
        for part, doc_id, text, guest in zip(batch["part"].tolist(), ids, batch["text"], batch["guest"].tolist(), strict=True):
            if rows and (part != last or guest or size > CHUNK):
                yield _compare(rows, (doc_id, text))
                rows, size = [], 0
            if not guest:
                rows.append((doc_id, text))
                size += len(text)
            last = part
    if rows:
        raise RuntimeError("a part has no guest")


class Ranges:
    """Documents in descending order of doc_id, those without one last, cut into ranges of like size.

    ``bounds``: where parts of doc_ids begin; documents without doc_id are cut by a hash. Each part belongs to a range; ``heads`` has each
    range's first document as doc_id and hash.
    """

    def __init__(self, bounds: np.ndarray, shares: int, stats: list[tuple[int, int, int, int]], most: int):
        """stats: part, bytes, and doc_id and hash of its first document, by part."""
        self.bounds, self.shares = bounds, shares
        self.range_of, self.heads, size = np.zeros(len(bounds) + 1 + shares, np.int32), [], most
        for part, n, key, h in stats:
            if size + n > most and (size or not self.heads):
                self.heads.append((key, h))
                size = 0
            size += n
            self.range_of[part] = len(self.heads) - 1

    def parts(self, key: np.ndarray, none: np.ndarray, h: np.ndarray) -> np.ndarray:
        by_id = len(self.bounds) - np.searchsorted(self.bounds, key, "right")
        return np.where(none, len(self.bounds) + 1 + (((h >> 48) + (1 << 15)) * self.shares >> 16), by_id)

    def places(self, key: np.ndarray, none: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document's range, and the range before it where it is its range's first, else -1."""
        at = self.range_of[self.parts(key, none, h)]
        keys, hashes = (np.array(x, np.int64) for x in zip(*self.heads, strict=True))
        return at, np.where((keys[at] == key) & (hashes[at] == h), (at - 1) % len(self.heads), -1)


def compare_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprint each document and its edited text, whose last third is the beginning of the document with the next smaller doc_id.

    One row per row of ``docs``: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next``. After the smallest doc_id comes the largest; rows without doc_id come after all others; these, and rows of one doc_id,
    follow in order of their texts' XXH64, then of their texts. Null texts count as empty. Other columns are ignored; an empty table gives no
    rows. Documents are cut into ranges of about ``range_bytes``, each a partition; a range's first also goes, as a guest, to the range
    before it, so texts move once. The driver gets quantiles and a row for each part of a range. A doc_id that most rows share is one range.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    none, key, h = F.col(doc_id).isNull(), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), F.xxhash64(whole)
    narrow = docs.select(none.alias("none"), key.alias("key"), h.alias("h"), (F.octet_length(whole) + 1).alias("n"))
    total, count = narrow.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    most = min(range_bytes, total // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1)
    shares = min(65_536, max(1, FINE * -(-total // most)))
    bounds = np.unique(narrow.where("NOT none").approxQuantile("key", [i / shares for i in range(1, shares)], 0.2 / shares) if shares > 1 and count else []).astype(np.int64)
    ranges = Ranges(bounds, shares, [], most)
    part = F.pandas_udf(lambda k, x, h: pd.Series(ranges.parts(k.to_numpy(), x.to_numpy(), h.to_numpy())), "int")
    first = F.min(F.struct(F.bitwise_not("key").alias("at"), "h")).alias("first")
    stats = narrow.withColumn("part", part("key", "none", "h")).groupBy("part").agg(F.sum("n").alias("n"), first).collect()
    ranges = Ranges(bounds, shares, sorted((r["part"], r["n"], ~r["first"]["at"], r["first"]["h"]) for r in stats), most)

    def places(k: pd.Series, x: pd.Series, h: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("part", "host"), ranges.places(k.to_numpy(), x.to_numpy(), h.to_numpy()), strict=True)))

    rows = docs.select(key.alias("key"), h.alias("h"), F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text"), F.pandas_udf(places, "part int, host int")(key, none, h).alias("at"))
    stay, visit = F.struct("at.part", F.lit(False).alias("guest")), F.struct(F.col("at.host").alias("part"), F.lit(True).alias("guest"))
    rows = rows.select("key", "h", "doc_id", "text", F.explode(F.when(F.col("at.host") < 0, F.array(stay)).otherwise(F.array(stay, visit))).alias("at"))
    rows = rows.select("at.part", "at.guest", "key", "h", "doc_id", "text").repartitionById(max(1, len(ranges.heads)), "part")
    rows = rows.sortWithinPartitions("part", "guest", F.desc("key"), F.col("doc_id").isNull(), "h", "text").select("part", "guest", "doc_id", "text")
    return rows.mapInPandas(_follow, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
