"""Mixing sources to target weights by subset-sum budget fitting.

A source's whole copies come first; what is left of its target is filled from a count of its documents by exact length: a
proportional share of all lengths, the long as the short, but for the last words, which only short documents fit. A
bounded-knapsack dynamic program over the lengths then closes what remains, taking further documents and handing back some of
those taken, so that the source's total is the largest that does not exceed its target. Within a length, seeded hashes say
which documents are taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, word_count, written

MOST_COPIES, SEED = 3, 7
#: Words that the dynamic program's tables span at first; they grow as long as a better total may lie beyond.
FIRST_SPAN = 4096


def targets(sizes: dict, weights: dict | None = None, most: int = MOST_COPIES) -> dict:
    """Words that each source shall give. weights: by default 1, 2, 3, repeating, in the sources' code point order, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = weights or {s: 1 + i % 3 for i, s in enumerate(order)}
    fixed: dict = {}
    while True:
        free = [s for s in order if s not in fixed]
        left, shares = sum(sizes.values()) - sum(fixed.values()), sum(weights[s] for s in free)
        goal = {s: left * weights[s] / shares for s in free}
        above = {s: float(most * sizes[s]) for s in free if goal[s] > most * sizes[s]}
        if not above:
            return fixed | goal
        fixed |= above


class Sums:
    """Sums up to ``span`` that counted lengths reach, and the step that first reached each."""

    def __init__(self, span: int):
        self.reach, self.step, self.steps = np.zeros(span + 1, bool), np.zeros(span + 1, np.int32), [(0, 0, 0)]
        self.reach[0] = True

    def add(self, i: int, length: int, count: int) -> None:
        """Up to ``count`` documents of a length, in halving lots."""
        n, lot = min(count, (len(self.reach) - 1) // length), 1
        while n > 0:
            lot = min(lot, n)
            self.steps.append((i, lot, length * lot))
            new = np.flatnonzero(self.reach[: len(self.reach) - length * lot] & ~self.reach[length * lot :]) + length * lot
            self.reach[new], self.step[new] = True, len(self.steps) - 1
            n, lot = n - lot, lot * 2

    def taken(self, total: int, out: np.ndarray) -> None:
        while total:
            i, lot, words = self.steps[self.step[total]]
            out[i] += lot
            total -= words


def knapsack(lengths: np.ndarray, free: np.ndarray, held: np.ndarray, gap: int, first: int = FIRST_SPAN) -> np.ndarray:
    """By how much the number taken of each length changes so that the sum grows most without growing by more than ``gap``.

    ``free`` more documents of a length can be taken, ``held`` can be handed back. Both are tabled up to a span of words. A change
    of the best kind, its takings and returns so ordered that its partial sums stay within two of the longest lengths, needs no
    partial sum twice; so a span of twice the longest length squared holds one, and the result is the best there is. Nearly
    always the gap closes within the first span.
    """
    unit = int(np.gcd.reduce(lengths[(free + held) > 0])) if ((free + held) > 0).any() else 1
    lengths, gap = lengths // unit, gap // unit
    used = np.flatnonzero((free + held) > 0)
    if not gap or not len(used):
        return np.zeros(len(lengths), np.int64)
    whole = int(max((lengths * free).sum(), (lengths * held).sum()))
    most, span = min(whole, 2 * int(lengths[used].max()) ** 2), first
    while True:
        span = min(max(span, 2 * gap), max(most, gap))
        more, back = Sums(span), Sums(span)
        for i in used[np.argsort(lengths[used], kind="stable")].tolist():
            if lengths[i] > span:
                break
            more.add(i, int(lengths[i]), int(free[i]))
            back.add(i, int(lengths[i]), int(held[i]))
            if (more.reach[gap:] & back.reach[: span + 1 - gap]).any():
                break
        best = next((g for g in range(gap, 0, -1) if (more.reach[g:] & back.reach[: span + 1 - g]).any()), 0)
        if best == gap or span >= most:
            out, less = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            given = int(np.flatnonzero(more.reach[best:] & back.reach[: span + 1 - best])[0])
            more.taken(given + best, out)
            back.taken(given, less)
            return out - less
        span *= 16


def fit(lengths: np.ndarray, counts: np.ndarray, target: float, most: int = MOST_COPIES, first: int = FIRST_SPAN) -> tuple[int, np.ndarray]:
    """Whole copies of every document, and how many documents of each length are taken once more: the most words within the target."""
    total = int((lengths * counts).sum())
    if not total:
        return 0, np.zeros(len(counts), np.int64)
    copies = min(most, int(target // total))
    left = 0 if copies == most else int(target - copies * total)
    # shares are rounded down as they add up from the longest: every stretch of lengths gives its part, and the sum stays within what is
    # left; each turn takes a document at least
    order, more = np.argsort(-lengths, kind="stable"), np.zeros(len(counts), np.int64)
    while (fits := np.where((lengths > 0) & (lengths <= left), counts - more, 0)).any():
        words = int((fits * lengths).sum())
        upto = np.cumsum(fits[order]).astype(object) * min(left, words) // words
        new = np.zeros(len(counts), np.int64)
        new[order] = np.diff(upto, prepend=0)
        more, left = more + new, left - int((new * lengths).sum())
    real = lengths > 0
    more[real] += knapsack(lengths[real], (counts - more)[real], more[real], left, first)
    return copies, more


def _copies(rows: DataFrame, weights: dict | None, doc_id: str, text: str, source: str, seed: int, most: int, wide: bool) -> tuple[DataFrame, dict[str, str]]:
    """Rows with the plan's columns, and the names that these have."""
    name = dict(zip(["id", "s", "k", "size", "h", "cell", "source_size", "target", "copies", "room", "count"], free_names(rows, 11), strict=True))
    n = lambda k: F.col(name[k])
    h = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    keyed = rows.select(*(["*"] if wide else []), F.col(doc_id).alias(name["id"]), F.col(source).cast("string").alias(name["s"]), word_count(F.col(text)).alias(name["size"]), h.alias(name["h"]))
    # a key without nulls, so that one deal serves the join and the window after it
    keyed = keyed.withColumn(name["k"], F.when(n("s").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), n("s"))))
    keyed = keyed.withColumn(name["cell"], F.shiftrightunsigned(n("h"), 56).cast("int"))
    if not wide:
        keyed = written(keyed, "mix")
    key = [name["k"], name["size"], name["cell"]]
    cells = written(keyed.groupBy(*key, name["s"]).agg(F.count("*").alias(name["count"])), "cells")
    sizes = {r[0]: int(r[1] or 0) for r in cells.groupBy(name["s"]).agg(F.sum(n("size") * n("count"))).collect()}
    goals = targets(sizes, weights, most) if sizes else {}

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        k = pdf[name["k"]].iat[0]
        s = None if k == "-" else k[1:]
        pdf = pdf.sort_values(name["size"])
        copies, more = fit(pdf[name["size"]].to_numpy(), pdf[name["count"]].to_numpy(), goals[s], most)
        return pd.DataFrame({"s": [k] * len(pdf), "size": pdf[name["size"]], "source_size": sizes[s], "target": goals[s], "copies": copies, "more": more})

    lengths = cells.groupBy(*key[:2]).agg(F.sum(n("count")).alias(name["count"]))
    plans = lengths.groupBy(name["k"]).applyInPandas(plan, "s string, size long, source_size long, target double, copies int, more long")
    same = lambda a, b, pairs: F.expr(" AND ".join(f"{a}.`{x}` = {b}.`{y}`" for x, y in pairs))
    upto = F.sum(n("count")).over(Window.partitionBy(*key[:2]).orderBy(key[2]).rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("upto", upto).alias("c").join(plans.alias("p"), same("c", "p", [(name["k"], "s"), (name["size"], "size")]))
    room = F.col("more") - F.col("upto") + n("count")
    cells = cells.select(*[F.col(f"c.{k}").alias(f"{k}_") for k in key], *[F.col(f"p.{k}").alias(name[k]) for k in ("source_size", "target", "copies")], room.alias(name["room"]), n("count"))
    joined = keyed.alias("r").join(cells.alias("c"), same("r", "c", [(k, f"{k}_") for k in key])).drop(*[f"{k}_" for k in key])
    cut = (n("room") > 0) & (n("room") < n("count"))
    turn = F.row_number().over(Window.partitionBy(*key, F.when(~cut, n("h"))).orderBy(name["h"]))
    more = F.when(cut, turn <= n("room")).otherwise(n("room") > 0).cast("int")
    return joined.withColumn(name["copies"], n("copies") + more), name


def mix(docs: DataFrame, weights: dict | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, most: int = MOST_COPIES) -> DataFrame:
    """How often the mix takes each document; one row per row of ``docs``.

    Returns ``doc_id``, ``source``, ``size`` (words), ``source_size``, ``target`` (its source's), ``copies`` and ``taken``
    (``copies * size``). A source's taken words are the most that do not exceed its target. Null and empty texts have size 0 and
    nothing is taken of them; a null source is a source of its own, the last. Equal documents are told apart by nothing, so which of
    a document's repeated rows is taken is left open, how many is not. An empty table gives no rows. Hashes follow seed, doc_id and text
    alone, so reruns agree. The driver gets one row per source; a task gets one source's distinct lengths, or a 256th of the
    documents of one source and length.
    """
    found, name = _copies(docs, weights, doc_id, text, source, seed, most, wide=False)
    out = found.select(F.col(name["id"]).alias("doc_id"), F.col(name["s"]).alias("source"), *[F.col(name[k]).alias(k) for k in ("size", "source_size", "target", "copies")])
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: dict | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix`` takes it, all columns kept whatever their names; rows taken no times go.

    Decisions are per row: rows without doc_id and repeated rows are taken as they were counted. Rows without words go. An empty table
    gives no rows.
    """
    found, name = _copies(docs, weights, doc_id, text, source, seed, most, wide=True)
    times, turn = F.col(name["copies"]), free_names(found, 1)[0]
    found = found.where((F.col(name["size"]) > 0) & (times > 0)).withColumn(turn, F.explode(F.sequence(F.lit(1), times)))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
