"""Stored values listed under the headings and marks of blocks, and texts cut into marked blocks.

What is listed may be merged from several records' JSON, so a run's text and records meet in an Arrow-batched function, a run
at a time; the records that a run has are few, as the store caps them for each block.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of blocks, pointers in lines, words of the lists and their lengths.
HEADING = re.compile(r"^### Block (\d+)\s*$", re.M)
RANGE_AT_START = re.compile(r"^\[Block (\d+)-(\d+)\]", re.M)
RANGE = re.compile(r"\[Block\s+(\d+)\s*-\s*(\d+)\]", re.I)
POINTERS = re.compile(r"\s*\[H#[A-F0-9]{3,8}\](?:\s+[^|\n]+)?|\s*\[HASH_[A-F0-9]{8}\](?:\s+[^|\n]+)?|\s*\[Ref \d+\](?:\s+[^|\n]+)?|\s*\[#\d+\](?:\s+[^|\n]+)?")
FORMS = {"ref": "[Ref {}]", "bracket": "[#{}]", "short": "[H#{}]", "hash": "[HASH_{}]"}
TITLE, MOST_KEYS, LABEL_KEYS = "Extracted Values:", 5, 3
TRACE_KINDS = ("stack_trace", "trace")
HELD = "array<struct<id:string,line_no:int,kind:string,keys:array<string>,value:string,block_no:int>>"


def pointer(id_: str, form: str) -> str:
    return FORMS["short" if form == "hash" and len(id_) <= 3 else form].format(id_)


def _object(value: str | None) -> dict:
    try:
        found = json.loads(value or "")
    except json.JSONDecodeError:
        return {}
    return found if isinstance(found, dict) else {}


def _keys(record: dict) -> list[str]:
    own = record["keys"]
    return sorted(own if own is not None and len(own) else map(str, _object(record["value"])))


def describe(record: dict, form: str) -> str:
    """A pointer and the first five keys; dots where there are more."""
    keys = _keys(record)
    more = "..." if keys and max(len(keys), len(_object(record["value"]))) > MOST_KEYS else ""
    return f"{pointer(record['id'], form)} {', '.join(keys[:MOST_KEYS])}{more}".strip()


def merged(records: list[dict]) -> dict:
    """One record of all objects' keys, a later one's value winning, under the last one's id; the first where none is an object."""
    held: dict = {}
    for r in records:
        held |= _object(r["value"])
    return records[-1] | {"kind": "group", "keys": sorted(map(str, held))[:3], "value": json.dumps(held, ensure_ascii=False, indent=2)} if held and len(records) > 1 else records[0]


def _once(records: list[dict], merge: bool) -> list[dict]:
    each = list({r["id"]: r for r in reversed(records)}.values())[::-1]
    return [merged(each)] if merge and len(each) > 1 else each


def _list(mark: str, records: list[dict], form: str, merge: bool) -> str:
    return "\n".join([mark, TITLE, *(describe(r, form) for r in _once(records, merge))]) if records else mark


def _shares(records: list[dict], n: int) -> list[list[dict]]:
    """Records dealt in order into n shares, the first ones one larger."""
    base, extra = divmod(len(records), n)
    ends = [base * i + min(i, extra) for i in range(n + 1)]
    return [records[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def under_headings(text: str, records: list[dict], bounds: list[tuple[int, int]], form: str = "bracket", merge: bool = True, block_size: int = 0) -> str:
    """List values under ``### Block N``, or, where no heading gets any, under ``[Block lo-hi]`` that opens a line.

    A heading's records are those of its block number, if the records have several; else its share of all, if there are several
    headings; else those of its lines. Bounds are the blocks' lines; beyond them blocks of ``block_size`` lines count. Trace records are left out.
    """
    block_size = block_size or (bounds[0][1] if bounds else 0)
    if not records or not block_size:
        return text
    known = sorted((r for r in records if r["kind"] not in TRACE_KINDS), key=lambda r: (r["block_no"] or 0, r["line_no"]))
    headings = len(HEADING.findall(text))
    shares = _shares(known, headings) if headings > 1 else []
    numbers = {r["block_no"] for r in known if r["block_no"]}

    def of_block(n: int) -> list[dict]:
        if len(numbers) > 1 and n in numbers:
            return [r for r in known if r["block_no"] == n]
        if 1 <= n <= len(shares):
            return shares[n - 1]
        lo, hi = bounds[n - 1] if 1 <= n <= len(bounds) else ((n - 1) * block_size + 1, n * block_size)
        return [r for r in known if lo <= r["line_no"] <= hi]

    starts = {lo: i + 1 for i, (lo, _) in reversed(list(enumerate(bounds)))}
    out = HEADING.sub(lambda m: _list(m[0], of_block(int(m[1])), form, merge), text)
    return out if out != text else RANGE_AT_START.sub(lambda m: _list(m[0], of_block(starts.get(int(m[1]), (int(m[1]) - 1) // block_size + 1)), form, merge), text)


def under_ranges(text: str, records: list[dict], bounds: list[tuple[int, int]], form: str = "bracket", merge: bool = False, block_size: int = 0) -> str:
    """List the values of the lines that each ``[Block lo-hi]`` names under it."""
    return RANGE.sub(lambda m: _list(m[0], [r for r in records if int(m[1]) <= r["line_no"] <= int(m[2])], form, merge), text)


def block_payload(text: str, records: list[dict], bounds: list[tuple[int, int]], form: str = "bracket", merge: bool = False, block_size: int = 300, pointers: bool = True) -> str:
    """The text's lines as blocks under ``[Block lo-hi]``; with pointers, those of a block's values follow its mark and leave its lines."""
    lines = text.split("\n")
    bounds = bounds or [(i + 1, min(i + (block_size or 300), len(lines))) for i in range(0, len(lines), block_size or 300)]
    by_line = {r["line_no"]: r for r in records}  # of records on one line the last
    places, out = sorted(by_line), []
    for lo, hi in bounds:
        held = _once([by_line[p] for p in places[bisect_right(places, lo - 1) : bisect_right(places, hi)]], merge) if pointers else []
        labels = [" ".join([pointer(r["id"], form), *([", ".join(sorted(r["keys"])[:LABEL_KEYS])] if r["keys"] is not None and len(r["keys"]) else [])]) for r in held]
        body = [(POINTERS.sub("", x) if pointers else x).strip() for x in lines[lo - 1 : hi]]
        out.append("\n".join([f"[Block {lo}-{hi}]", *labels]) + "\n" + "\n".join(filter(None, body)))
    return "\n\n".join(out)


def listed(how: Callable, text: Column, held: Column, bounds: Column, **options) -> Column:
    """``how`` (one of the functions above) over columns: a text, its run's records, its blocks' lines; a null text stays null."""

    def run(texts: pd.Series, records: pd.Series, blocks: pd.Series) -> pd.Series:
        rows = zip(texts, records, blocks, strict=True)
        return pd.Series([None if x is None else how(x, list(r) if r is not None else [], [(b["lo"], b["hi"]) for b in b_] if b_ is not None else [], **options) for x, r, b_ in rows], dtype=object)

    return F.pandas_udf(run, "string")(text, held, bounds)


def paste_blocks(texts: DataFrame, records: DataFrame, blocks: DataFrame | None = None, how: Callable = under_headings, **options) -> DataFrame:
    """Texts with values listed by ``how``; records are a value store's, blocks have ``run_id``, ``block_no``, ``lo``, ``hi``.

    Runs without records, or without blocks, are pasted all the same where ``how`` can; null texts stay null.
    """
    held = records.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("line_no", F.length("id").alias("n"), "id", "kind", "keys", "value", "block_no"))).alias("held"))
    held = held.select("run_id", F.transform("held", lambda r: F.struct(*[r[c].alias(c) for c in ("id", "line_no", "kind", "keys", "value", "block_no")])).alias("held"))
    joined = texts.join(held, "run_id", "left")
    if blocks is None:
        joined = joined.withColumn("bounds", F.lit(None).cast("array<struct<lo:int,hi:int>>"))
    else:
        order = F.sort_array(F.collect_list(F.struct("block_no", "lo", "hi")))
        joined = joined.join(blocks.groupBy("run_id").agg(F.transform(order, lambda b: F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"))).alias("bounds")), "run_id", "left")
    return joined.withColumn("text", listed(how, F.col("text"), F.col("held"), F.col("bounds"), **options)).drop("held", "bounds")
