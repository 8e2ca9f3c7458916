"""The older extractor: lines with bulky values give way to pointers with a summary, kinds by kinds as asked for; and masks of dicts.

What a line holds is found by an Arrow-batched function of the line alone; how often lines of its form occur, what is kept, ids and
texts are column expressions and one window, so a run's lines need not meet in one task's memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import values

# Words that mark metrics, pairs and keys, lengths.
METRIC_WORDS = r"(?i)\b(loss|accuracy|epoch|batch|learning_rate|lr|memory|cuda|gpu|gradient|pass_rate|f1|bleu|rouge|perplexity|throughput|latency|checkpoint|tokenizer|embedding|tensor|dtype|device|optimizer)\b"
PAIR = re.compile(r"(?<![\w.])([a-zA-Z_][\w.]*)=([^\s,;|]+(?:\([^\)]*\))?)")
METRIC = re.compile(r"-?\d+(?:\.\d+)?|[A-Za-z_]\w*")
COLON_KEY, EQUAL_KEY = r"['\"]?([a-zA-Z_]\w*)['\"]?\s*:", r"['\"]?([a-zA-Z_]\w*)['\"]?\s*="
NO_PAIRS = ("pip install", "==", "http://", "https://")
LEAST_DICT, LEAST_MASKED, MOST_STORED, MOST_SUMMARY, MOST_RAW, HEAVY = 20, 12, 4000, 200, 2000, 0.6
KINDS = ("tensor", "entropy", "dict", "kv")
FOUND = "struct<line:string,kind:string,summary:string,stored:string>"


def first_dict(line: str) -> tuple[int, int] | None:
    """Where the first balanced braces stand; braces in quotes count too."""
    start, depth = line.find("{"), 0
    for m in re.finditer(r"[{}]", line[start:]) if start >= 0 else ():
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return start, start + m.end()
    return None


def _tensors(line: str) -> Iterator[tuple[str, str, str]]:
    shown = [values.summarise_tensor(m) for m in re.finditer(values.TENSOR, line)]
    if shown:
        left = re.sub(values.TENSOR, values.summarise_tensor, line)
        yield left, "; ".join(shown), left


def _entropy(line: str) -> Iterator[tuple[str, str, None]]:
    left, n = values.scrubbed(line)
    if n:
        yield left, f"{n} high-entropy token(s)", None


def _dicts(line: str) -> Iterator[tuple[str, str, str]]:
    span = first_dict(line)
    if span and span[1] - span[0] >= LEAST_DICT:
        text = line[span[0] : span[1]]
        keys = re.findall(COLON_KEY, text) or re.findall(EQUAL_KEY, text)
        yield f"{line[: span[0]]}[DICT_EXTRACTED]{line[span[1] :]}", f"dict block ({len(text)} chars, keys: {', '.join(keys[:8]) or 'nested'})", text


def _pairs(line: str) -> Iterator[tuple[str, str, None]]:
    found = [] if any(x in line for x in NO_PAIRS) else [p for p in PAIR.findall(line) if METRIC.fullmatch(p[1])]
    if len(found) > 1:
        left = line
        for k, v in found:
            left = left.replace(f"{k}={v}", f"{k}=<{k}>", 1)
        yield left, f"kv pairs ({len(found)}): {', '.join(k for k, _ in found[:12])}", None


FINDERS = dict(zip(KINDS, (_tensors, _entropy, _dicts, _pairs), strict=True))


def shorten(line: str, kinds: tuple[str, ...] = KINDS) -> tuple[str, str | None, str | None, str | None]:
    """A line without its bulky values, their kinds, a summary, and what to store; each kind sees what those before it left."""
    left, names, told, stored = line, [], [], []
    for kind in KINDS:
        for left, summary, part in FINDERS[kind](left) if kind in kinds else ():
            names.append(kind)
            told.append(summary)
            stored.append(line if part is None else part)
    return (left, "+".join(sorted(names)), "; ".join(told)[:MOST_SUMMARY], "\n---\n".join(stored)) if names else (line, None, None, None)


def is_telling(line: Column, n_alike: Column, rare: bool = True, metrics: bool = True) -> Column:
    """Whether a line is kept whole: it speaks of metrics, or no other has its form."""
    return (line.rlike(t.rx(METRIC_WORDS)) if metrics else F.lit(False)) | ((n_alike <= 1) if rare else F.lit(False))


def signature_counts(lines: DataFrame) -> DataFrame:
    """How many lines of a run have each form."""
    return lines.groupBy("run_id", t.signature(F.col("line")).alias("signature")).agg(F.count("*").alias("n"))


def summarise(lines: DataFrame, kinds: tuple[str, ...] = KINDS, mode: str = "inplace", least: int = 80, rare: bool = False, metrics: bool = False) -> DataFrame:
    """``run_id``, ``pos``, ``line`` and, where a line gave way to a pointer, ``id``, ``kind``, ``summary``, ``value`` and ``size``.

    Lines of ``least`` characters or more, or of which less than six tenths are left, give way to ``[HASH_id] summary``, with mode
    ``strip`` to their beginning; other lines with values stay without them. Null lines count as empty.
    """
    find = F.pandas_udf(lambda xs: pd.DataFrame([shorten(x, kinds) for x in xs], columns=["line", "kind", "summary", "stored"]), FOUND)
    line = F.regexp_replace(F.coalesce("line", F.lit("")), r"\n+$", "")
    alike = F.count("*").over(Window.partitionBy("run_id", t.signature(F.col("line"))))
    found = lines.select("run_id", "pos", line.alias("line")).withColumn("alike", alike).withColumn("x", find("line"))
    whole = F.col("x.kind").isNull() | is_telling(F.col("line"), F.col("alike"), rare, metrics)
    heavy = (F.length("line") >= least) | (F.length("x.line") < F.length("line") * HEAVY)
    out = ~whole & heavy
    id_ = F.upper(F.substring(F.sha2("x.stored", 256), 1, 8))
    shown = t.stub(F.col("line"), F.col("pos")) if mode == "strip" else F.concat(F.lit("[HASH_"), id_, F.lit("] "), F.col("x.summary"))
    text = F.when(out, shown).when(whole, F.col("line")).otherwise(F.col("x.line"))
    held = [F.when(out, c).alias(k) for k, c in (("id", id_), ("kind", F.col("x.kind")), ("summary", F.col("x.summary")), ("value", F.substring("x.stored", 1, MOST_STORED)), ("size", F.length("line")))]
    return found.select("run_id", "pos", text.alias("line"), *held)


def appendix(records: DataFrame) -> DataFrame:
    """Each run's records, each id once, as one text: pointers, kinds, lines, keys and beginnings of values. ``keys`` may be missing."""
    keys = F.array_join("keys", ", ") if "keys" in records.columns else F.lit("")
    id_ = F.when(F.length("id") <= 3, F.format_string("[H#%s]", "id")).otherwise(F.format_string("[HASH_%s]", "id"))
    data = F.substring(F.replace(F.coalesce("value", F.lit("")), F.lit("\n"), F.lit(" ")), 1, 240)
    some = lambda name, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"\n  {name}: "), x)).otherwise("")
    text = F.concat(F.lit("- "), id_, F.format_string(" (%s, line %d)", "kind", "line_no"), some("keys", keys), some("data", data))
    first = F.row_number().over(Window.partitionBy("run_id", "id").orderBy("line_no"))
    each = records.select("run_id", "line_no", text.alias("text"), first.alias("rank")).where("rank = 1")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return each.groupBy("run_id").agg(F.concat(F.lit("---\n[AVAILABLE CONTEXT HASHES]:\n"), F.array_join(rows, "\n")).alias("text"))


def mask_dict(line: str) -> tuple[str, list[str] | None, str | None]:
    """A line with its first balanced braces masked, their top keys, and their text; short ones stay."""
    span = first_dict(line)
    if not span or span[1] - span[0] < LEAST_MASKED:
        return line, None, None
    text = line[span[0] : span[1]]
    try:
        held = values.literal(text)
        keys = list(held) if isinstance(held, dict) else re.findall(COLON_KEY, text)
    except (ValueError, RecursionError):
        keys = re.findall(COLON_KEY, text)
    return f"{line[: span[0]]}<MASK>{line[span[1] :]}", keys[:16], text[:MOST_RAW]


def mask_dicts(lines: DataFrame) -> DataFrame:
    """``run_id``, ``pos``, ``line`` with dicts masked, and ``keys`` and ``raw`` where there was one. Null lines count as empty."""
    run = F.pandas_udf(lambda xs: pd.DataFrame([mask_dict(x) for x in xs], columns=["line", "keys", "raw"]), "struct<line:string,keys:array<string>,raw:string>")
    return lines.select("run_id", "pos", run(F.coalesce("line", F.lit(""))).alias("x")).select("run_id", "pos", "x.line", "x.keys", "x.raw")


def dict_appendix(masked: DataFrame) -> DataFrame:
    """Each run's masked dicts as one text: their lines, counted from 1, and keys."""
    keys = F.when(F.size("keys") > 0, F.array_join("keys", ", ")).otherwise("?")
    each = masked.where("raw IS NOT NULL").select("run_id", F.struct("pos", F.format_string("- line %d: keys=[%s]", F.col("pos") + 1, keys).alias("text")).alias("x"))
    rows = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["text"])
    return each.groupBy("run_id").agg(F.concat(F.lit("---\n[EXTRACTED DICT PARAMS (Lark)]:\n"), F.array_join(rows, "\n")).alias("text"))
