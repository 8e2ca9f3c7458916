"""Pointers to stored values, put into a run's short text where its anchors name lines, blocks or ids; all inside the JVM.

Texts have ``run_id`` and ``text``; records are those of a value store. A run without records, or a null text, comes back as it is.
A run's records are gathered into one array: the store caps them for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

# Anchors, pointers and how many pointers each shows.
LINE_ANCHOR, BLOCK_ANCHOR = r"(?i)\[Lines?\s+(\d+)\s*(?:-\s*(\d+))?\]", r"(?i)\[Block\s+(\d+)\s*-\s*(\d+)\]"
POINTER = r"\[H#([A-F0-9]{3,8})\]|\[HASH_([A-F0-9]{8})\]|\[Ref (\d+)\]|\[#(\d+)\]"
TOKENS = {"ref": "[Ref %s]", "bracket": "[#%s]", "short": "[H#%s]", "hash": "[HASH_%s]"}
PER_LINE_ANCHOR, PER_BLOCK_ANCHOR, IN_FOOTER = 3, 5, 12


def pointer(id_: Column, form: str = "bracket") -> Column:
    """A pointer to an id; short ids of the form ``hash`` read as ``short``."""
    long = F.format_string(TOKENS[form], id_)
    return F.when(F.length(id_) <= 3, F.format_string(TOKENS["short"], id_)).otherwise(long) if form == "hash" else long


def label(id_: Column, keys: Column, form: str = "bracket") -> Column:
    """A pointer and the first three keys it stands for."""
    shown = F.array_join(F.slice(F.array_sort(F.coalesce(keys, F.array().cast("array<string>"))), 1, 3), ", ")
    return F.when(shown == "", pointer(id_, form)).otherwise(F.concat_ws(" ", pointer(id_, form), shown))


HELD = "array<struct<at:int,n:int,id:string,last:boolean,keys:array<string>,label:string>>"


def _arranged(records: Column, form: str) -> Column:
    """A run's records in order of lines: line, id, keys, label, and whether the last of its line."""
    order = F.transform(records, lambda r: F.struct(r["line_no"].cast("int").alias("at"), F.length(r["id"]).alias("n"), r["id"].alias("id"), r["keys"].alias("keys"), label(r["id"], r["keys"], form).alias("label")))
    placed = F.sort_array(order)
    last = lambda i: ~(F.get(placed, i + 1)["at"] == F.get(placed, i)["at"])
    each = F.transform(placed, lambda r, i: F.struct(r["at"].alias("at"), r["n"].alias("n"), r["id"].alias("id"), F.coalesce(last(i), F.lit(True)).alias("last"), r["keys"].alias("keys"), r["label"].alias("label")))
    return F.coalesce(each.cast(HELD), F.array().cast(HELD))


def _gathered(texts: DataFrame, records: DataFrame, form: str) -> DataFrame:
    """Texts with their run's records in order of lines as ``held``."""
    held = records.groupBy("run_id").agg(F.collect_list(F.struct("line_no", "id", "keys")).alias("held"))
    return texts.join(held, "run_id", "left").withColumn("held", _arranged(F.col("held"), form))


def _after_matches(text: Column, pattern: str, suffix) -> Column:
    """A text with something after each match; ``suffix`` gets the match's groups as functions of a group's number."""
    groups = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    parts = F.split(F.regexp_replace(text, pattern, "\ue000"), "\ue000")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(groups(0)), F.concat(p, F.get(groups(0), i), suffix(lambda g: F.get(groups(g), i)))).otherwise(p)), "")


def _within(lo: Column, hi: Column, most: int, one_per_line: bool, glue: str, lead: str) -> Column:
    hits = F.filter("held", lambda r: (r["at"] >= lo) & (r["at"] <= hi) & (r["last"] if one_per_line else F.lit(True)))
    shown = F.slice(F.array_distinct(F.transform(hits, lambda r: r["label"])), 1, most)
    return F.when(F.size(shown) > 0, F.concat(F.lit(lead), F.array_join(shown, glue))).otherwise("")


def _footer() -> Column:
    shown = F.array_join(F.slice(F.array_distinct(F.transform("held", lambda r: r["label"])), 1, IN_FOOTER), " ")
    return F.when(F.size("held") == 0, F.col("text")).otherwise(F.concat(t.sub(F.col("text"), r"\s+$"), F.lit("\n\n[CONTEXT POINTERS]: "), shown))


def _by_lines() -> Column:
    lo, hi = lambda g: g(1).cast("int"), lambda g: F.coalesce(F.nullif(g(2), F.lit("")), g(1)).cast("int")
    out = _after_matches(F.col("text"), LINE_ANCHOR, lambda g: _within(lo(g), hi(g), PER_LINE_ANCHOR, True, " ", " "))
    return F.when(out != F.col("text"), out).otherwise(_footer())


def _by_blocks() -> Column:
    out = _after_matches(F.col("text"), BLOCK_ANCHOR, lambda g: _within(g(1).cast("int"), g(2).cast("int"), PER_BLOCK_ANCHOR, False, "\n", "\n"))
    return F.when(out != F.col("text"), out).otherwise(_by_lines())


def _with_keys() -> Column:
    def keys(g) -> Column:
        id_ = F.concat(*[F.coalesce(g(i), F.lit("")) for i in (1, 2, 3, 4)])
        known = lambda wanted: F.get(F.filter("held", lambda r: r["id"] == wanted), F.lit(0))["keys"]
        shown = F.array_join(F.slice(F.array_sort(F.coalesce(known(id_), known(F.substring(id_, 1, 3)))), 1, 3), ", ")
        return F.when(shown != "", F.concat(F.lit(" ("), shown, F.lit(")"))).otherwise("")

    return _after_matches(F.col("text"), POINTER, keys)


#: ``line_anchor``: after each anchor of lines up to three pointers to what those lines held; a footer of pointers where no anchor has any.
#: ``line_anchor_block``: after each anchor of a block up to five pointers, one a line; by lines where no block has any.
#: ``minimal_keys``: after each pointer the first three keys of its record, found by the id or by its first three characters.
#: ``pointer``: the first twelve pointers at the text's end.
STRATEGIES = {"none": lambda: F.col("text"), "line_anchor": _by_lines, "line_anchor_block": _by_blocks, "minimal_keys": _with_keys, "pointer": _footer}


def _strategy(name: str) -> Column:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy: {name}")
    return STRATEGIES[name]()


def paste(texts: DataFrame, records: DataFrame, strategy: str, form: str = "bracket") -> DataFrame:
    """Texts with pointers by a named strategy; ValueError for a name that is not known."""
    pasted = _strategy(strategy)
    return texts if strategy == "none" else _gathered(texts, records, form).withColumn("text", pasted).drop("held")


def paste_held(texts: DataFrame, records: Column, strategy: str, form: str = "bracket") -> DataFrame:
    """As ``paste``, where each text's records stand beside it as an array."""
    pasted = _strategy(strategy)
    return texts.withColumn("held", _arranged(records, form)).withColumn("text", pasted).drop("held")


def footer(texts: DataFrame, records: DataFrame, form: str = "bracket") -> DataFrame:
    return paste(texts, records, "pointer", form)
