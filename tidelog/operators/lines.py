"""Operators over ordered lines: tables with ``run_id``, ``pos`` and ``line``. All windows are bounded by a run."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as t

#: Where a text breaks into lines.
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
SCHEMA = "run_id string, pos int, line string"


def _run() -> WindowSpec:
    return Window.partitionBy("run_id").orderBy("pos")


def split_lines(runs: DataFrame, run_id: str, text: str) -> DataFrame:
    """Non-blank lines of each text, numbered from 0."""
    each = runs.select(F.col(run_id).cast("string").alias("run_id"), F.posexplode(F.filter(F.split(F.col(text), BREAK), lambda x: ~t.is_blank(x))).alias("pos", "line"))
    return each


def renumber(lines: DataFrame) -> DataFrame:
    return lines.withColumn("pos", F.row_number().over(_run()) - 1)


def strip_header(lines: DataFrame) -> DataFrame:
    """Drop what stands before a run's first timed line; runs without one stay whole."""
    first = F.min(F.when(F.col("line").rlike(t.RUNNER), F.col("pos"))).over(Window.partitionBy("run_id"))
    return lines.withColumn("first", F.coalesce(first, F.lit(0))).where("pos >= first").drop("first")


def raw_lines(runs: DataFrame, run_id: str, text: str, most: int | None = None) -> DataFrame:
    """A runner's log without its header, and its lines without the runner's marks; blank lines go. most: only so many lines of each run."""
    lines = renumber(drop_blank(change(strip_header(split_lines(runs, run_id, text)), t.clean_runner_line)))
    return lines if most is None else lines.where(F.col("pos") < most)


def change(lines: DataFrame, *steps) -> DataFrame:
    x = F.col("line")
    for step in steps:
        x = step(x)
    return lines.withColumn("line", x)


def drop_blank(lines: DataFrame) -> DataFrame:
    return lines.where(~t.is_blank(F.col("line")))


def collapse_progress(lines: DataFrame) -> DataFrame:
    """Of progress lines that follow one another only the first stays, as a tag."""
    busy = t.is_progress(F.col("line"))
    marked = lines.withColumn("busy", busy).withColumn("was", F.coalesce(F.lag("busy").over(_run()), F.lit(False)))
    return marked.where(~(F.col("busy") & F.col("was"))).select("run_id", "pos", F.when(F.col("busy"), F.lit(t.PROGRESS_TAG)).otherwise(F.col("line")).alias("line"))


def collapse_blank(lines: DataFrame) -> DataFrame:
    marked = lines.withColumn("blank", t.is_blank(F.col("line"))).withColumn("was", F.coalesce(F.lag("blank").over(_run()), F.lit(False)))
    return marked.where(~(F.col("blank") & F.col("was"))).select("run_id", "pos", t.sub(F.col("line"), r"\s+$").alias("line"))


def soft_clean(lines: DataFrame, workspace: str = "", site_dirs: tuple[str, ...] = (), delete_entropy: bool = False) -> DataFrame:
    """First cleaning: control codes, progress, time stamps, paths, blobs, random words, decoration, hexadecimal, boxes, blanks."""
    lines = drop_blank(change(lines, t.strip_ansi, t.tag_progress, t.strip))
    lines = drop_blank(change(collapse_progress(lines), t.strip_temporal))
    lines = change(lines, lambda x: t.prune_paths(x, workspace, site_dirs), t.truncate_blobs, lambda x: t.scrub_entropy(x, delete_entropy))
    lines = change(lines.where(~t.is_art(F.col("line"))), t.collapse_decoration, t.mask_gc, t.strip_hex, t.strip_box)
    return collapse_blank(lines)


def green(lines: DataFrame) -> DataFrame:
    """Safe cleaning: progress blocks, control codes, blank lines, boxes."""
    return change(drop_blank(change(collapse_progress(lines), t.strip_ansi, t.strip)), lambda x: t.sub(x, t.BOX))


def mid_clean(lines: DataFrame) -> DataFrame:
    return change(lines, t.mid_clean)


def sanitize(lines: DataFrame) -> DataFrame:
    return drop_blank(change(lines, t.sanitize))


def run_lengths(lines: DataFrame) -> DataFrame:
    """Lines that follow one another and are equal but for white space, as one row: ``first``, ``n``, ``line`` (``[xN]`` before repeats)."""
    same = lines.withColumn("key", t.one_space(F.col("line")))
    opens = F.coalesce((F.col("key") != F.lag("key").over(_run())).cast("int"), F.lit(1))
    islands = same.withColumn("opens", opens).withColumn("island", F.sum("opens").over(_run()))
    out = islands.groupBy("run_id", "island").agg(F.min("pos").alias("first"), F.count("*").alias("n"), F.min_by("line", "pos").alias("line"))
    shown = F.when(F.col("n") > 1, F.concat(F.lit("[x"), F.col("n").cast("string"), F.lit("] "), t.strip(F.col("line")))).otherwise(F.col("line"))
    return out.select("run_id", "first", "n", shown.alias("line"))


def _lasting(same: np.ndarray) -> np.ndarray:
    """For each place how many trues follow one another from there."""
    at = np.arange(len(same))
    stop = np.minimum.accumulate(np.where(same, len(same), at)[::-1])[::-1]
    return stop - at


def _timeline(pdf: pd.DataFrame, longest: int) -> pd.DataFrame:
    """What repeats from each line on is known beforehand: for equal lines and for each period of clusters; a walk then takes the first that holds."""
    pdf = pdf.sort_values("pos")
    line, pos, key, cluster = pdf["line"].tolist(), pdf["pos"].tolist(), pdf["key"].to_numpy(object), pdf["cluster"].to_numpy(object)
    size = len(line)
    again = lambda x, by: np.r_[x[:-by] == x[by:], np.zeros(min(by, size), bool)].astype(bool) if by < size else np.zeros(size, bool)
    equal = _lasting(again(key, 1)) + 1
    periods = {by: _lasting(again(cluster, by) & (cluster != "")) // by + 1 for by in range(2, longest + 1)}
    at, out = 0, []
    while at < size:
        by = 1 if equal[at] > 1 else next((by for by, times in periods.items() if times[at] > 1), 1)
        n = int(equal[at] if by == 1 else periods[by][at])
        whole = [f"[x{n}] Seq:", *(f"  {x.strip()}" for x in line[at : at + by])] if by > 1 else [f"[x{n}] {line[at].strip()}" if n > 1 else line[at]]
        out.append((pdf["run_id"].iat[0], pos[at], n, "\n".join(whole)))
        at += n * by
    return pd.DataFrame(out, columns=["run_id", "first", "n", "line"])


def timeline(lines: DataFrame, longest: int = 4) -> DataFrame:
    """Repeats of one line, then of sequences of 2 to ``longest`` lines of like clusters, as one row each.

    Greedy from a run's start, so a run's lines meet in one task; a run is one execution's log.
    """
    keyed = lines.select("run_id", "pos", "line", t.one_space(F.col("line")).alias("key"), F.when(~t.is_blank(F.col("line")), t.one_space(t.cluster_mask(F.col("line")))).otherwise("").alias("cluster"))
    return keyed.groupBy("run_id").applyInPandas(lambda pdf: _timeline(pdf, longest), "run_id string, first int, n long, line string")


# How warnings look.
WARN_AT = r"^([^\s:]+):(\d+):\s*(\w*Warning):\s*(.*)$"
WARN_LOG = r"(?i)^(?:\[)?(WARNING|WARN|WARNI?NG)(?:\])?[:\s-]*(?:\[[^\]]+\]\s*)?(.*)$"
WARN_TYPED = r"(?i)\b(UserWarning|FutureWarning|DeprecationWarning|PendingDeprecationWarning|SyntaxWarning|ResourceWarning|ImportWarning|XMLParsedAsHTMLWarning)\b[:\s]*(.{0,300})"


def _cut(x: Column, size: int) -> Column:
    return F.when(F.length(x) > size, F.concat(F.substring(x, 1, size - 3), F.lit("..."))).otherwise(x)


def parse_warnings(lines: DataFrame, others: list[str] | None = None) -> DataFrame:
    """``lines`` with ``kind``, ``file``, ``at``, ``message``; ``kind`` is null where a line is no warning."""
    bare, get = t.strip(F.col("line")), lambda x, p, i: F.regexp_extract(x, t.rx(p), i)
    placed, logged = bare.rlike(t.rx(WARN_AT)), bare.rlike(t.rx(WARN_LOG)) & (t.strip(get(bare, WARN_LOG, 2)) != "")
    typed = F.col("line").rlike(t.rx(WARN_TYPED))
    kind = F.when(placed, get(bare, WARN_AT, 3)).when(logged, F.lit("WARNING")).when(typed, get(F.col("line"), WARN_TYPED, 1))
    message = F.when(placed, _cut(t.strip(get(bare, WARN_AT, 4)), 200)).when(logged, _cut(t.strip(get(bare, WARN_LOG, 2)), 120)).when(typed, _cut(t.strip(get(F.col("line"), WARN_TYPED, 2)), 120))
    return lines.select("run_id", "pos", "line", kind.alias("kind"), F.when(placed, get(bare, WARN_AT, 1)).otherwise("").alias("file"), F.when(placed, get(bare, WARN_AT, 2).cast("int")).alias("at"), message.alias("message"), *(others or []))


def _shown_warning() -> Column:
    text = F.when((F.col("file") != "") & F.col("at").isNotNull(), F.format_string("%s @ %s:%d : %s", "kind", "file", "at", "message")).otherwise(F.concat_ws(": ", "kind", "message"))
    return t.strip(F.when(F.col("n") > 1, F.concat(F.lit("[x"), F.col("n").cast("string"), F.lit("] "), text)).otherwise(text))


def group_warnings(lines: DataFrame) -> DataFrame:
    """Warnings by kind, place and message's beginning: ``n``, ``first``, ``line`` as shown."""
    found = parse_warnings(lines).where("kind IS NOT NULL").withColumn("head", F.substring("message", 1, 80))
    out = found.groupBy("run_id", "kind", "file", "at", "head").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.min_by("message", "pos").alias("message"))
    return out.select("run_id", "first", "n", _shown_warning().alias("line"))


def extract_warnings(lines: DataFrame) -> DataFrame:
    """All other lines in order, then the grouped warnings in order of their first. One pass: of each group its first row stays; columns besides the line's are kept."""
    others = [c for c in lines.columns if c not in ("run_id", "pos", "line")]
    found = parse_warnings(lines, others).withColumn("head", F.substring("message", 1, 80))
    group = Window.partitionBy("run_id", "kind", "file", "at", "head", *([F.when(F.col("kind").isNull(), F.col("pos"))]))
    counted = found.withColumns({"n": F.count("*").over(group), "first": F.min("pos").over(group)}).where("kind IS NULL OR pos = first")
    shown = F.when(F.col("kind").isNull(), F.col("line")).otherwise(_shown_warning())
    order = Window.partitionBy("run_id").orderBy(F.col("kind").isNotNull(), "pos")
    return counted.select("run_id", (F.row_number().over(order) - 1).alias("pos"), shown.alias("line"), *others)


def error_lines(lines: DataFrame) -> DataFrame:
    """Lines with fault words, and tracebacks to their end; each line once, where it first stands."""
    low = F.lower("line")
    opens = F.contains(low, F.lit("traceback (most recent call last):"))
    ends = ~t.is_blank(F.col("line")) & ~F.col("line").startswith(" ") & ~F.contains(low, F.lit("traceback"))
    word = low.rlike("traceback|error:|exception:|failed|critical|pass_rate|syntax error")
    before = _run().rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.select("*", opens.alias("opens"), ends.alias("ends"), word.alias("word"))
    marked = marked.withColumn("open_at", F.max(F.when(F.col("opens"), F.col("pos"))).over(_run())).withColumn("end_at", F.max(F.when(F.col("ends"), F.col("pos"))).over(before))
    hit = marked.where(F.col("word") | (F.col("open_at").isNotNull() & F.coalesce(F.col("end_at") < F.col("open_at"), F.lit(True))))
    return hit.groupBy("run_id", "line").agg(F.min("pos").alias("pos")).select("run_id", "pos", "line")


def block_of_lines(lines: DataFrame, size: int) -> DataFrame:
    """Blocks of ``size`` lines as ``block_no``, ``lo``, ``hi``, counted from 1."""
    return lines.groupBy("run_id", F.floor(F.col("pos") / size).cast("int").alias("block_no")).agg((F.min("pos") + 1).alias("lo"), (F.max("pos") + 1).alias("hi"))


def _blocks(runs: DataFrame, start: Column, step) -> DataFrame:
    """Blocks of runs whose ``values`` are in order of lines. ``step`` says from a state, a place and a value: the new state, and whether a block begins.

    The fold keeps only the places where blocks begin, so it is linear in a run's lines.
    """
    first = F.struct(start.alias("state"), F.expr("cast(array() as array<int>)").alias("cuts"))

    def fold(a: Column, x: Column) -> Column:
        state, cuts = step(a["state"], x["i"], x["value"])
        return F.struct(state.alias("state"), F.when(cuts, F.array_append(a["cuts"], x["i"])).otherwise(a["cuts"]).alias("cuts"))

    placed = F.transform("values", lambda v, i: F.struct(i.alias("i"), v.alias("value")))
    starts = runs.select("run_id", F.size("values").alias("n"), F.aggregate(placed, first, fold, lambda a: F.concat(F.array(F.lit(0)), a["cuts"])).alias("starts"))
    each = F.transform("starts", lambda at, k: F.struct(k.alias("block_no"), (at + 1).alias("lo"), F.coalesce(F.get("starts", k + 1), F.col("n")).alias("hi")))
    return starts.select("run_id", F.inline(each))


def size_cuts(sizes: list[int], budget: int) -> Iterator[int]:
    """The places, but 0, where blocks of up to ``budget`` characters begin."""
    used = -1
    for i, n in enumerate(sizes):
        used += n + 1
        if used > budget and i:
            yield i
            used = n


def blocks_by_size(lines: DataFrame, budget: int = 15_000) -> DataFrame:
    """Greedy blocks of up to ``budget`` characters, line ends included; a longer line is a block of its own. Only the lines' lengths are folded, in the JVM."""
    runs = lines.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.length("line").alias("n")))), lambda x: x["n"]).alias("values"))

    def step(used: Column, i: Column, n: Column) -> tuple[Column, Column]:
        cuts = (used + n + 1 > budget) & (i > 0)
        return F.when(cuts, n).otherwise(used + n + 1), cuts

    return _blocks(runs, F.lit(-1), step)


def line_time(x: Column, year: int = 2026) -> Column:
    """Seconds a line's stamp stands for: since the start (``12.3s``), or since 1970 for dates; those without a year are of ``year``."""
    month = F.to_timestamp(F.try_to_timestamp(F.concat(F.regexp_extract(x, r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})", 1), F.lit(f" {year}")), F.lit("MMM d HH:mm:ss yyyy")))
    iso = F.replace(F.regexp_extract(x, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?)", 1), F.lit("T"), F.lit(" ")).try_cast("timestamp")
    return F.coalesce(t.elapsed_seconds(x), month.cast("double"), iso.cast("double"))


def blocks_by_time(lines: DataFrame, seconds: float = 3000) -> DataFrame:
    """Blocks that close with the line ``seconds`` or more after their start; lines without a time have that before them.

    The next block starts at that line's time, so a run's times, and nothing else of it, are folded in order, in the JVM.
    """
    last = F.last(line_time(F.col("line")), ignorenulls=True).over(_run())
    timed = lines.select("run_id", "pos", last.alias("at"))
    first = F.min_by("at", F.when(F.col("at").isNotNull(), F.col("pos"))).over(Window.partitionBy("run_id"))
    timed = timed.select("run_id", "pos", F.coalesce(F.col("at") - first, F.lit(0.0)).alias("at"))
    runs = timed.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "at"))), lambda x: x["at"]).alias("values"))
    # a line that closes a block is the block's last: the line after it begins the next
    start = F.struct(F.get("values", F.lit(0)).alias("since"), F.lit(False).alias("closed"))

    def step(a: Column, i: Column, at: Column) -> tuple[Column, Column]:
        closes = at - a["since"] >= seconds
        return F.struct(F.when(closes, at).otherwise(a["since"]).alias("since"), closes.alias("closed")), a["closed"]

    return _blocks(runs, start, step)


def route(lines: DataFrame) -> DataFrame:
    """Each run's characters and route by size."""
    from .routing import route as by_size

    return lines.groupBy("run_id").agg(F.sum(F.length("line")).alias("chars")).withColumn("route", by_size(F.col("chars")))


class _Kept:
    """Kept lines' words, found by their first words in order: of two sets as like as ``least``, some of these are shared."""

    def __init__(self, least: float):
        self.least, self.by_word, self.sets = least, {}, []

    def _first(self, words: frozenset) -> list[str]:
        return sorted(words)[: len(words) - math.ceil(self.least * len(words) - 1e-9) + 1] or [""]

    def add(self, words: frozenset) -> None:
        for w in self._first(words):
            self.by_word.setdefault(w, []).append(len(self.sets))
        self.sets.append(words)

    def near(self, words: frozenset) -> Iterator[frozenset]:
        for i in {i for w in self._first(words) for i in self.by_word.get(w, ())}:
            if self.least * len(words) <= len(self.sets[i]) + 1e-9 and self.least * len(self.sets[i]) <= len(words) + 1e-9:
                yield self.sets[i]


def _alike(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def _fuzzy(pdf: pd.DataFrame, least: float, window: int | None) -> pd.DataFrame:
    pdf, out = pdf.sort_values("pos"), []
    kept, recent = _Kept(least), deque(maxlen=window)
    for i, (words, guarded) in enumerate(zip(map(frozenset, pdf["words"]), pdf["guarded"], strict=True)):
        if guarded or not any(_alike(words, x) >= least for x in (kept.near(words) if window is None else recent)):
            out.append(i)
            if window is None:
                kept.add(words)
            else:
                recent.append(words)
    return pdf.iloc[out][["run_id", "pos", "line"]]


def fuzzy_dedup(lines: DataFrame, least: float = 0.85, window: int | None = 3) -> DataFrame:
    """Drop lines like one of a run's last ``window`` kept lines (None: any); metrics, faults and boundaries stay."""
    guarded = F.col("line").rlike(r"(?i)(pass_rate\s*=|traceback|exception|Phase\s+\d+\s+Track|===\s*scripts/run\.py)")
    keyed = lines.select("run_id", "pos", "line", t.tokens(F.col("line")).alias("words"), guarded.alias("guarded"))
    return keyed.groupBy("run_id").applyInPandas(lambda pdf: _fuzzy(pdf, least, window), SCHEMA)
