"""A run's log from raw text to its short form: all stages in order, as far as a run's size calls for them.

Between stages a run's lines and the records taken out of them travel as rows of one table, so each of the three folds runs once
and nothing is joined back: ``part`` tells lines from records, ``record`` holds the latter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import astuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import clusters, headings, paste, routing, traces, values
from ..operators import lines as ln

RECORD = "struct<id:string,line_no:int,kind:string,summary:string,keys:array<string>,value:string,size:int,block_no:int>"
MIXED = f"run_id string, pos int, line string, part string, record {RECORD}"
FIELDS = ("id", "line_no", "kind", "summary", "keys", "value", "size", "block_no")
SHORT = f"run_id string, route string, lines array<string>, traces array<{RECORD}>, records array<{RECORD}>, bounds array<struct<lo:int,hi:int>>, failed boolean"
#: How values are put into the short texts.
STRATEGIES = {"block_heading_params": headings.under_headings, "available_params_block": headings.under_ranges}
DEFAULT_PASTE = "block_heading_params"


def _record(r: values.Record) -> dict:
    return dict(zip(FIELDS, (list(x) if isinstance(x, tuple) else x for x in astuple(r)), strict=True))


def _lines_of(pdf: pd.DataFrame) -> list[str]:
    return pdf[pdf["part"] == "line"].sort_values("pos")["line"].fillna("").tolist()


def _rows(run: str, lines: list[str], records: list[tuple[str, dict]]) -> list[tuple]:
    return [(run, i, x, "line", None) for i, x in enumerate(lines)] + [(run, None, None, part, r) for part, r in records]


def _guarded(fold: Callable, columns: list[str]) -> Callable:
    """A fold that leaves a run's rows as they are, with a mark, where it fails, so that one bad log doesn't end the job."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            out = fold(pdf)
        except Exception:
            out = [*pdf[columns].itertuples(index=False, name=None), (pdf["run_id"].iat[0], None, None, "failed", None, *[None] * (len(columns) - 5))]
        return pd.DataFrame(out, columns=columns, dtype=object)

    return run


def _take_traces(pdf: pd.DataFrame) -> list[tuple]:
    kept, found = traces.extract(_lines_of(pdf))
    held = [("trace", dict(zip(FIELDS, (id_, no, "stack_trace", summary, [], value, len(value), 0), strict=True))) for id_, no, summary, value in found]
    return _rows(pdf["run_id"].iat[0], kept, held)


def _take_values(pdf: pd.DataFrame, force: bool) -> list[tuple]:
    route = pdf["route"].iat[0]
    if route != "full" and not force:
        return list(pdf[["run_id", "pos", "line", "part", "record", "route"]].itertuples(index=False, name=None))
    kept, found = values.extract(_lines_of(pdf))
    others = pdf[pdf["part"] != "line"]
    held = [*zip(others["part"], others["record"], strict=True), *(("value", _record(r)) for r in found)]
    return [(*row, route) for row in _rows(pdf["run_id"].iat[0], kept, held)]


def _placed(records: list[values.Record], bounds: list[tuple[int, int]]) -> list[values.Record]:
    """Records with their blocks' numbers, merged and capped within each; those past all blocks belong to the last."""
    by_block: dict[int, list[values.Record]] = {}
    for r in records:
        block = next((i + 1 for i, (lo, hi) in enumerate(bounds) if lo <= r.line_no <= hi), len(bounds))
        by_block.setdefault(block, []).append(values.Record(**{**r.__dict__, "block_no": block}))
    return [r for block in sorted(by_block) for r in values.cap(values.stack_merge(by_block[block], 10), 10)]


def _summarise(pdf: pd.DataFrame, longest: int, likeness: float, depth: int, budget: int) -> pd.DataFrame:
    """One row of a run: its timeline, its records, its blocks' lines."""
    run, route, failed = pdf["run_id"].iat[0], pdf["route"].iat[0], bool((pdf["part"] == "failed").any())
    lines = pdf[pdf["part"] == "line"].sort_values("pos")
    held = {part: [r for r in pdf.loc[pdf["part"] == part, "record"]] for part in ("trace", "value")}
    shown, records, bounds = [], [], []
    if not failed:
        try:
            whole = lines["before"].fillna("").tolist()
            if held["value"] and whole:
                starts = [0, *ln.size_cuts(list(map(len, whole)), budget)]
                bounds = [(a + 1, b) for a, b in zip(starts, [*starts[1:], len(whole)], strict=True)]
            records = _placed([values.Record(**{k: tuple(r[k]) if k == "keys" else r[k] for k in FIELDS}) for r in held["value"]], bounds) if bounds else []
            kept = lines[~lines["blank"].astype(bool)]
            ids, _ = clusters.mine(kept["masked"].fillna("").tolist(), least=likeness, depth=depth)
            if len(kept):
                shown = ln._timeline(kept.assign(cluster=[str(i) if i >= 0 else "" for i in ids]), longest)["line"].tolist()
        except Exception:
            failed = True
    row = (run, route, shown, held["trace"], list(map(_record, records)), [{"lo": a, "hi": b} for a, b in bounds], failed)
    return pd.DataFrame([row], columns=["run_id", "route", "lines", "traces", "records", "bounds", "failed"])


def with_route(lines: DataFrame) -> DataFrame:
    """Lines with their run's ``route``; one window, as the lines already lie by run. Rows that are no lines count nothing."""
    return lines.withColumn("route", routing.route(F.coalesce(F.sum(F.length("line")).over(Window.partitionBy("run_id")), F.lit(0))))


def stages(runs: DataFrame, run_id: str = "run_id", text: str = "text", workspace: str = "", force_values: bool = False, longest: int = 4, likeness: float = 0.7, depth: int = 4, budget: int = 15_000) -> dict[str, DataFrame]:
    """The stages' tables by name, each made from the one before it: ``soft_clean`` lines; ``traced``, ``told`` (warnings grouped, routed) and ``taken``
    (values out) mixed rows; ``cleaned`` lines before and after sanitising; ``short``, one row a run. Nothing is computed for stages that are not read."""
    soft = ln.soft_clean(ln.split_lines(runs, run_id, text), workspace, delete_entropy=True)
    rows = soft.select("run_id", "pos", "line", F.lit("line").alias("part"), F.lit(None).cast(RECORD).alias("record"))
    columns = ["run_id", "pos", "line", "part", "record"]
    traced = rows.groupBy("run_id").applyInPandas(_guarded(_take_traces, columns), MIXED)
    told = with_route(ln.extract_warnings(traced))
    taken = told.groupBy("run_id").applyInPandas(_guarded(lambda pdf: _take_values(pdf, force_values), [*columns, "route"]), MIXED + ", route string")
    route, line = F.col("route"), F.col("line")
    mid = taken.withColumn("before", F.when(routing.allows_values(route), t.mid_clean(line)).otherwise(line))
    cleaned = mid.withColumn("line", F.when(routing.needs_sanitizing(route), t.sanitize(F.col("before"))).otherwise(F.col("before")))
    blank = routing.needs_sanitizing(route) & t.is_blank(line)
    keyed = cleaned.select("*", F.coalesce(blank, F.lit(False)).alias("blank"), t.one_space(line).alias("key"), t.cluster_mask(line).alias("masked"))
    short = keyed.groupBy("run_id").applyInPandas(lambda pdf: _summarise(pdf, longest, likeness, depth, budget), SHORT)
    return {"soft_clean": soft, "traced": traced, "told": told, "taken": taken, "cleaned": cleaned, "short": short}


def reinjected(lines: Column, found: Column) -> Column:
    """Lines in which marks that stand alone give way to the first line of their traceback's text."""
    texts = F.map_from_entries(F.transform(found, lambda r: F.struct(r["id"], r["value"])))

    def show(x: Column) -> Column:
        value = F.try_element_at(texts, F.regexp_extract(t.strip(x), t.rx(traces.PLACEHOLDER), 1))
        return F.when(t.is_blank(value) | value.isNull(), x).otherwise(t.strip(F.split(value, "\n")[0]))

    return F.transform(F.flatten(F.transform(lines, lambda x: F.split(x, "\n"))), show)


def assemble(short: DataFrame, strategy: str = DEFAULT_PASTE, form: str = "bracket") -> DataFrame:
    """Each run's short text: tracebacks put back, then values put in by a named strategy; ValueError for a name that is not known."""
    body = F.array_join(reinjected(F.col("lines"), F.col("traces")), "\n")
    texts = short.select("run_id", "route", "failed", body.alias("text"), "records", "bounds")
    if strategy in STRATEGIES:
        return texts.withColumn("text", headings.listed(STRATEGIES[strategy], F.col("text"), F.col("records"), F.col("bounds"), form=form, merge=True))
    return paste.paste_held(texts, F.col("records"), strategy, form)


def compress(runs: DataFrame, run_id: str = "run_id", text: str = "text", workspace: str = "", strategy: str = DEFAULT_PASTE, **options) -> DataFrame:
    """One row a run: ``run_id``, ``route``, ``compressed``, ``raw_chars``, ``compressed_chars``, ``records`` (the values taken out).

    Runs without lines, or null, have the route ``passthrough``, runs in which a stage fails ``fallback``; both come back as they are.
    ``run_id`` must be unique. One task holds one run's lines.
    """
    made = assemble(stages(runs, run_id, text, workspace, **options)["short"], strategy)
    raw = runs.select(F.col(run_id).cast("string").alias("run_id"), F.col(text).alias("raw"))
    joined = raw.join(made, "run_id", "left")
    body = F.when(F.col("route").isNull() | F.col("failed"), F.col("raw")).otherwise(F.col("text"))
    route = F.when(F.col("failed"), "fallback").otherwise(F.coalesce("route", F.lit("passthrough")))
    return joined.select("run_id", route.alias("route"), body.alias("compressed"), F.coalesce(F.length("raw"), F.lit(0)).alias("raw_chars"), F.coalesce(F.length(body), F.lit(0)).alias("compressed_chars"), "records")
