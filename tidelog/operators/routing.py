"""Routes by size, what each route allows, and gates on what came out; all column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as t
from .lines import BREAK

# The routes' upper limits in characters, their thresholds of likeness, and the texts that gates look for.
LIMITS = (("very_short", 1500), ("short", 3000), ("medium", 10_000))
LEGACY_LIMITS = (("stop", 3000), ("ghost_only", 10_000))
LIKENESS = {"medium": 0.8, "full": 0.5}
NOT_STARTED = ("failed to resolve", "not found on path", "program not found", "failed to spawn")
FILTER_HINT = r"(?i)\[full output[^\]]*\][^\n]*|\[see remaining[^\]]*\][^\n]*"
LEAST_SAVED = 150


def _limited(chars: Column, limits: tuple, last: str) -> Column:
    out = F.lit(last)
    for name, limit in reversed(limits):
        out = F.when(chars < limit, name).otherwise(out)
    return out


def route(chars: Column) -> Column:
    return _limited(chars, LIMITS, "full")


def legacy_route(chars: Column) -> Column:
    return _limited(chars, LEGACY_LIMITS, "full")


def _gate(route: Column, routes: tuple, force: bool) -> Column:
    return F.lit(True) if force else route.isin(*routes)


def allows_values(route: Column, force: bool = False) -> Column:
    return _gate(route, ("full",), force)


def allows_distilling(route: Column, force: bool = False) -> Column:
    return _gate(route, ("medium", "full"), force)


def allows_timeline(route: Column, force: bool = False, never: bool = False) -> Column:
    return F.lit(False) if never else _gate(route, ("very_short", "short", "medium", "full", "ghost_only"), force)


def needs_sanitizing(route: Column) -> Column:
    return route.isin("medium", "full", "ghost_only")


def options_for(route: str, options: dict) -> dict:
    """Options of a run on a route: its own threshold of likeness where none is set; on all but full, masks and no removal of numbers."""
    own = {"drain_sim_th": LIKENESS[route]} if route in LIKENESS else {}
    masks = {} if route == "full" else {"lexical_remove_numbers": False, "lexical_mask_ip": False, "drain_extended_masks": True}
    return own | options | masks


def passes_through(track: Column, base: Column, output: Column) -> Column:
    """Whether output is shown as it is: commands of that track, inline code, and JSON for machines."""
    return (track == "passthrough") | (base == "-c") | t.is_machine_json(output)


def filter_usable(used: Column, exit_code: Column, out: Column, err: Column) -> Column:
    """Whether an output filter ran and could start its target."""
    text = F.lower(F.concat_ws("\n", out, err))
    return used & (exit_code != 127) & ~F.exists(F.array(*map(F.lit, NOT_STARTED)), lambda x: F.contains(text, x))


def drop_filter_hints(x: Column) -> Column:
    """Text without the lines in which an output filter says where the rest is; a line end at the text's end stays."""
    lines = F.filter(F.split(x, BREAK), lambda y: ~y.rlike(FILTER_HINT))
    return F.concat(F.regexp_replace(F.array_join(lines, "\n"), r"\n+$", ""), F.when(x.endswith("\n"), "\n").otherwise(""))


def wants_raw_hint(track: Column, raw: Column, shown: Column, passed: Column, distilled: Column) -> Column:
    """Whether a note says where the whole log is: never for some tracks and passed tests, always for distilled texts, else where enough was saved."""
    never = track.isin("passthrough", "daemon_warn") | F.coalesce(passed, F.lit(False))
    return ~never & (F.coalesce(distilled, F.lit(False)) | (F.length(raw) > F.length(shown) + LEAST_SAVED))


def raw_hint(path: Column, home: str = "") -> Column:
    """The note itself; what lies under ``home`` is shown under ``~``."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    under = F.lower(path).startswith(home.lower()) if home else F.lit(False)
    return F.concat(F.lit("[full log "), F.when(under, F.concat(F.lit("~"), F.substring(path, len(home) + 1, F.length(path)))).otherwise(path), F.lit("]"))
