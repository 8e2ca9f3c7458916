"""The vocabulary of short tags, as column expressions. The tags' words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tag(word: str, *parts: tuple[str, Column]) -> Column:
    """A word and its named parts; null and empty ones are left out."""
    shown = [F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(name), value.cast("string"))) for name, value in parts]
    return F.concat_ws(" ", F.lit(word), *shown)


def _kilobytes(size: Column) -> Column:
    return F.format_string("%.1fKB", F.bround(size.cast("double"), 1))  # halves go to the even digit


def repeats(cluster: Column, n: Column, template: Column, first: Column | None = None, last: Column | None = None) -> Column:
    first, last = (F.lit(None) if x is None else x for x in (first, last))
    quoted = F.concat(F.lit('"'), template, F.lit('"'))
    return _tag("RLE", ("id=", cluster), ("count=", n), ("tpl=", quoted), ("first=", first), ("last=", F.when(~last.eqNullSafe(first), last)))


def metric(key: Column, value: Column, **extra: Column) -> Column:
    return _tag("METRIC", ("", F.concat(key, F.lit("="), value)), *((f"{k}=", v) for k, v in extra.items()))


def tensor(shape: Column, dtype: Column | None = None, device: Column | None = None) -> Column:
    dtype, device = (F.lit(None) if x is None else x for x in (dtype, device))
    return _tag("TENSOR", ("shape=", shape), ("dtype=", dtype), ("device=", device))


def stripped_entropy(size_kb: Column) -> Column:
    return F.concat(F.lit("ENTROPY size="), _kilobytes(size_kb), F.lit(" stripped"))


def json_ref(id_: Column, size_kb: Column, keys: Column | None = None) -> Column:
    return _tag("JSON", ("id=", id_), ("size=", _kilobytes(size_kb)), ("keys=", F.lit(None) if keys is None else keys))


def short(word: str, text: Column) -> Column:
    """``TRACE``, ``PATH``, ``WARN`` or ``ERR`` before a text."""
    return F.concat(F.lit(f"{word} "), text)
