"""Pointers put into texts."""

import pytest

from pyspark.sql import functions as F

from tidelog.functions import tags
from tidelog.operators import headings, paste, routing, values

ROWS = [("a", "1", 2, ["x", "b"]), ("a", "2", 5, ["y"]), ("a", "10", 5, []), ("c", "1", 1, None)]


@pytest.fixture(scope="module")
def stored(spark):
    return spark.createDataFrame([(run, i, at, "kv", "", keys, "{}", 1, 0) for run, i, at, keys in ROWS], values.RECORD)


def texts(spark, *rows):
    return spark.createDataFrame(rows, "run_id string, text string")


def found(df):
    return {r["run_id"]: r["text"] for r in df.collect()}


def test_line_anchors_and_footer(spark, stored):
    df = texts(spark, ("a", "s [lines 1 - 3] m [Line 5] e [Lines 7-9]"), ("b", "[Lines 1-3]"), ("c", "none  \n"), ("d", None))
    assert found(paste.paste(df, stored, "line_anchor")) == {"a": "s [lines 1 - 3] [#1] b, x m [Line 5] [#10] e [Lines 7-9]", "b": "[Lines 1-3]", "c": "none\n\n[CONTEXT POINTERS]: [#1]", "d": None}


def test_block_anchors(spark, stored):
    df = texts(spark, ("a", "[Block 1-5]\nend"), ("c", "[Line 1] x"))
    assert found(paste.paste(df, stored, "line_anchor_block")) == {"a": "[Block 1-5]\n[#1] b, x\n[#2] y\n[#10]\nend", "c": "[Line 1] [#1] x"}


def test_keys_after_pointers(spark, stored):
    df = texts(spark, ("a", "[#1] and [Ref 2] and [#10] and [#99]"), ("b", "[#1]"))
    assert found(paste.paste(df, stored, "minimal_keys")) == {"a": "[#1] (b, x) and [Ref 2] (y) and [#10] and [#99]", "b": "[#1]"}


def test_other_names(spark, stored):
    df = texts(spark, ("a", "x"), ("b", ""))
    assert found(paste.paste(df, stored, "none")) == {"a": "x", "b": ""}
    assert found(paste.paste(df, stored, "pointer")) == {"a": "x\n\n[CONTEXT POINTERS]: [#1] b, x [#2] y [#10]", "b": ""}
    with pytest.raises(ValueError):
        paste.paste(df, stored, "oops")


def _record(id_, line_no, block_no=0, value="{}", kind="kv", keys=()):
    return {"id": id_, "line_no": line_no, "kind": kind, "keys": list(keys), "value": value, "block_no": block_no}


def test_headings_take_their_blocks_or_shares():
    records = [_record("1", 2, 1, '{"a": 1}'), _record("2", 3, 1, '{"b": 2, "c": 3}'), _record("3", 9, 2, '{"d": 4}'), _record("9", 1, 1, kind="stack_trace")]
    bounds, text = [(1, 5), (6, 10)], "### Block 1\nx\n### Block 2\ny"
    merged = "### Block 1\nExtracted Values:\n[#2] a, b, c\nx\n### Block 2\nExtracted Values:\n[#3] d\ny"
    assert headings.under_headings(text, records, bounds) == merged
    assert headings.under_headings(text, records, bounds, merge=False) == merged.replace("[#2] a, b, c", "[#1] a\n[#2] b, c")
    # one block number for all: shares by number of headings, the first one larger
    flat = [r | {"block_no": 1} for r in records]
    assert headings.under_headings(text, flat, bounds, merge=False) == merged.replace("[#2] a, b, c", "[#1] a\n[#2] b, c")
    # no heading: marks that open a line; by the blocks that begin there
    assert headings.under_headings("[Block 6-10]\nz", flat, bounds, merge=False) == "[Block 6-10]\nExtracted Values:\n[#3] d\nz"
    assert headings.under_headings("no mark", records, bounds) == "no mark" and headings.under_headings(text, [], bounds) == text and headings.under_headings(text, records, []) == text


def test_ranges_and_keys():
    many = _record("12345678", 4, value='{"a": 1, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1}')
    text = headings.under_ranges("[block 3 - 5] and [Block 7-8]", [many, many, _record("1", 3, keys=["z", "y"])], [], form="hash")
    assert text == "[block 3 - 5]\nExtracted Values:\n[HASH_12345678] a, b, c, d, e...\n[H#1] y, z and [Block 7-8]"
    assert headings.merged([_record("1", 1, value="text"), _record("2", 1, value="[1]")])["id"] == "1"


def test_block_payload():
    records = [_record("1", 1, keys=["k"]), _record("2", 3)]
    text = "a [#1] k\n\n b \nc [Ref 3]"
    assert headings.block_payload(text, records, [(1, 2), (3, 4)]) == "[Block 1-2]\n[#1] k\na\n\n[Block 3-4]\n[#2]\nb\nc"
    assert headings.block_payload(text, records, [], block_size=3, pointers=False) == "[Block 1-3]\na [#1] k\nb\n\n[Block 4-4]\nc [Ref 3]"


def test_headings_on_tables(spark, stored):
    df, blocks = texts(spark, ("a", "### Block 1\n### Block 2"), ("b", "### Block 1"), ("d", None)), spark.createDataFrame([("a", 0, 1, 3), ("a", 1, 4, 9)], "run_id string, block_no int, lo int, hi int")
    shown = found(headings.paste_blocks(df, stored, blocks, merge=False))
    assert shown["b"] == "### Block 1" and shown["d"] is None and shown["a"].startswith("### Block 1\nExtracted Values:\n[#1] b, x\n[#2] y\n### Block 2\nExtracted Values:\n[#10]")


def test_routes_gates_and_hints(spark):
    sizes = spark.createDataFrame([(n,) for n in (0, 1499, 1500, 2999, 3000, 9999, 10_000)], "n int").select(F.col("n"), routing.route(F.col("n")).alias("r"), routing.legacy_route(F.col("n")).alias("l"))
    rows = sizes.select("r", "l", routing.allows_values(F.col("r")).alias("v"), routing.needs_sanitizing(F.col("r")).alias("s"), routing.allows_distilling(F.col("r"), True).alias("d"), routing.allows_timeline(F.col("r"), never=True).alias("t")).collect()
    assert [tuple(r)[:4] for r in rows] == [("very_short", "stop", False, False), ("very_short", "stop", False, False), ("short", "stop", False, False), ("short", "stop", False, False), ("medium", "ghost_only", False, True), ("medium", "ghost_only", False, True), ("full", "full", True, True)]
    assert all(r["d"] and not r["t"] for r in rows)
    assert routing.options_for("medium", {}) == {"drain_sim_th": 0.8, "lexical_remove_numbers": False, "lexical_mask_ip": False, "drain_extended_masks": True}
    assert routing.options_for("full", {"drain_sim_th": 0.7}) == {"drain_sim_th": 0.7}
    one = spark.createDataFrame([("full_pipe", "x" * 200, "y", "a\r\n[full output: x]\nb [See remaining 3] c\nd\n", "/home/me/.lg/r/raw.txt", '{"a": 1}', 1)], "track string, raw string, shown string, text string, path string, out string, code int")
    no = F.lit(False)
    got = one.select(
        routing.wants_raw_hint(F.col("track"), F.col("raw"), F.col("shown"), no, no), routing.wants_raw_hint(F.col("track"), F.col("shown"), F.col("shown"), no, F.lit(True)), routing.wants_raw_hint(F.lit("passthrough"), F.col("raw"), F.col("shown"), no, F.lit(True)),
        routing.drop_filter_hints(F.col("text")), routing.raw_hint(F.col("path"), "/home/me"), routing.passes_through(F.col("track"), F.lit("cat"), F.col("out")), routing.filter_usable(F.lit(True), F.col("code"), F.lit("ok"), F.lit("Program not found")),
    ).first()
    assert tuple(got) == (True, True, False, "a\nd\n", "[full log ~/.lg/r/raw.txt]", True, False)


def test_tags(spark):
    c = lambda x: F.lit(x)
    got = spark.range(1).select(tags.repeats(c(3), c(7), c("a <*>"), c("x"), c("x")), tags.repeats(c(3), c(7), c("t"), c("x"), c("y")), tags.metric(c("k"), c("1"), unit=c("ms")), tags.tensor(c("2x3"), c("f32")), tags.stripped_entropy(c(1.25)), tags.json_ref(c("7"), c(2.0), c("a,b")), tags.short("ERR", c("gone"))).first()
    assert tuple(got) == ('RLE id=3 count=7 tpl="a <*>" first=x', 'RLE id=3 count=7 tpl="t" first=x last=y', "METRIC k=1 unit=ms", "TENSOR shape=2x3 dtype=f32", "ENTROPY size=1.2KB stripped", "JSON id=7 size=2.0KB keys=a,b", "ERR gone")
