"""Captures to stored runs and back; pointer lines, buffers, the command line."""

import argparse

import pytest
from pyspark.sql import functions as F

from tidelog import __main__ as cli
from tidelog.operators import lines as ln
from tidelog.operators import store, values
from tidelog.plans import runs
from tidelog.sources import logs
from tidelog.streaming import telemetry

CAPTURES = [
    ("r1", "make all", False, "step\n" * 400 + "done key=value other=3", "warn", 0, "2026-03-05T10:00:00"), ("r2", "cat x", False, "\x1b[31mtext\x1b[0m\n\n  end", None, 0, "2026-03-05T11:00:00"),
    ("r3", "pytest -q", False, "collected 3 items\n=== 3 passed in 0.1s ===", "", 0, "2026-03-06T10:00:00"), ("r4", "npm run dev", False, None, None, None, "2026-03-07T10:00:00"),
    ("r5", "build", True, None, None, 1, "2026-03-08T10:00:00"), ("r6", "tool --json", False, '{"a": 1}', None, 0, None),
]
SCHEMA = "run_id string, command string, in_shell boolean, stdout string, stderr string, exit_code int, timestamp string"


def test_runs_are_executed_stored_and_read(spark, tmp_path):
    made = runs.execute(spark.createDataFrame(CAPTURES, SCHEMA), home="/root").withColumn("experimental", F.lit(False)).withColumn("records", F.array(F.struct(F.lit("1").alias("id"), F.lit("{}").alias("value"))))
    got = {r["run_id"]: r for r in made.collect()}
    assert got["r1"]["compressed"].startswith("[x400] step") and got["r1"]["hint"] == "[full log ~/.tidelog/runs/r1/raw.txt]" and got["r1"]["route"] == "short"
    assert got["r2"]["compressed"] == "text\nend" and got["r2"]["track"] == "passthrough" and got["r2"]["hint"] is None
    assert got["r3"]["compressed"] == "all 3 tests passed" and got["r3"]["hint"] is None and got["r4"]["exit_code"] == 2 and got["r4"]["compressed"] == ""
    assert got["r5"]["compressed"] == "" and got["r5"]["compression_ratio"] == 1.0 and got["r6"]["compressed"] == '{"a": 1}'
    path, said = f"{tmp_path}/runs", f"{tmp_path}/invoked"
    logs.save_runs(made, path)
    assert logs.load_run(spark, path, "r2", "compressed") == "text\nend"
    with pytest.raises(KeyError):
        logs.load_run(spark, path, "none")
    logs.log_invocations(runs.invocations(made), said)
    logs.log_invocations(runs.invocations(made), said)
    assert logs.read_telemetry(spark, said).count() == 12 and telemetry.savings(logs.read_telemetry(spark, said)).agg(F.sum("n")).first()[0] == 10  # a row without a time is in no window
    assert logs.list_files(spark, path).where("length > 0").count() > 0 and logs.file_digests(spark, path + "/*").where("length(sha256) = 64").count() > 0
    say = lambda *args: cli.run(spark, cli.parser().parse_args(["--store", path, *args]))
    assert say("raw", "r3")[0].startswith("collected") and say("get", "r1", "1", "9") == ["{}", "(not found)"]
    shown = say("stats")[0]
    assert shown.startswith("Session stats\n  Runs:           6\n") and "\n  Tracks:\n    full_pipe: 3\n" in shown and shown.endswith("  Subcommands:\n    run: 6\n")
    lines = say("history", "--limit", "2")
    assert len(lines) == 2 and lines[0].startswith("r5     0% saved") and "Mar 08" in lines[0]
    assert isinstance(cli.parser(), argparse.ArgumentParser)
    log = tmp_path / "a.log"
    log.write_text("one\none\n")
    assert say("read", str(log)) == ["[x2] one"]
    made_again = store.first_by_id(made.withColumnRenamed("run_id", "id"), "id", "timestamp")
    assert made_again.count() == 6


def test_stages_and_stats(spark, tmp_path):
    before = spark.createDataFrame([("a", 0, "xx"), ("a", 1, " "), ("b", 0, " ")], ln.SCHEMA)
    after = ln.drop_blank(before)
    assert sorted(tuple(r) for r in logs.stage_stats(before, after).collect()) == [("a", 2, 3, 1, 2), ("b", 1, 1, 0, 0)]
    logs.save_stages({"raw": before, "kept": after}, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s/02_kept").count() == 1
    head = spark.createDataFrame([("a", 0, "noise"), ("a", 1, "1.5s 3 first"), ("a", 2, "rest"), ("b", 0, "only")], ln.SCHEMA)
    assert sorted(r["line"] for r in ln.strip_header(head).collect()) == ["1.5s 3 first", "only", "rest"]


def _record(id_, line_no, value):
    return values.Record(id_, line_no, "kv", "", tuple(sorted(value)), str(value).replace("'", '"'), 1)


def test_pointer_lines():
    ids = ["[H#A1B]", "[HASH_00AA11BB] x=1", "[Ref 7] k", " [#12] a | b", "[#12", "text [#1]"]
    assert [values.pointer_id(x) for x in ids] == ["A1B", "00AA11BB", "7", "12", None, None]
    records = [_record("1", 1, {"a": 1}), _record("2", 3, {"b": 2, "c": 3}), _record("3", 4, {"d": 4})]
    kept, held = values.merge_pointers(["[#1] a", "text", "[#2] b", "[#3]", "[#9]"], records, 3)
    assert kept == ["text", "[#4] a, b, c", "[#3]", "[#9]"] and [(r.id, r.line_no) for r in held] == [("3", 4), ("4", 3)]
    assert values.merge_pointers(["no pointers"], records, 3) == (["no pointers"], records)


def test_pointers_and_buffers_on_tables(spark):
    rows = [("a", i, x) for i, x in enumerate(["k=1", "k=2 j=3", "m: /x", "plain", "z=5", "pip install x==1 y=2"])]
    lines = spark.createDataFrame(rows, ln.SCHEMA)
    got = sorted((r["pos"], r["lines"], r["n_keys"], r["value"]) for r in values.buffer_pairs(lines, 2).collect())
    assert got == [(1, 2, 2, '{"j":"3","k":"2"}'), (2, 1, 1, '{"m":"/x"}'), (4, 1, 1, '{"z":"5"}')]
    found = spark.createDataFrame([("a", "7", 9, "kv", "", ["k"], "{}", 1, 0), ("a", "8", 9, "kv", "", [], "{}", 1, 0)], values.RECORD)
    marks = spark.createDataFrame([("a", 0, "[#7] k"), ("a", 3, "[#7]"), ("a", 4, None)], ln.SCHEMA)
    assert sorted((r["id"], r["line_no"]) for r in values.place_at_pointers(marks, found).collect()) == [("7", 4), ("8", 9)]
    blocks = spark.createDataFrame([("a", 0, 1, 5), ("a", 1, 6, 8)], "run_id string, block_no int, lo int, hi int")
    assert sorted((r["id"], r["block_no"]) for r in values.finalise(found.withColumn("line_no", F.when(F.col("id") == "7", 2).otherwise(F.col("line_no"))), blocks, 1).collect()) == [("7", 1), ("8", 2)]
    asked = spark.createDataFrame([("a", "7"), ("a", "0")], "run_id string, id string")
    assert sorted((r["id"], r["value"]) for r in values.lookup(found, asked).collect()) == [("0", "(not found)"), ("7", "{}")]
