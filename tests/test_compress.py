"""Traces, values, clusters, commands and the assembled run."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tidelog.operators import clusters, commands, traces, values
from tidelog.operators import lines as ln
from tidelog.plans import compress

TRACE = 'Traceback (most recent call last):\n  File "{0}", line {1}, in <module>\n    {2}\n'
TINY = TRACE.format("app.py", 9, "main()") + '  File "app.py", line 5, in main\n    obj.version\nAttributeError: \'NoneType\' object has no attribute \'version\'\n'
MEDIUM = (
    "============================= test session starts ==============================\ncollected 12 items\nFAILED tests/test_api.py::test_health - AssertionError: 503\n"
    + 'Traceback (most recent call last):\n  File "tests/test_api.py", line 44, in test_health\n    assert resp.status_code == 200\nAssertionError: assert 503 == 200\n'
    + "INFO: Step docker/build — layer cache miss repo=app/web sha=abc123\n" * 180
)
MODEL = {"model": "resnet50", "batch_size": 32, "lr": 0.001, "optimizer": "adam", "epochs": 10, "dataset": "imagenet", "workers": 4, "pin_memory": True}
FULL = TRACE.format("train.py", 120, "trainer.fit()") + "RuntimeError: CUDA out of memory\n" + (
    "host=192.168.1.42 port=8080 env=prod region=us-east-1 service=api-gateway\n100%|██████████| 500/500 [01:00<00:00, 8.00it/s]\n" + json.dumps(MODEL) + "\n"
) * 120


# Short forms of the runs above.
SHORT = {
    "tiny_trace": "[T1] AttributeError: '\\'NoneType\\' object has no attribute \\'version\\'' @ U:app.py:9 -> U:app.py:5",
    "medium_cicd": "= test session starts =\ncollected 12 items\n[T1] AssertionError: 'assert 503 == 200' @ U:test_api.py:44\n[x180] INFO: Step docker/build — layer cache miss repo=app/web sha=abc123",
    "full_route": "[T1] RuntimeError: 'CUDA out of memory' @ U:train.py:120\n[x120] Seq:\n  host= port=8080 env=prod region=us-east-1 service=api-gateway\n  [PROGRESS]",
}


def test_runs_match_the_expected_texts(spark):
    runs = spark.createDataFrame([("tiny_trace", TINY), ("medium_cicd", MEDIUM), ("full_route", FULL), ("blank", " \n"), ("none", None)], "run_id string, text string")
    found = {r["run_id"]: r for r in compress.compress(runs).collect()}
    assert {k: r["route"] for k, r in found.items()} == {"tiny_trace": "very_short", "medium_cicd": "full", "full_route": "full", "blank": "passthrough", "none": "passthrough"}
    assert found["blank"]["compressed"] == " \n" and found["none"]["compressed"] is None
    assert {k: found[k]["compressed"] for k in SHORT} == SHORT


@pytest.mark.parametrize("text, want", [("{'a': 1, \"b\": [True, None,]}", {"a": 1, "b": [True, None]}), ("(1, -2.5)", (1, -2.5)), ("[]", []), ("'x'", "x")])
def test_literals(text, want):
    assert values.literal(text) == want


@pytest.mark.parametrize("text", ["{1: 2}", "[,]", "[1 2]", "(", "", "1e5", "[1] x", "{'a'}"])
def test_what_is_no_literal(text):
    with pytest.raises(ValueError):
        values.literal(text)


def test_spans_and_cut_json():
    assert list(values.spans("a {b '}' {c}} d {e} {f", "{}")) == ["{b '}' {c}}", "{e}"]
    assert values.parse('{"a": [1, 2') == ({"a": [1, 2]}, ["a"]) and values.parse("{oops") == (None, []) and values.parse('[{"a": 1},') == ([{"a": 1}], ["a"])


def test_records_merge_and_cap():
    one = lambda i, value: values.Record(str(i), i, "kv", "kv", ("a",), value, 1)
    rs = [one(1, '{"a": "1"}'), one(2, "[1]"), one(3, "word"), one(4, '{"b": 1, "c": 2}')]
    merged = values.stack_merge(rs, 3)
    assert [(r.id, r.line_no, json.loads(r.value)) for r in merged] == [("5", 3, {"a": "1", "list_1": [1], "text_2": "word"}), ("4", 4, {"b": 1, "c": 2})]
    many = [one(i, json.dumps({f"k{i}_{j}": j for j in range(1500)})) for i in range(1, 26)]
    assert len(values.cap(many, 10)) == 10


def test_tensors(spark):
    texts = ["x = tensor([[1, 2], [3, 4]], dtype=torch.float32, device='cuda:0') end", "array(1)", "none"]
    df = spark.createDataFrame([(x,) for x in texts], "line string")
    found = [r[0] for r in df.select(values.tensor_summary(F.col("line"))).collect()]
    assert found == [re.sub(values.TENSOR, values.summarise_tensor, x) for x in texts]
    assert found[0].startswith("x = [Matrix: ndim=2, elements~=6, dtype=torch.float32, device=cuda:0]")


def test_pair_lines_join_and_null_lines_stay(spark):
    rows = [("a", 0, " k=1 "), ("a", 1, "j=2"), ("a", 2, "plain"), ("a", 3, "u=1 http://x"), ("b", 0, "k=1")]
    found = values.merge_pair_lines(spark.createDataFrame(rows, ln.SCHEMA)).orderBy("run_id", "pos").collect()
    assert [tuple(r) for r in found] == [("a", 0, "k=1 | j=2"), ("a", 2, "plain"), ("a", 3, "u=1 http://x"), ("b", 0, "k=1")]


def test_failed_tests_give_way_to_marks():
    report = ["start", "== FAILURES ==", "_ test_a _", "x.py:3: AssertionError", "> assert 1 == 2", "E  assert 1 == 2", "--- Captured stdout ---", "E  no", "_ T::test_b _", "E\tbad", "== short test summary info ==", "FAILED x", "gone"]
    kept, found = traces.test_failures(report)
    assert kept == ["start", "[T1] pytest_failure: test_a | @x.py:3 | > assert 1 == 2 | E  assert 1 == 2", "", "[T2] pytest_failure: test_b | E\tbad"]
    assert [x[:2] for x in found] == [(2, "test_a"), (2, "test_b")]
    assert traces.test_failures(["== FAILURES ==", "E x", "== short test summary info ==", "FAILED a.py::T::m - x"])[1] == [(1, "m", "pytest_failure: m | E x")]


def test_sections_chains_and_foreign_frames():
    lines = ["=== Stack Trace 1 ===", 'Traceback (most recent call last): File "/usr/lib/a.py", line 1, in f File "b/own.py", line 2, in g ValueError: x', "=== Stack Trace 2 ===", "=== Stack Trace 3 ===", "nothing"]
    kept, found = traces.extract(lines)
    assert kept == ["[T1] ValueError", "ERR extraction_failed: empty section", "[T2] unknown"]
    assert found[0][3] == "[T1] ValueError: 'x' @ U:own.py:2" and found[1][3] == "[T2] extraction_failed"
    chain = TRACE.format("a.py", 1, "f()") + "KeyError: 1\n\nDuring handling\n\n" + TRACE.format("b.py", 2, "g()") + "OSError: gone\n"
    assert [(f.kind, f.message) for f in traces.parse_trace(chain)] == [("KeyError", "1"), ("OSError", "gone")]
    faults = traces.parse_trace(chain)
    assert traces.show(faults, "frames", 3) == "Trace 3: a.py → KeyError: 1\nb.py → OSError: gone"
    assert traces.show(faults, "other") == "ERR KeyError: 1\nERR OSError: gone" and traces.show([], "frames", 2) == "Trace 2: ERR extraction_failed"
    assert traces.show(faults, "close_lines") == '  File "b.py", line 2, in ?\nERR OSError: gone' and traces.show(faults, "last_only") == "ERR OSError: gone"
    deep = [traces.Fault("ValueError", "x" * 130, [("/a/one.py", 1, "f"), ("two.py", 2, ""), ("c\\three.py", 3, "g")])]
    assert traces.show(deep, "first_last") == "first=f() last=g() ERR ValueError: " + "x" * 100 + "…"
    assert traces.show(deep, "sentry") == "f() [... 1 framework frames hidden ...] g() → ValueError: " + "x" * 100 + "…"
    assert traces.show(deep, "schema_det", 1) == '{"trace_no": 1, "error_type": "ValueError", "message": "' + "x" * 130 + '", "crashing_file": "three.py", "crashing_line": 3, "crashing_function": "g"}'
    assert traces.show(deep, "schema_det_tuple") == 'T?(ValueError, "' + "x" * 120 + '", three.py:3, g)'
    table = traces.extract(["before", *chain.splitlines(), "after"], "schema_det_table")[0]
    assert table == ["before", "", "During handling", "", "after", "| ID | Type | Message | File:Line | Func |", "|---|---|---|---|---|", "| None | KeyError | 1 | a.py:1 | - |", "| None | OSError | gone | b.py:2 | - |"]
    kept, held = traces.extract(chain.splitlines()[:4], "rtk_hash")
    assert kept == [f"ERR KeyError: 1 [HASH_{held[0][0]}]"] and held[0][3].startswith("Traceback")
    assert traces.extract(["x WARNING: " + "w" * 80, "a WARN", "plain"], warn_len=60)[0] == ["w" * 57 + "...", "a WARN", "plain"]


def test_miner_generalises_and_respects_length():
    ids, templates = clusters.mine(["user a logged in now", "user b logged in now", "user c logged in", "", "job x"])
    assert ids == [0, 0, 1, -1, 2] and templates[0] == "user a logged in now"
    miner = clusters.Miner()
    assert miner.add("user a logged in now") == miner.add("user b logged in now") and miner.template(0) == "user <*> logged in now"


def test_clusters_on_runs(spark):
    rows = [("a", i, x) for i, x in enumerate(["job 1 of ten was done", "job 2 of ten was done", None, "end"])]
    found = clusters.cluster_lines(spark.createDataFrame(rows, ln.SCHEMA))
    assert sorted((r["pos"], r["cluster"]) for r in found.collect()) == [(0, 0), (1, 0), (2, -1), (3, 1)]
    assert sorted((r["cluster"], r["n"], len(r["samples"])) for r in clusters.templates(found).collect()) == [(0, 2, 2), (1, 1, 1)]
    assert [r["n"] for r in clusters.template_runs(found).orderBy("first").collect()] == [2, 1, 1]
    t = spark.createDataFrame([("a", 0, "x y z"), ("a", 1, "x y z <*>"), ("a", 2, "q")], "run_id string, cluster int, template string")
    assert sorted((r["cluster"], r["merged"]) for r in clusters.similar_templates(t).collect()) == [(0, 0), (1, 0), (2, 2)]


# Commands and their tracks.
TRACKS = [
    ("git status", "git", "rtk_lossless"), ("sudo FOO=1 /usr/bin/LS -la", "ls", "rtk_fast"), ("cat a | wc", "compound_command", "full_pipe"), ("cat a", "cat", "passthrough"),
    ("python -c 'print(1)'", "-c", "passthrough"), ("uvicorn app:main", "uvicorn", "daemon_warn"), ("npm run dev", "npm", "daemon_warn"), ("pytest -q", "pytest", "pytest_native"),
    ("python -m pytest", "-m", "full_pipe"), ("echo 'open", "unknown", "full_pipe"), ("a;b", "a;b", "full_pipe"), ("make", "make", "full_pipe"), (None, None, None), ("", "unknown", "full_pipe"),
]


def test_tracks(spark):
    found = commands.classify(spark.createDataFrame([(c,) for c, _, _ in TRACKS], "command string"))
    assert [tuple(r) for r in found.collect()] == TRACKS
    shell = commands.classify(spark.createDataFrame([("git status",), ("ls",)], "command string"), shell=F.lit(True))
    assert [r["track"] for r in shell.collect()] == ["full_pipe", "full_pipe"]


def test_time_blocks(spark):
    rows = [("a", i, x) for i, x in enumerate(["0.5s\tx", "no time", "70s\tx", "80s\tx", "200s\tx", "201s\tx"])] + [("b", 0, "2026-01-01 00:00:00 x"), ("b", 1, "2026-01-01 00:02:00 y"), ("b", 2, "z")]
    found = ln.blocks_by_time(spark.createDataFrame(rows, ln.SCHEMA), 60).orderBy("run_id", "block_no").collect()
    assert [tuple(r) for r in found] == [("a", 0, 1, 3), ("a", 1, 4, 5), ("a", 2, 6, 6), ("b", 0, 1, 2), ("b", 1, 3, 3)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], ln.SCHEMA)
    for made in (traces.extract_traces(none), values.extract_values(none), clusters.cluster_lines(none), clusters.project(none), values.merge_pair_lines(none), ln.blocks_by_time(none)):
        assert made.count() == 0
    assert compress.compress(spark.createDataFrame([], "run_id string, text string")).count() == 0


def test_each_fold_runs_once(spark):
    runs = spark.createDataFrame([("a", "x")], "run_id string, text string")
    plan = compress.compress(runs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 3


def test_a_failing_stage_falls_back(spark, monkeypatch):
    guarded = compress._guarded(lambda pdf: 1 / 0, ["run_id", "pos", "line", "part", "record"])
    import pandas as pd

    out = guarded(pd.DataFrame([("a", 0, "x", "line", None)], columns=["run_id", "pos", "line", "part", "record"]))
    assert out["part"].tolist() == ["line", "failed"]
    short = spark.createDataFrame([("a", "full", [], [], [], [], True), ("b", "short", ["[T1] E", "### Block 1"], [{"id": "1", "line_no": 1, "kind": "stack_trace", "summary": "", "keys": [], "value": "[T1] E: 'x'\nmore", "size": 1, "block_no": 0}], [{"id": "2", "line_no": 1, "kind": "kv", "summary": "", "keys": ["k"], "value": '{"k": 1}', "size": 1, "block_no": 1}], [(1, 3)], False)], compress.SHORT)
    made = {r["run_id"]: r for r in compress.assemble(short).collect()}
    assert made["a"]["failed"] and made["b"]["text"] == "[T1] E: 'x'\n### Block 1\nExtracted Values:\n[#2] k"
    assert {r["run_id"]: r["text"] for r in compress.assemble(short, "pointer").collect()}["b"].endswith("[CONTEXT POINTERS]: [#2] k")


def test_tracks_from_a_file(spark, tmp_path):
    path = tmp_path / "tracks.toml"
    path.write_text('fast = ["make"]\npassthrough = ["show "]\n')
    lists = commands.read_lists(str(path))
    assert lists["fast"] == ("make",) and lists["daemons"] == commands.DAEMONS
    found = commands.classify(spark.createDataFrame([("make x",), ("show y",), ("cat y",)], "command string"), **lists)
    assert [r["track"] for r in found.collect()] == ["rtk_fast", "passthrough", "full_pipe"]
    path.write_text("other = []")
    with pytest.raises(ValueError):
        commands.read_lists(str(path))
