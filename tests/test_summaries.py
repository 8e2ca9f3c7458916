"""The older extractor, dict masks, template merges, inline timelines, template parameters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions import text as t
from tidelog.operators import clusters, summaries
from tidelog.operators import lines as ln


def _lines(spark, rows):
    return spark.createDataFrame([("a", i, x) for i, x in enumerate(rows)], ln.SCHEMA)


def test_summaries(spark):
    long = "x " * 50
    rows = [f"app loss=0.5 step=7 {long}", "plain", "k=1 j=two", "b{'aaaaaaaaaaaaaaaa': 1, 'c': 2}", "http://h a=1 b=2", None]
    got = summaries.summarise(_lines(spark, rows)).orderBy("pos").collect()
    assert got[0]["line"] == f"[HASH_{got[0]['id']}] kv pairs (2): loss, step" and got[0]["value"] == rows[0] and got[0]["size"] == len(rows[0])
    assert [r["line"] for r in got[1:]] == ["plain", "k=<k> j=<j>", f"[HASH_{got[3]['id']}] dict block (31 chars, keys: aaaaaaaaaaaaaaaa, c)", "http://h a=1 b=2", ""] and got[3]["kind"] == "dict"
    kept = summaries.summarise(_lines(spark, [rows[0], "k=1 j=two", "k=2 j=two"]), metrics=True, rare=True).orderBy("pos").collect()
    assert [r["line"] for r in kept] == [rows[0], "k=<k> j=<j>", "k=<k> j=<j>"]
    strip = summaries.summarise(_lines(spark, ["12.5s 3 mod - " + "k=1 j=2 " * 20, "k=1 j=2 " * 20]), mode="strip").orderBy("pos").collect()
    assert strip[0]["line"] == "12.5s 3 mod - " + ("k=1 j=2 " * 20)[:80] + "…" and strip[1]["line"] == ("k=1 j=2 " * 20)[:100] + "…"
    text = summaries.appendix(summaries.summarise(_lines(spark, rows)).where("id IS NOT NULL").withColumn("line_no", F.col("pos") + 1)).first()["text"]
    assert text.startswith(f"---\n[AVAILABLE CONTEXT HASHES]:\n- [HASH_{got[0]['id']}] (kv, line 1)\n  data: app loss=0.5") and f"[HASH_{got[3]['id']}] (dict, line 4)" in text
    assert sorted(tuple(r)[1:] for r in summaries.signature_counts(_lines(spark, ["a 1", "a 2.5", "b " + "z" * 30])).collect()) == [("a <N>", 2), ("b <BLOB>", 1)]


def test_masked_dicts(spark):
    masked = summaries.mask_dicts(_lines(spark, ["x {'a': 1, 'b': {'c': 2}} y", "{a: 1}", "no", "{broken: value here}", None]))
    assert [tuple(r)[2:] for r in masked.orderBy("pos").collect()] == [("x <MASK> y", ["a", "b"], "{'a': 1, 'b': {'c': 2}}"), ("{a: 1}", None, None), ("no", None, None), ("<MASK>", ["broken"], "{broken: value here}"), ("", None, None)]
    assert summaries.dict_appendix(masked).first()["text"] == "---\n[EXTRACTED DICT PARAMS (Lark)]:\n- line 1: keys=[a, b]\n- line 4: keys=[broken]"


def test_characters_by_flags(spark):
    rows = spark.createDataFrame([("\x1b[31m 5/10 [ab]\x1b[0m",), ("a, [1, 2, 3, 4, 5]  b",), ("  ",), ("x=1.5 <TS> y",), (None,)], "line string")
    got = rows.select(t.clean_chars(F.col("line"), ansi=True, progress="drop"), t.clean_chars(F.col("line"), ansi=True, progress="collapse", arrays=True, tabs=True), t.clean_chars(F.col("line"), numbers=True, special=True)).collect()
    assert [r[0] for r in got] == [None, "a, [1, 2, 3, 4, 5]  b", None, "x=1.5 <TS> y", None]
    assert [r[1] for r in got] == ["[PROGRESS]", "a, [FLOAT_ARRAY_MASKED]\tb", None, "x=1.5 <TS> y", None] and got[3][2] == "x <TS> y"
    shown = spark.createDataFrame([("2026-03-05T10:00:00", "abcdef"), ("bad date", "ab")], "at string, x string").select(t.short_date(F.col("at")), t.clip(F.col("x"), 4)).collect()
    assert [tuple(r) for r in shown] == [("Mar 05", "abc…"), ("bad da", "ab  ")]


@pytest.mark.parametrize("how,slow", [("jaccard", clusters._by_jaccard), ("weights", clusters._by_weights)])
def test_templates_by_words_against_all_pairs(how, slow):
    rng = np.random.default_rng(1)
    bags = [list(rng.choice(list("abcdefg"), rng.integers(1, 7))) for _ in range(60)]
    got = {tuple(p) for p in slow(bags, 0.8).tolist()}
    df = {w: sum(w in b for b in bags) for w in "abcdefg"}
    vec = [np.array([b.count(w) * (np.log((1 + len(bags)) / (1 + df[w])) + 1) for w in "abcdefg"]) for b in bags]
    near = lambda i, j: len({*bags[i]} & {*bags[j]}) / len({*bags[i]} | {*bags[j]}) if how == "jaccard" else vec[i] @ vec[j] / np.sqrt(vec[i] @ vec[i] * (vec[j] @ vec[j]))
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if near(i, j) >= 0.8} and got
    assert clusters._linked([5, 3, 9, 7], np.array([[0, 2], [2, 1]])) == [3, 3, 3, 7]


def test_merges_timelines_and_parameters(spark):
    rows = [("user 10.0.0.1 in", 0), ("user 10.0.0.2 in", 0), ("METRIC a", 1), ("METRIC b", 1), ("", -1), ("user 10.0.0.3 in", 0), ("rare x", 2)]
    tpl = {0: "user <:IP:> in", 1: "METRIC <*>", 2: "rare x", -1: None}
    found = spark.createDataFrame([("a", i, x, c, tpl[c]) for i, (x, c) in enumerate(rows)], ln.SCHEMA + ", cluster int, template string")
    assert [r["line"] for r in clusters.inline_timeline(found).orderBy("first").collect()] == ["[x2] <DRAIN:0> user <MASK>> in", "METRIC a", "METRIC b", "[x1] <DRAIN:0> user <MASK>> in", "rare x\n  sample: rare x"]
    assert clusters.templates_used(found).first()["templates"] == 3
    runs = clusters.template_runs(found)
    assert clusters.payload(runs).first()["text"].split("\n")[:4] == [*clusters.HEAD, "[x2] user <:IP:> in"]
    held = clusters.template_parameters(found)
    assert sorted((r["line_no"], r["value"], tuple(r["keys"])) for r in held.collect()) == [(1, '{"ip": "10.0.0.1"}', ("ip",)), (2, '{"ip": "10.0.0.2"}', ("ip",)), (3, '{"val_0": "a"}', ("val_0",)), (4, '{"val_0": "b"}', ("val_0",)), (6, '{"ip": "10.0.0.3"}', ("ip",))]
    id_ = held.where("line_no = 1").first()["id"]
    assert [r["line"] for r in clusters.pointerise(runs, held).orderBy("first").collect()][0] == f"[x2] user [#{id_}] in"
    own = held.where("line_no = 1").withColumn("kind", F.lit("kv"))
    assert sorted((r["line_no"], r["kind"]) for r in clusters.merge_records(own, held).collect()) == [(1, "kv"), (2, "drain"), (3, "drain"), (4, "drain"), (6, "drain")]
    assert clusters.line_parameters("a  b c", "a <*> c") == {"val_0": "b"} and clusters.line_parameters("x", "x") is None
    t_ = spark.createDataFrame([("a", 0, "x y <*>"), ("a", 1, "x y z"), ("a", 2, "q r"), ("a", 3, "<:IP:>"), ("a", 4, "<*>")], "run_id string, cluster int, template string")
    assert {r["cluster"]: r["merged"] for r in clusters.similar_templates(t_, 0.6).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}
    assert {r["cluster"]: r["merged"] for r in clusters.similar_templates(t_, 0.6, "weights").collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
