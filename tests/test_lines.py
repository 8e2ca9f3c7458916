from pyspark.sql import functions as F

from tidelog.functions import text as t
from tidelog.operators import lines as ln


def _one(spark, change, line):
    return spark.createDataFrame([(line,)], "line string").select(change(F.col("line"))).first()[0]


def _lines(spark, *lines):
    return spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], ln.SCHEMA)


def test_text(spark):
    assert _one(spark, t.strip_ansi, "a\rb\x1b[31mc\x1b[0m\x07") == "bc"
    assert _one(spark, t.mid_clean, "{a} [#3]  (b) [x2]") == "a [#3] b [x2]"
    assert _one(spark, t.sanitize, "[T1] at api.example.com 10.0.0.1 id 123456 (x)") == "[T1] at id x"
    assert _one(spark, t.prune_paths, "at /a/b/c/d/e.py:3") == "at .../e.py:3"
    assert _one(spark, t.mask_arrays, "x [1, 2, 3.5, -4, 5e3] y") == "x [FLOAT_ARRAY_MASKED] y"
    assert _one(spark, t.strip_hex, "deadbeef café") == "[HEX] café"
    assert abs(_one(spark, t.entropy, "abab") - 1) < 1e-12
    assert _one(spark, t.pytest_success, "===== 12 passed in 0.3s =====") == "all 12 tests passed"
    assert _one(spark, t.is_machine_json, ' {"a": 1}') and not _one(spark, t.is_machine_json, "{a")


def test_warnings_move_to_the_end(spark):
    got = ln.extract_warnings(_lines(spark, "a.py:3: UserWarning: old", "x", "a.py:3: UserWarning: old", "WARNING: hot", "y")).orderBy("pos").collect()
    assert [r["line"] for r in got] == ["x", "y", "[x2] UserWarning @ a.py:3 : old", "WARNING: hot"]


def test_sequences(spark):
    got = ln.timeline(_lines(spark, *["load 1.", "save 1."] * 3, "end", "end")).orderBy("first").collect()
    assert [r["line"] for r in got] == ["[x3] Seq:\n  load 1.\n  save 1.", "[x2] end"]


def test_lines_and_blocks(spark):
    runs = spark.createDataFrame([("r", "a\r\n\n b  c\x0bd"), ("e", ""), ("n", None)], "run_id string, text string")
    assert [r["line"] for r in ln.split_lines(runs, "run_id", "text").orderBy("pos").collect()] == ["a", " b ", "c", "d"]
    got = ln.blocks_by_size(_lines(spark, "x" * 6, "y" * 3, "z" * 30, "w"), 10).orderBy("lo").collect()
    assert [(r["lo"], r["hi"]) for r in got] == [(1, 2), (3, 3), (4, 4)]


def test_blocks_of_many_lines_and_global_dedup(spark):
    import random

    rng = random.Random(3)
    sizes = [rng.randrange(60) for _ in range(30_000)]
    lines = spark.createDataFrame([("a", i, "x" * n) for i, n in enumerate(sizes)], ln.SCHEMA)
    got = sorted((r["lo"], r["hi"]) for r in ln.blocks_by_size(lines, 200).collect())
    starts = [0, *ln.size_cuts(sizes, 200)]
    assert got == [(a + 1, b) for a, b in zip(starts, [*starts[1:], len(sizes)])]
    words = "a b c d e f g h i j k l".split()
    rows = [" ".join(rng.sample(words, rng.randrange(0, 9))) for _ in range(300)] + ["pass_rate = 1", "pass_rate = 1"]
    kept, want = [], []
    for x in rows:
        s = set(x.split()) if "=" not in x else {"pass", "rate", "1"}
        if "pass_rate" in x or not any((len(s & k) / len(s | k) if s | k else 1.0) >= 0.6 for k in kept):
            kept.append(s)
            want.append(x)
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(rows)], ln.SCHEMA)
    assert [r["line"] for r in ln.fuzzy_dedup(df, 0.6, None).orderBy("pos").collect()] == want


def test_raw_lines(spark):
    runs = spark.createDataFrame([("a", "noise\n1.5s 3 12: \x1b[31mfirst\x1b[0m\n2.5s 4\tsecond\n\n3.5s 5 third"), ("b", None)], "id string, raw string")
    assert [tuple(r)[1:] for r in ln.raw_lines(runs, "id", "raw", 2).orderBy("pos").collect()] == [(0, "first"), (1, "second")]
