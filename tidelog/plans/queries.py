"""Queries of the log operators over the driver's tables, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import lines as ln
from ..operators import store


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.split_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each user, rendered from events: stamps, colours, progress, warnings, pairs and JSON."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    case = F.col("event_id") % 8
    stamp, n = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("event_id")
    text = (
        F.when(case == 0, F.concat(stamp, F.lit(" | INFO | app.core:run:12 - user="), F.col("user_id"), F.lit(" event="), F.col("event_type")))
        .when(case == 1, F.concat(F.lit("\x1b[32mstep "), n % 7, F.lit("\x1b[0m done")))
        .when(case == 2, F.concat(n % 100, F.lit("%|##| "), n % 500, F.lit("/500 [00:01<00:00, 8.0it/s]")))
        .when(case == 3, F.concat(F.lit("app/mod.py:"), n % 5, F.lit(": UserWarning: value "), n % 3, F.lit(" is deprecated")))
        .when(case == 4, F.concat(F.lit("WARNING: retry "), n % 4))
        .when(case == 5, F.concat(F.lit("host=api.example.com port=8080 id="), n + 100000))
        .when(case == 6, F.when(n % 3 == 0, "job failed").otherwise("idle"))
        .otherwise(F.col("props"))
    )
    rows = e.select(F.col("user_id").cast("string").alias("run_id"), "ts", "event_id", text.alias("line"))
    pos = F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id")) - 1
    return rows.select("run_id", pos.alias("pos"), "line")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = F.length(F.regexp_replace("text", r"[ \n]+", " "))
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("timestamp"), F.length("text").cast("long").alias("raw_chars"),
        packed.cast("long").alias("compressed_chars"), F.col("lang").alias("track"), (F.col("doc_id") % 10 == 0).alias("experimental"), F.substring("text", 1, 20).alias("preview"),
    )


EVENTS = r"""log AS (SELECT CAST(user_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
 CASE event_id % 8 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | INFO | app.core:run:12 - user=' || user_id || ' event=' || event_type
 WHEN 1 THEN chr(27) || '[32mstep ' || (event_id % 7) || chr(27) || '[0m done' WHEN 2 THEN (event_id % 100) || '%|##| ' || (event_id % 500) || '/500 [00:01<00:00, 8.0it/s]'
 WHEN 3 THEN 'app/mod.py:' || (event_id % 5) || ': UserWarning: value ' || (event_id % 3) || ' is deprecated' WHEN 4 THEN 'WARNING: retry ' || (event_id % 4)
 WHEN 5 THEN 'host=api.example.com port=8080 id=' || (event_id + 100000) WHEN 6 THEN CASE WHEN event_id % 3 = 0 THEN 'job failed' ELSE 'idle' END ELSE props END AS line FROM events)"""
LINES = r"""split AS (SELECT CAST(doc_id AS VARCHAR) AS run_id, list_filter(string_split_regex(text, '\r\n|[\n\r]'), lambda x: trim(x, ' ' || chr(9)) <> '') AS w FROM documents),
log AS (SELECT run_id, unnest(range(0, len(w))) AS pos, unnest(w) AS line FROM split)"""
RUNS = r"""runs AS (SELECT CAST(doc_id AS VARCHAR) AS id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS timestamp, length(text) AS raw_chars, length(regexp_replace(text, '[ \n]+', ' ', 'g')) AS compressed_chars,
 lang AS track, doc_id % 10 = 0 AS experimental, text[1:20] AS preview FROM documents)"""


def _replace(x: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        x = "regexp_replace({}, '{}', '{}', 'g')".format(x, a.replace("'", "''"), b)
    return x


_CLEAN = _replace("line", (r"\x1b\[[0-?9;]*[ -/]*[@-~]", ""))
_RLE = """keyed AS (SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS key FROM {0}),
opened AS (SELECT *, CASE WHEN key = lag(key) OVER (PARTITION BY run_id ORDER BY pos) THEN 0 ELSE 1 END AS o FROM keyed),
islands AS (SELECT *, sum(o) OVER (PARTITION BY run_id ORDER BY pos) AS island FROM opened)
SELECT run_id, min(pos)::INT AS first, count(*) AS n, CASE WHEN count(*) > 1 THEN '[x' || count(*) || '] ' || trim(arg_min(line, pos)) ELSE arg_min(line, pos) END AS line FROM islands GROUP BY run_id, island"""
_PROGRESS = r"regexp_matches(line, '(?i)\d+/\d+\s*\[|\d+%\|[█▏▎▍▌▋▊▉\s]+\||Map:\s*\d+%|sandbox:\s*\d+%|\[progress\]|examples\s*\[')"
_SANITIZED = r"trim(regexp_replace({}, '[ \t]+', ' ', 'g'))".format(_replace("line", (t.HOST, " "), (t.IPV6, " "), (t.IPV4, " "), (t.STAMP, " "), (t.HEX_ADDRESS, " "), (t.LONG_NUMBER, " "), (t.BRACKETS, " ")))

QUERIES = {
    "timeline": lambda s, d: ln.run_lengths(ln.sanitize(event_log(s, d))),
    "line_split": lambda s, d: _lines(s, d),
    "run_lengths": lambda s, d: ln.run_lengths(_lines(s, d)),
    "event_log": event_log,
    "ansi_strip": lambda s, d: ln.change(event_log(s, d), t.strip_ansi),
    "progress_collapse": lambda s, d: ln.collapse_progress(event_log(s, d)),
    "temporal_strip": lambda s, d: ln.drop_blank(ln.change(event_log(s, d), t.strip_temporal)),
    "sanitize": lambda s, d: ln.sanitize(event_log(s, d)),
    "warning_groups": lambda s, d: ln.group_warnings(event_log(s, d)),
    "route": lambda s, d: ln.route(_lines(s, d)),
    "line_blocks": lambda s, d: ln.block_of_lines(_lines(s, d), 10),
    "size_blocks": lambda s, d: ln.blocks_by_size(_lines(s, d), 2000),
    "soft_clean": lambda s, d: ln.soft_clean(event_log(s, d)),
    "mid_clean": lambda s, d: ln.mid_clean(event_log(s, d)),
    "warning_extract": lambda s, d: ln.extract_warnings(event_log(s, d)),
    "sequence_timeline": lambda s, d: ln.timeline(event_log(s, d)),
    "fuzzy_dedup": lambda s, d: ln.fuzzy_dedup(event_log(s, d)),
    "error_lines": lambda s, d: ln.error_lines(ln.change(event_log(s, d), t.strip_ansi)),
    "dashboard": lambda s, d: store.dashboard(store.usual(_runs(s, d))),
    "track_counts": lambda s, d: store.counts_by(store.usual(_runs(s, d)), "track", "unknown"),
    "history": lambda s, d: store.history(store.usual(_runs(s, d)), 10),
}

_WARNED = "CASE WHEN line LIKE 'app/mod%' THEN 'UserWarning @ app/mod.py:' || regexp_extract(line, ':(\\d+):', 1) || ' : ' || regexp_extract(line, 'Warning: (.*)$', 1) ELSE line END"
_SOFT = [(t.LOGURU_TIME, ""), (t.LOGURU, ""), (t.RUNNER, ""), (t.SYSLOG, ""), (t.APACHE, ""), (t.THREAD_TIME, "<TS>"), (t.HEX_ADDRESS, "<ADDR>"), (t.PID, "[PID]")]

SQL = {
    "mid_clean": f"WITH {EVENTS} SELECT run_id, pos::INT AS pos, trim(regexp_replace({_replace('line', (t.BRACKETS, ' '))}, '[ \\t]+', ' ', 'g')) AS line FROM log",
    "soft_clean": f"""WITH {EVENTS}, a AS (SELECT run_id, pos, trim({_CLEAN}) AS line FROM log), m AS (SELECT run_id, pos, {_PROGRESS} AS busy, line FROM a WHERE line <> ''),
p AS (SELECT *, coalesce(lag(busy) OVER (PARTITION BY run_id ORDER BY pos), false) AS before FROM m), k AS (SELECT run_id, pos, CASE WHEN busy THEN '[PROGRESS]' ELSE line END AS line FROM p WHERE NOT (busy AND before)),
c AS (SELECT run_id, pos, trim({_replace('line', *_SOFT)}) AS line FROM k) SELECT run_id, pos::INT AS pos, {_replace("regexp_replace(line, '\\s+', ' ', 'g')", (t.BARE_HEX, '[HEX]'))} AS line FROM c WHERE line <> ''""",
    "warning_extract": f"""WITH {EVENTS}, x AS (SELECT *, line LIKE 'app/mod%' OR line LIKE 'WARNING%' AS warned, {_WARNED} AS text FROM log),
g AS (SELECT run_id, 1 AS part, min(pos) AS pos, CASE WHEN count(*) > 1 THEN '[x' || count(*) || '] ' ELSE '' END || text AS line FROM x WHERE warned GROUP BY run_id, text),
u AS (SELECT run_id, 0 AS part, pos, line FROM x WHERE NOT warned UNION ALL SELECT * FROM g) SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY part, pos) - 1)::INT AS pos, line FROM u""",
    "timeline": f"WITH {EVENTS}, cleaned AS (SELECT run_id, pos, {_SANITIZED} AS line FROM log), kept AS (SELECT * FROM cleaned WHERE line <> ''), " + _RLE.format("kept"),
    "line_split": f"WITH {LINES} SELECT run_id, pos::INT AS pos, line FROM log",
    "run_lengths": f"WITH {LINES}, " + _RLE.format("log"),
    "event_log": f"WITH {EVENTS} SELECT run_id, pos::INT AS pos, line FROM log",
    "ansi_strip": f"WITH {EVENTS} SELECT run_id, pos::INT AS pos, {_CLEAN} AS line FROM log",
    "progress_collapse": f"WITH {EVENTS}, marked AS (SELECT *, {_PROGRESS} AS busy FROM log), was AS (SELECT *, coalesce(lag(busy) OVER (PARTITION BY run_id ORDER BY pos), false) AS before FROM marked) SELECT run_id, pos::INT AS pos, CASE WHEN busy THEN '[PROGRESS]' ELSE line END AS line FROM was WHERE NOT (busy AND before)",
    "temporal_strip": f"WITH {EVENTS}, cleaned AS (SELECT run_id, pos, trim({_replace('line', (t.LOGURU_TIME, ''), (t.LOGURU, ''), (t.RUNNER, ''), (t.SYSLOG, ''), (t.APACHE, ''), (t.THREAD_TIME, '<TS>'), (t.HEX_ADDRESS, '<ADDR>'), (t.PID, '[PID]'))}) AS line FROM log) SELECT run_id, pos::INT AS pos, line FROM cleaned WHERE line <> ''",
    "sanitize": f"WITH {EVENTS}, cleaned AS (SELECT run_id, pos, {_SANITIZED} AS line FROM log) SELECT run_id, pos::INT AS pos, line FROM cleaned WHERE line <> ''",
    "warning_groups": f"WITH {EVENTS}, w AS (SELECT run_id, pos, CASE WHEN line LIKE 'app/mod%' THEN 'UserWarning @ app/mod.py:' || regexp_extract(line, ':(\\d+):', 1) || ' : ' || regexp_extract(line, 'Warning: (.*)$', 1) ELSE line END AS text FROM log WHERE line LIKE 'app/mod%' OR line LIKE 'WARNING%') SELECT run_id, min(pos)::INT AS first, count(*) AS n, CASE WHEN count(*) > 1 THEN '[x' || count(*) || '] ' ELSE '' END || text AS line FROM w GROUP BY run_id, text",
    "route": f"WITH {LINES}, n AS (SELECT run_id, sum(length(line))::BIGINT AS chars FROM log GROUP BY run_id) SELECT run_id, chars, CASE WHEN chars < 1500 THEN 'very_short' WHEN chars < 3000 THEN 'short' WHEN chars < 10000 THEN 'medium' ELSE 'full' END AS route FROM n",
    "line_blocks": f"WITH {LINES} SELECT run_id, (pos // 10)::INT AS block_no, (min(pos) + 1)::INT AS lo, (max(pos) + 1)::INT AS hi FROM log GROUP BY run_id, pos // 10",
    "size_blocks": f"WITH RECURSIVE {LINES}, g AS (SELECT run_id, pos, 0 AS block_no, length(line) AS used FROM log WHERE pos = 0 UNION ALL SELECT l.run_id, l.pos, CASE WHEN g.used + length(l.line) + 1 <= 2000 THEN g.block_no ELSE g.block_no + 1 END, CASE WHEN g.used + length(l.line) + 1 <= 2000 THEN g.used + length(l.line) + 1 ELSE length(l.line) END FROM g JOIN log l ON l.run_id = g.run_id AND l.pos = g.pos + 1) SELECT run_id, block_no, (min(pos) + 1)::INT AS lo, (max(pos) + 1)::INT AS hi FROM g GROUP BY run_id, block_no",
    "error_lines": f"WITH {EVENTS}, c AS (SELECT run_id, pos, {_CLEAN} AS line FROM log) SELECT run_id, min(pos)::INT AS pos, line FROM c WHERE regexp_matches(lower(line), 'traceback|error:|exception:|failed|critical|pass_rate|syntax error') GROUP BY run_id, line",
    "dashboard": f"WITH {RUNS}, n AS (SELECT count(*) AS total_runs, sum(raw_chars)::BIGINT AS raw_chars, sum(compressed_chars)::BIGINT AS compressed_chars FROM runs WHERE NOT experimental) SELECT *, greatest(0, raw_chars - compressed_chars) AS chars_saved, compressed_chars / raw_chars AS compression_ratio, (raw_chars - compressed_chars) // 4 AS tokens_saved FROM n",
    "track_counts": f"WITH {RUNS} SELECT track, count(*) AS n FROM runs WHERE NOT experimental GROUP BY track",
    "history": f"WITH {RUNS} SELECT id, timestamp, round((raw_chars - compressed_chars) * 100.0 / raw_chars)::INT AS saved_pct, raw_chars || '->' || compressed_chars AS chars, trim(regexp_replace(preview, '\\s+', ' ', 'g')) AS content FROM runs WHERE NOT experimental ORDER BY timestamp DESC LIMIT 10",
}
