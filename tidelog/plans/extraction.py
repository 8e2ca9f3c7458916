"""Queries of traces, values, clusters, commands and the assembled run, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import clusters, commands, headings, paste, routing, summaries, traces, values
from ..operators import lines as ln
from . import compress
from ..sources.logs import stage_stats
from .queries import EVENTS, _SANITIZED, event_log


def fault_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each user with a traceback of two frames at every third event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id").cast("string")
    fault = F.array(
        F.lit("Traceback (most recent call last):"), F.concat(F.lit('  File "app/'), F.col("event_type"), F.lit('.py", line '), n, F.lit(", in run")), F.lit("    step()"),
        F.lit('  File "/usr/lib/core.py", line 7, in step'), F.concat(F.lit("ValueError: bad value "), n),
    )
    shown = F.when(F.col("event_id") % 3 == 0, fault).otherwise(F.array(F.concat(F.lit("ok "), n)))
    each = e.select(F.col("user_id").cast("string").alias("run_id"), "ts", "event_id", F.posexplode(shown).alias("i", "line"))
    return each.select("run_id", (F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id", "i")) - 1).alias("pos"), "line")


def tensor_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line with two tensors for each event."""
    n = F.col("event_id").cast("string")
    line = F.concat(F.lit("w = tensor([["), n, F.lit(", 2], [3, 4]], dtype=f"), n, F.lit(", device='cpu') b = array([1])"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(n.alias("run_id"), line.alias("line"))


def command_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command for each event, and whether it ran in a shell."""
    n = F.col("event_id")
    forms = ("git status -s {}", "cat file{}", "python -c {}", "npm run dev {}", "sudo A={} pytest -q", "find x{}", "make x{} && ls", "uvicorn app{}:main", "./build{}.sh", "pip install p{}")
    texts = F.array(*[F.concat(*[p for part in zip(map(F.lit, f.split("{}")), (n.cast("string"), F.lit("")), strict=True) for p in part]) for f in forms])
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.get(texts, (n % len(forms)).cast("int")).alias("command"), (n % 7 == 0).alias("in_shell"))


def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's log of events as one text."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return event_log(spark, sf_dir).groupBy("run_id").agg(F.array_join(rows, "\n").alias("text"))


#: A template for each kind of line that ``event_log`` renders.
TEMPLATES = ("<:STAMP:> | INFO | app.core:run:12 - user=<*> event=<*>", "step <*> done", "<*>%|##| <*>/500 [00:01<00:00, 8.0it/s]", "app/mod.py:<*>: UserWarning: value <*> is deprecated", "WARNING: retry <*>", "host=api.example.com port=8080 id=<*>", "job", "{}")


def event_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's log of events with the kind of its lines as their cluster; idle lines have none."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("run_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("pos"), (F.col("event_id") % 8).cast("int").alias("c"))
    lines = event_log(spark, sf_dir).join(e, ["run_id", "pos"])
    cluster = F.when(F.col("line") == "idle", -1).otherwise(F.col("c"))
    return lines.select("run_id", "pos", "line", cluster.alias("cluster"), F.when(cluster >= 0, F.get(F.array(*map(F.lit, TEMPLATES)), F.col("c"))).alias("template"))


def heading_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each user's events as records of one pair, ten a block; a text with a heading for each block; the blocks."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.select(F.col("user_id").cast("string").alias("run_id"), at.alias("line_no"), F.col("event_id").cast("string").alias("id"), "event_type")
    value = F.to_json(F.map_from_arrays(F.array("event_type"), F.array("id")))
    records = rows.select("run_id", "id", "line_no", F.lit("kv").alias("kind"), F.lit("").alias("summary"), F.array("event_type").alias("keys"), value.alias("value"), F.length(value).alias("size"), (F.floor((F.col("line_no") - 1) / 10) + 1).cast("int").alias("block_no"))
    blocks = records.groupBy("run_id", "block_no").agg(F.min("line_no").alias("lo"), F.max("line_no").alias("hi"))
    texts = blocks.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("block_no")), lambda n: F.format_string("### Block %d", n)), "\n").alias("text"))
    return texts, records, blocks


def dict_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line with an object for each event; at every fifth a nested one in single quotes."""
    n = F.col("event_id").cast("string")
    plain = F.concat(F.lit('ev {"type": "'), F.col("event_type"), F.lit('", "id": '), n, F.lit("} end"))
    nested = F.concat(F.lit("x {'outer': {'inner': "), n, F.lit("}, 'more': True}"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(n.alias("run_id"), F.lit(0).alias("pos"), F.when(F.col("event_id") % 5 == 0, nested).otherwise(plain).alias("line"))


def size_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's route by size, the older route, and what the route allows."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    r = routing.route(F.col("chars"))
    return d.select("doc_id", r.alias("route"), routing.legacy_route(F.col("chars")).alias("legacy"), routing.allows_values(r).alias("values"), routing.needs_sanitizing(r).alias("sanitize"), routing.allows_distilling(r).alias("distil"), routing.allows_timeline(r).alias("timeline"))


QUERIES = {
    "paste_headings": lambda s, d: headings.paste_blocks(*heading_texts(s, d)),
    "size_gates": size_gates,
    "cluster_runs": lambda s, d: clusters.template_runs(event_clusters(s, d)),
    "cluster_templates": lambda s, d: clusters.templates(event_clusters(s, d)).select("run_id", "cluster", "template", "n", F.col("samples")[0].alias("sample")),
    "inline_timeline": lambda s, d: clusters.inline_timeline(event_clusters(s, d)),
    "cluster_parameters": lambda s, d: clusters.template_parameters(event_clusters(s, d).where("cluster = 5")).select("run_id", "id", "line_no", "value"),
    "signature_counts": lambda s, d: summaries.signature_counts(event_log(s, d)),
    "char_clean": lambda s, d: event_log(s, d).select("run_id", "pos", t.clean_chars(F.col("line"), ansi=True, extra=True, numbers=True, special=True).alias("line")).where("line IS NOT NULL"),
    "masked_dicts": lambda s, d: summaries.mask_dicts(dict_log(s, d)).select("run_id", "line", F.array_join("keys", ",").alias("keys"), "raw"),
    "stage_stats": lambda s, d: stage_stats(event_log(s, d), ln.sanitize(event_log(s, d))),
    "pair_rows": lambda s, d: values.pair_rows(event_log(s, d)),
    "pair_counts": lambda s, d: values.pair_counts(event_log(s, d), 2),
    "pair_line_merge": lambda s, d: values.merge_pair_lines(event_log(s, d)),
    "time_blocks": lambda s, d: ln.blocks_by_time(event_log(s, d), 86_400),
    "command_tracks": lambda s, d: commands.classify(command_list(s, d), shell=F.col("in_shell")),
    "tensor_summary": lambda s, d: tensor_log(s, d).select("run_id", values.tensor_summary(F.col("line")).alias("line")),
    "trace_lines": lambda s, d: traces.extract_traces(fault_log(s, d)).where("id IS NULL").select("run_id", "pos", "line"),
    "trace_records": lambda s, d: traces.extract_traces(fault_log(s, d)).where("id IS NOT NULL").select("run_id", "id", "summary", "value"),
    "value_lines": lambda s, d: values.kept_lines(values.extract_values(event_log(s, d))),
    "value_store": lambda s, d: values.to_store(values.records(values.extract_values(event_log(s, d)))),
    "value_footers": lambda s, d: paste.footer(event_texts(s, d), values.records(values.extract_values(event_log(s, d)))),
    "line_clusters": lambda s, d: clusters.cluster_lines(event_log(s, d)),
    "templates": lambda s, d: clusters.templates(clusters.cluster_lines(event_log(s, d))),
    "template_runs": lambda s, d: clusters.template_runs(clusters.cluster_lines(event_log(s, d))),
    "template_merge": lambda s, d: clusters.similar_templates(clusters.templates(clusters.cluster_lines(event_log(s, d)))),
    "cluster_timeline": lambda s, d: clusters.project(event_log(s, d)),
    "compress": lambda s, d: compress.compress(event_texts(s, d)),
}

_PAIR = r"(?:^|[^\w.])([a-zA-Z_][\w.]*)\s*=\s*([^\s,;|]+)"
#: No line of these logs holds two pairs with colons.
_COLON = r"(?:^|[^\d\w.])([A-Za-z_]\w*):\s+([^\s]+)"
_FAULTS = "f AS (SELECT *, event_id % 3 = 0 AS bad, sum((event_id % 3 = 0)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS n FROM events)"

_CLUSTERS = """tagged AS (SELECT l.*, CASE WHEN line = 'idle' THEN -1 ELSE c END AS cluster, CASE WHEN line <> 'idle' THEN ([{0}])[c + 1] END AS template
 FROM log l JOIN (SELECT CAST(user_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, (event_id % 8)::INT AS c FROM events) e ON l.run_id = e.run_id AND l.pos = e.pos)""".format(", ".join(f"'{x}'" for x in TEMPLATES))
_ISLANDS = """opened AS (SELECT *, CASE WHEN cluster >= 0 AND cluster = lag(cluster) OVER (PARTITION BY run_id ORDER BY pos) THEN 0 ELSE 1 END AS o FROM tagged),
islands AS (SELECT *, sum(o) OVER (PARTITION BY run_id ORDER BY pos) AS island FROM opened)"""
_SQUEEZED = "trim(regexp_replace(regexp_replace({}, '{}', ' ', 'g'), '[ \\t]+', ' ', 'g'))"
_CLEANED = r"regexp_replace(line, '\x1b\[[0-?9;]*[ -/]*[@-~]', '', 'g')"
for _pattern in (t.SPECIAL_EXTRA, t.ALL_NUMBERS, t.SPECIAL):
    _CLEANED = _SQUEEZED.format(_CLEANED, _pattern)

SQL = {
    "paste_headings": """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spot FROM events),
b AS (SELECT run_id, (spot - 1) // 10 + 1 AS block, arg_max(event_id, spot) AS last, count(*) AS n, list_sort(list_distinct(list(event_type))) AS keys FROM r GROUP BY ALL)
SELECT run_id, string_agg('### Block ' || block || chr(10) || 'Extracted Values:' || chr(10) || '[#' || last || '] ' || array_to_string(keys[:3], ', ') || CASE WHEN len(keys) > 5 THEN '...' ELSE '' END, chr(10) ORDER BY block) AS text FROM b GROUP BY run_id""",
    "size_gates": """WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n FROM documents), r AS (SELECT *, CASE WHEN n < 1500 THEN 'very_short' WHEN n < 3000 THEN 'short' WHEN n < 10000 THEN 'medium' ELSE 'full' END AS route FROM d)
SELECT doc_id, route, CASE WHEN n < 3000 THEN 'stop' WHEN n < 10000 THEN 'ghost_only' ELSE 'full' END AS legacy, route = 'full' AS values, route IN ('medium', 'full') AS sanitize, route IN ('medium', 'full') AS distil, true AS timeline FROM r""",
    "cluster_runs": f"""WITH {EVENTS}, {_CLUSTERS}, {_ISLANDS}
SELECT run_id, min(pos)::INT AS first, count(*) AS n, any_value(cluster) AS cluster, CASE WHEN count(*) > 1 THEN '[x' || count(*) || '] ' || any_value(template) ELSE arg_min(line, pos) END AS line FROM islands GROUP BY run_id, island""",
    "cluster_templates": f"WITH {EVENTS}, {_CLUSTERS} SELECT run_id, cluster, any_value(template) AS template, count(*) AS n, arg_min(line, pos) AS sample FROM tagged WHERE cluster >= 0 GROUP BY run_id, cluster",
    "inline_timeline": f"""WITH {EVENTS}, {_CLUSTERS}, {_ISLANDS}, held AS (SELECT *, count(*) OVER (PARTITION BY run_id, cluster) AS held, first(line) OVER (PARTITION BY run_id, cluster ORDER BY pos) AS sample, regexp_replace(template, '<:[^:]*:', '<MASK>', 'g') AS shown FROM islands WHERE cluster >= 0)
SELECT run_id, min(pos)::INT AS first, count(*) AS n, CASE WHEN any_value(held) <= 2 THEN any_value(shown) || chr(10) || '  sample: ' || any_value(sample) ELSE '[x' || count(*) || '] <DRAIN:' || any_value(cluster) || '> ' || any_value(shown) END AS line
FROM held GROUP BY run_id, island, CASE WHEN held <= 2 THEN pos END""",
    "cluster_parameters": f"""WITH {EVENTS}, {_CLUSTERS}, v AS (SELECT run_id, pos, '{{"val_0": "' || regexp_extract(line, 'id=(.*)$', 1) || '"}}' AS value FROM tagged WHERE cluster = 5),
k AS (SELECT *, upper(sha256(value)[:3]) AS id FROM v) SELECT run_id, id, (min(pos) + 1)::INT AS line_no, arg_min(value, pos) AS value FROM k GROUP BY run_id, id""",
    "signature_counts": f"WITH {EVENTS} SELECT run_id, trim(regexp_replace(regexp_replace(line, '\\d+(?:\\.\\d+)?', '<N>', 'g'), '\\S{{20,}}', '<BLOB>', 'g')) AS signature, count(*) AS n FROM log GROUP BY ALL",
    "char_clean": f"WITH {EVENTS}, c AS (SELECT run_id, pos::INT AS pos, {_CLEANED} AS line FROM log) SELECT * FROM c WHERE line <> ''",
    "masked_dicts": """SELECT CAST(event_id AS VARCHAR) AS run_id, CASE WHEN event_id % 5 = 0 THEN 'x <MASK>' ELSE 'ev <MASK> end' END AS line, CASE WHEN event_id % 5 = 0 THEN 'outer,more' ELSE 'type,id' END AS keys,
CASE WHEN event_id % 5 = 0 THEN '{' || chr(39) || 'outer' || chr(39) || ': {' || chr(39) || 'inner' || chr(39) || ': ' || event_id || '}, ' || chr(39) || 'more' || chr(39) || ': True}' ELSE '{"type": "' || event_type || '", "id": ' || event_id || '}' END AS raw FROM events""",
    "stage_stats": f"WITH {EVENTS}, c AS (SELECT run_id, {_SANITIZED} AS line FROM log), a AS (SELECT run_id, count(*) AS lines_after, sum(length(line))::BIGINT AS chars_after FROM c WHERE line <> '' GROUP BY run_id) SELECT run_id, count(*) AS lines_before, sum(length(line))::BIGINT AS chars_before, any_value(coalesce(lines_after, 0)) AS lines_after, any_value(coalesce(chars_after, 0)) AS chars_after FROM log LEFT JOIN a USING (run_id) GROUP BY run_id",
    "pair_rows": f"""WITH {EVENTS}, p AS (SELECT run_id, pos, unnest(regexp_extract_all(line, '{_PAIR}', 1)) AS k, unnest(regexp_extract_all(line, '{_PAIR}', 2)) AS v FROM log)
SELECT run_id, pos::INT AS pos, k, v FROM p WHERE regexp_full_match(v, '{values.PLAIN_VALUE}')""",
    "pair_counts": f"""WITH {EVENTS}, p AS (SELECT run_id, unnest(regexp_extract_all(line, '{_PAIR}', 1)) AS k, unnest(regexp_extract_all(line, '{_PAIR}', 2)) AS v FROM log
UNION ALL SELECT run_id, unnest(list_distinct(regexp_extract_all(line, '{_COLON}', 1))) AS k, unnest(list_distinct(regexp_extract_all(line, '{_COLON}', 2))) AS v FROM log)
SELECT run_id, k, v, count(*) AS n FROM p WHERE regexp_full_match(v, '{values.PLAIN_VALUE}') OR regexp_matches(v, '^(/|[.]/|https?://)') GROUP BY run_id, k, v HAVING count(*) > 2""",
    "pair_line_merge": f"""WITH {EVENTS}, m AS (SELECT *, regexp_matches(line, '{_PAIR}') AS is_pair FROM log),
o AS (SELECT *, CASE WHEN is_pair AND coalesce(lag(is_pair) OVER w, false) THEN 0 ELSE 1 END AS o FROM m WINDOW w AS (PARTITION BY run_id ORDER BY pos)),
i AS (SELECT *, sum(o) OVER (PARTITION BY run_id ORDER BY pos) AS island FROM o)
SELECT run_id, min(pos)::INT AS pos, string_agg(CASE WHEN is_pair THEN trim(line) ELSE line END, ' | ' ORDER BY pos) AS line FROM i GROUP BY run_id, island""",
    "time_blocks": f"""WITH RECURSIVE {EVENTS}, p AS (SELECT run_id, pos, epoch(try_cast(nullif(regexp_extract(line, '^[0-9-]{{10}} [0-9:]{{8}}'), '') AS TIMESTAMP)) AS e FROM log),
z AS (SELECT run_id, arg_min(e, pos) AS zero FROM p WHERE e IS NOT NULL GROUP BY run_id),
s AS (SELECT run_id, pos, last_value(e IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS e FROM p),
t AS (SELECT run_id, pos, coalesce(e - zero, 0) AS rel FROM s LEFT JOIN z USING (run_id)),
g AS (SELECT run_id, pos, 0 AS block_no, rel AS since, false AS closed FROM t WHERE pos = 0
 UNION ALL SELECT t.run_id, t.pos, g.block_no + g.closed::INT, CASE WHEN t.rel - g.since >= 86400 THEN t.rel ELSE g.since END, t.rel - g.since >= 86400 FROM g JOIN t ON t.run_id = g.run_id AND t.pos = g.pos + 1)
SELECT run_id, block_no, (min(pos) + 1)::INT AS lo, (max(pos) + 1)::INT AS hi FROM g GROUP BY run_id, block_no""",
    "command_tracks": """WITH k AS (SELECT event_id % 7 = 0 AS in_shell, event_id % 10 AS form, CASE event_id % 10 WHEN 0 THEN 'git status -s ' || event_id WHEN 1 THEN 'cat file' || event_id WHEN 2 THEN 'python -c ' || event_id
 WHEN 3 THEN 'npm run dev ' || event_id WHEN 4 THEN 'sudo A=' || event_id || ' pytest -q' WHEN 5 THEN 'find x' || event_id WHEN 6 THEN 'make x' || event_id || ' && ls'
 WHEN 7 THEN 'uvicorn app' || event_id || ':main' WHEN 8 THEN './build' || event_id || '.sh' ELSE 'pip install p' || event_id END AS command FROM events)
SELECT command, in_shell, CASE form WHEN 6 THEN 'compound_command' WHEN 2 THEN '-c' WHEN 4 THEN 'pytest' WHEN 8 THEN command[3:] ELSE regexp_extract(command, '^[a-z]+') END AS base,
 CASE WHEN form IN (1, 2) THEN 'passthrough' WHEN form IN (3, 7) THEN 'daemon_warn' WHEN form = 4 THEN 'pytest_native' WHEN form IN (6, 8) OR in_shell THEN 'full_pipe' WHEN form = 5 THEN 'rtk_fast' ELSE 'rtk_lossless' END AS track FROM k""",
    "tensor_summary": "SELECT CAST(event_id AS VARCHAR) AS run_id, 'w = [Matrix: ndim=2, elements~=6, dtype=f' || event_id || ', device=cpu] b = [Matrix: ndim=1, elements~=1]' AS line FROM events",
    "trace_lines": f"""WITH {_FAULTS} SELECT CAST(user_id AS VARCHAR) AS run_id, (row_number() OVER w - 1)::INT AS pos, CASE WHEN bad THEN '[T' || n || '] ValueError' ELSE 'ok ' || event_id END AS line
FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "trace_records": f"""WITH {_FAULTS} SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(n AS VARCHAR) AS id, 'ValueError' AS summary,
'[T' || n || '] ValueError: ' || chr(39) || 'bad value ' || event_id || chr(39) || ' @ U:' || event_type || '.py:' || event_id || ' -> L:core.py:7' AS value FROM f WHERE bad""",
}
