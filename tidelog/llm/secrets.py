"""Secret scans over a trigram inverted index, in DataFrame functions alone.

From each rule's pattern a Boolean query over lower-case trigrams is derived: what every match must hold. The index has, for
each block of 4096 consecutive doc_ids, the posting list of each trigram that some query names. Postings are intersected
within a conjunction and united over the alternatives; the candidates are verified by the pattern itself. A rule whose
matches need hold no trigram scans every text. Matches are rows of a few numbers: where a span begins is a running sum over them,
and texts themselves are read where they lie.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, written

KEYWORDS = "|".join(["[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]", "[Pp][Aa][Ss][Ss][Ww][Dd]", "[Ss][Ee][Cc][Rr][Ee][Tt]", "[Tt][Oo][Kk][Ee][Nn]", "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"])
KEY_BEGIN, KEY_END, CODE = "-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", "-{5,}END [A-Z ]{0,32}PRIVATE KEY-----", "[A-Za-z0-9+/=]"
#: A token of base64: 20 characters or more. Spelt out, as RE2 multiplies nested counts.
LONG = CODE * 20 + CODE + "*"
#: From BEGIN to its END, with no other five dashes between; without END, headers and the base64 that follows: whole lines, or up to
#: 200 tokens with other marks between (indents, quotes, escapes), and a short last line. Java recurs for each turn of a group, so the
#: groups have bounds; the characters of a body and the lines of base64 have none.
PRIVATE_KEY = (
    f"{KEY_BEGIN}(?:[^-]*(?:--?-?-?[^-]+){{0,500}}{KEY_END}"
    f"|(?:\\s*[A-Za-z-]+: [^\\r\\n]*){{0,8}}(?:[\\r\\n][A-Za-z0-9+/=\\r\\n]*{LONG}|(?:[^A-Za-z0-9+/=]+{LONG}){{1,200}})(?:\\r?\\n{CODE}{{1,19}}(?:\\r?\\n|$))?)?"
)
#: kind, pattern (for Java, RE2 and Python alike), group that is measured, its least length; spans sort by this order too.
RULES = [
    ("assign", f"({KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),  # of all runs, those of 16 or more
    ("private_key", PRIVATE_KEY, 0, 0),
    ("code_host", "gh[opsu]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("cloud_key", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("web_token", "eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}", 0, 0),
    ("url_login", "[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+-]+@", 0, 0),
]
BASE = ("assign", "access", "hex")
BLOCK_BITS, MOST_STRINGS, CUTS = 12, 64, 128


def _minimal(query: set[frozenset[str]]) -> set[frozenset[str]]:
    return {x for x in query if not any(y < x for y in query)}


def _all_of(*queries: set[frozenset[str]]) -> set[frozenset[str]]:
    out = {frozenset()}
    for query in queries:
        joined = _minimal({a | b for a in out for b in query})
        out = joined if len(joined) <= MOST_STRINGS else out
    return out


def _of_strings(strings: set[str]) -> set[frozenset[str]]:
    return _minimal({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def trigram_query(pattern: str) -> set[frozenset[str]]:
    """What each match's lower-cased text holds: all trigrams of one set at least. {frozenset()}: nothing is mandatory."""

    def walk(items) -> tuple[set[str] | None, set[frozenset[str]]]:
        """The strings that match, if they are few; else a query."""
        done, run = [], {""}
        for op, arg in items:
            name, strings, query = str(op), None, {frozenset()}
            if name == "LITERAL":
                strings = {chr(arg).lower()}
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                strings = {chr(c).lower() for _, c in arg}
            elif name == "SUBPATTERN":
                strings, query = walk(arg[3])
            elif name == "BRANCH":
                ways = [walk(x) for x in arg[1]]
                strings = set().union(*(s for s, _ in ways)) if all(s is not None for s, _ in ways) else None
                query = _minimal(set().union(*(_of_strings(s) if s is not None else q for s, q in ways)))
            elif name.endswith("REPEAT"):
                least, most, inner = arg
                strings, query = walk(inner)
                if (least, most) == (0, 1) and strings is not None:
                    strings = strings | {""}
                elif least == 0:
                    strings, query = None, {frozenset()}
                elif (least, most) != (1, 1):
                    strings, query = None, _of_strings(strings) if strings is not None else query
            elif name == "AT":
                strings = {""}
            joined = {a + b for a, b in product(run, strings)} if strings is not None and len(strings) * len(run) <= MOST_STRINGS else None
            if joined is not None:
                run = joined
            else:
                done += [_of_strings(run), _of_strings(strings) if strings is not None else query]
                run = {""}
        return (run, set()) if not done else (None, _all_of(*done, _of_strings(run)))

    strings, query = walk(re._parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def any_of(trigrams: list[str]) -> str:
    """A pattern that, wherever one of the trigrams begins, has it as its first group; each place is looked at once."""
    heads = sorted({t[0] for t in trigrams})
    return "(?=(" + "|".join(f"{re.escape(c)}(?:{'|'.join(re.escape(t[1:]) for t in sorted(trigrams) if t[0] == c)})" for c in heads) + "))"


def build_index(docs: DataFrame, trigrams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``block``, ``trigram``, ``postings``: the doc_ids of the block whose lower-cased text holds it.

    Null texts and doc_ids are in no posting list.
    """
    held = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(any_of(trigrams)), F.lit(1)))
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.explode(held).alias("trigram"))
    return rows.groupBy(F.shiftright("doc_id", BLOCK_BITS).alias("block"), "trigram").agg(F.collect_set("doc_id").alias("postings"))


def candidates(index: DataFrame, queries: list[set[frozenset[str]]]) -> DataFrame:
    """``doc_id`` and ``rules``, a bit for each query that its postings satisfy; queries without trigrams are left out."""
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "postings"))).alias("lists"))
    none = F.array().cast("array<long>")
    get = lambda t: F.coalesce(F.col("lists")[t], none)
    hits = []
    for bit, query in enumerate(queries):
        if frozenset() not in query:
            ids = reduce(F.array_union, [reduce(F.array_intersect, [get(t) for t in sorted(c)]) for c in sorted(query, key=sorted)])
            hits.append(F.transform(ids, (lambda mark: lambda x: F.struct(x.alias("doc_id"), mark.alias("rule")))(F.lit(1 << bit))))
    return blocks.select(F.explode(F.flatten(F.array(*hits))).alias("x")).groupBy("x.doc_id").agg(F.bit_or("x.rule").alias("rules"))


def _matches(text: Column, rules: list[tuple[str, str, int, int]], wanted: Column) -> Column:
    """Leftmost non-overlapping matches of the rules whose bits are set: rule, number, length of the gap before, of the match, of what is measured."""
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,hit:int,n:int>>")

    def of(kind: int, pattern: str, group: int) -> Column:
        hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
        measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
        zipped = F.filter(F.arrays_zip(hits.alias("hit"), measured.alias("value"), gaps.alias("gap")), lambda x: x["hit"].isNotNull())
        return F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["value"]).alias("n")))

    each = [F.when(wanted.bitwiseAND(F.lit(1 << k)) != 0, F.coalesce(of(k, p, g), none)).otherwise(none) for k, (_, p, g, _) in enumerate(rules)]
    return F.flatten(F.array(*each))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[tuple[str, str, int, int]] | None = None) -> DataFrame:
    """``doc_id``, ``h`` (hash of the text), ``start``, ``kind`` (its place in ``rules``) and ``end`` of each span; places count code points.

    Null and empty texts have no spans. Rows without doc_id aren't in the index: every rule scans them. Rows that share a
    doc_id share their candidates; each is verified by its own text, and rows alike in both give their spans once. An empty table
    gives no rows. The candidates are written first, so the planner knows their size when it chooses how they meet the texts.
    """
    rules = rules or RULES
    queries = [trigram_query(pattern) for _, pattern, _, _ in rules]
    trigrams = sorted(set().union(*(c for q in queries for c in q)))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    always = sum(1 << i for i, q in enumerate(queries) if frozenset() in q)
    hash_of, every = F.xxhash64("text").alias("h"), F.lit((1 << len(rules)) - 1)
    unindexed = F.when(F.col("doc_id").isNull(), every).otherwise(F.lit(always))
    hits = texts.select("doc_id", hash_of, F.inline(_matches(F.col("text"), rules, unindexed)))
    if trigrams:
        found = written(candidates(build_index(texts, trigrams), queries), "candidates")
        hits = hits.union(texts.join(found, "doc_id").select("doc_id", hash_of, F.inline(_matches(F.col("text"), rules, F.col("rules")))))
    own = Window.partitionBy("doc_id", "h", "kind").orderBy("i")
    placed = hits.dropDuplicates(["doc_id", "h", "kind", "i"]).withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(own).cast("int"))
    least = F.element_at(F.array(*[F.lit(n) for _, _, _, n in rules]), F.col("kind") + 1)
    return placed.where(F.col("n") >= least).select("doc_id", "h", (F.col("end") - F.col("hit")).alias("start"), "kind", "end")


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, counts of the base kinds, SHA-256 of the base spans, and all spans as ``kind:start:end``, comma-joined."""
    base = F.filter("s.spans", lambda x: x["kind"] < len(BASE))
    names = F.array(*[F.lit(r[0]) for r in RULES])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    count = lambda i: F.coalesce(F.size(F.filter("s.spans", lambda x: x["kind"] == i)), F.lit(0)).cast("long")
    none = F.lit("")
    each = scan(docs, doc_id, text).groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"))
    found = rows.alias("d").join(each.alias("s"), F.expr("d.doc_id <=> s.doc_id AND d.h = s.h"), "left")
    return found.select("d.doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(F.coalesce(joined(base), none).cast("binary"), 256).alias("base_sha256"), F.coalesce(joined(F.col("s.spans")), none).alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each secret replaced by a mark; spans that overlap get one mark. Texts without secrets stay as they are.

    All rows and columns stay, whatever their names; rows without doc_id are masked like any other; an empty table gives no rows.
    """
    before = Window.partitionBy("doc_id", "h").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce((F.col("start") >= F.max("end").over(before)).cast("int"), F.lit(1))
    spans = scan(docs, doc_id, text).withColumn("opens", opens)
    islands = spans.withColumn("island", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "h", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    since = F.coalesce(F.lag("end").over(Window.partitionBy("doc_id", "h").orderBy("island")), F.lit(0)).alias("since")
    cuts = islands.select("doc_id", "h", since, "start", "end").groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("since", "start", "end"))).alias("cuts"))
    id_, h, found = free_names(docs, 3)
    cuts = written(cuts.select(F.col("doc_id").alias(id_), F.col("h").alias(h), F.col("cuts").alias(found)), "secrets")
    joined = docs.alias("d").join(cuts.alias("s"), F.col(f"d.`{doc_id}`").eqNullSafe(F.col(f"s.{id_}")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col(f"s.{h}")), "left")
    whole, spots = F.col(f"d.`{text}`"), F.col(f"s.{found}")
    # places are found by counting characters from the front, so stretches of CUTS cuts are taken out first
    some = F.transform(F.sequence(F.lit(1), F.size(spots), F.lit(CUTS)), lambda k: F.slice(spots, k, CUTS))
    parts = F.transform(some, lambda c: F.struct(c.alias("cuts"), F.substring(whole, c[0]["since"] + 1, F.element_at(c, -1)["end"] - c[0]["since"]).alias("text")))
    gap = lambda p, x: F.substring(p["text"], x["since"] - p["cuts"][0]["since"] + 1, x["start"] - x["since"])
    kept = F.array_join(F.transform(parts, lambda p: F.array_join(F.transform(p["cuts"], lambda x: F.concat(gap(p, x), F.lit(mark))), "")), "")
    clean = F.concat(kept, F.substring(whole, F.element_at(spots, -1)["end"] + 1, F.length(whole)))
    return joined.select(*[F.when(spots.isNotNull(), clean).otherwise(whole).alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns])


def oracle(documents: str = "documents") -> str:
    """The rows of ``find_secrets`` as DuckDB SQL."""
    ctes = []
    for i, (kind, pattern, group, least) in enumerate(RULES):
        p = "'" + pattern.replace("'", "''") + "'"
        ctes.append(
            f"""k{i} AS (SELECT doc_id, start, {i} AS kind, start + length(hit) AS stop, '{kind}' AS name FROM (
  SELECT doc_id, hit, value, sum(length(gap) + coalesce(length(before), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS start FROM (
    SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(vals) AS value, unnest(gaps[:len(hits)]) AS gap, unnest(list_prepend(NULL, hits)[:len(hits)]) AS before
    FROM (SELECT doc_id, regexp_extract_all(text, {p}, 0) AS hits, regexp_extract_all(text, {p}, {group}) AS vals, string_split_regex(text, {p}) AS gaps FROM {documents})))
  WHERE length(value) >= {least})"""
        )
    union = " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(len(RULES)))
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(BASE))
    span = "concat_ws(':', name, CAST(CAST(start AS BIGINT) AS VARCHAR), CAST(CAST(stop AS BIGINT) AS VARCHAR))"
    return f"""WITH {", ".join(ctes)}, spans AS ({union}), found AS (
  SELECT doc_id, {counts}, string_agg({span}, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS base, string_agg({span}, ',' ORDER BY start, kind) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM {documents} d LEFT JOIN found f ON d.doc_id = f.doc_id"""
