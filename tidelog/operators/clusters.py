"""Templates of log lines by a fixed-depth tree (Drain: He et al., ICWS 2017), and what rests on them.

The miner is online: a line's cluster depends on those before it, so a run's lines are folded in order; a run is one execution's log.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .lines import SCHEMA, _timeline

# What is masked before clustering, in this order, and where words break.
MASKS = (
    (r"^\d+\.?\d*s(?:\t|\s+)\d+(?:\t|\s+)", "KAGGLE_PREFIX"), (r"\x1b\[[0-9;]*m", "ANSI"), (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?\b", "TIMESTAMP"),
    (r"\b\d{2}:\d{2}:\d{2}(?:\.\d{3})?\b", "TIMESTAMP"), (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "IP"), (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "UUID"),
    (r"\b0x[0-9a-fA-F]+\b", "HEX"), (r"https?://\S+", "URL"), (r"/[\w./-]{4,}", "PATH"), (r"\b[0-9a-fA-F]{8,}\b", "HEX_LONG"), (r"\[(?:Rank|GPU)[-\s]?\d+\]", "RANK"),
    (r"\[#\d+\]", "SLUG"), (r"\[T\d+\]", "TRACE"),
)
DELIMITERS, ANY = "_:/.-", "<*>"
TEMPLATE = "run_id string, cluster int, template string, n long, samples array<string>"


@dataclass
class _Node:
    children: dict[str, _Node] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)


class Miner:
    """Groups messages whose words agree in at least ``least`` of their places; the tree branches on word count and first words."""

    def __init__(self, least: float = 0.7, depth: int = 4, most_children: int = 10, masks: tuple[tuple[str, str], ...] = MASKS):
        self.least, self.levels, self.most = least, depth - 2, most_children
        self.masks = [(re.compile(p), f"<:{name}:>") for p, name in masks]
        self.words: list[list[str]] = []
        self.root: dict[int, _Node] = {}

    def add(self, line: str) -> int:
        """The message's cluster, from 0."""
        for pattern, name in self.masks:
            line = pattern.sub(name, line)
        words = line.strip().translate(str.maketrans(DELIMITERS, " " * len(DELIMITERS))).split()
        found = self._match(words)
        if found is None:
            self.words.append(words)
            self._leaf(words).clusters.append(len(self.words) - 1)
            return len(self.words) - 1
        self.words[found] = [a if a == b else ANY for a, b in zip(words, self.words[found], strict=True)]
        return found

    def _match(self, words: list[str]) -> int | None:
        node = self.root.get(len(words))
        for word in words[: min(self.levels, len(words)) - 1] if words else ():
            node = node and (node.children.get(word) or node.children.get(ANY))
        best, rank = None, (-1.0, -1)
        for c in node.clusters if node else ():
            known = self.words[c]
            score = sum(a == b for a, b in zip(words, known, strict=True)) / len(words) if words else 1.0
            if (score, known.count(ANY)) > rank:
                best, rank = c, (score, known.count(ANY))
        return best if rank[0] >= self.least else None

    def _leaf(self, words: list[str]) -> _Node:
        node = self.root.setdefault(len(words), _Node())
        for word in words[: min(self.levels, len(words)) - 1] if words else ():
            if word not in node.children:
                room = self.most - len(node.children) - (ANY not in node.children)
                if any(map(str.isdigit, word)) or room < 1:
                    word = ANY
            node = node.children.setdefault(word, _Node())
        return node

    def template(self, cluster: int) -> str:
        return " ".join(self.words[cluster])


def mine(lines: list[str], **options) -> tuple[list[int], list[str]]:
    """Each line's cluster (blank: -1) and each cluster's template as it first stood."""
    miner, ids, templates = Miner(**options), [], []
    for line in lines:
        ids.append(miner.add(line) if line.strip() else -1)
        if ids[-1] == len(templates):
            templates.append(miner.template(ids[-1]))
    return ids, templates


def cluster_lines(lines: DataFrame, least: float = 0.7, depth: int = 4, most_children: int = 10) -> DataFrame:
    """``run_id``, ``pos``, ``line``, ``cluster`` (blank and null lines: -1) and its ``template`` (then null)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        ids, templates = mine(pdf["line"].fillna("").tolist(), least=least, depth=depth, most_children=most_children)
        return pdf.assign(cluster=ids, template=[templates[i] if i >= 0 else None for i in ids])

    return lines.select("run_id", "pos", "line").groupBy("run_id").applyInPandas(fold, SCHEMA + ", cluster int, template string")


def templates(clustered: DataFrame) -> DataFrame:
    """Each cluster's template, how many lines it holds and the first two of them."""
    rank = F.row_number().over(Window.partitionBy("run_id", "cluster").orderBy("pos"))
    two = F.sort_array(F.collect_list(F.when(F.col("rank") <= 2, F.struct("pos", "line"))))
    out = clustered.where("cluster >= 0").withColumn("rank", rank).groupBy("run_id", "cluster")
    return out.agg(F.first("template").alias("template"), F.count("*").alias("n"), F.transform(two, lambda x: x["line"]).alias("samples"))


def _linked(ids: list[int], pairs: np.ndarray) -> list[int]:
    """The smallest id that each is linked to; pairs: places in ids."""
    least = np.array(ids)
    while len(pairs):
        before = least.copy()
        np.minimum.at(least, pairs[:, 0], before[pairs[:, 1]])
        np.minimum.at(least, pairs[:, 1], before[pairs[:, 0]])
        if (least == before).all():
            break
    return least.tolist()


def _shared_words(words: list[list[str]], weigh) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of templates that share a word, found by lists of the templates that hold each, and their summed weights."""
    holders: dict[str, list[int]] = {}
    sums: Counter = Counter()
    for i, bag in enumerate(words):
        for w, n in Counter(bag).items():
            for j, m in holders.get(w, ()):
                sums[j, i] += weigh(w, n, m)
            holders.setdefault(w, []).append((i, n))
    return np.array(list(sums), np.int64).reshape(-1, 2), np.array(list(sums.values()), float)


def _by_jaccard(words: list[list[str]], least: float) -> np.ndarray:
    pairs, both = _shared_words([sorted(set(x)) for x in words], lambda w, n, m: 1)
    size = np.array([len(set(x)) for x in words])
    empty = np.flatnonzero(size == 0)
    alike = pairs[both / (size[pairs].sum(1) - both) >= least] if len(pairs) else pairs
    return np.concatenate([alike, np.stack([np.repeat(empty[:1], max(0, len(empty) - 1)), empty[1:]], 1)])


def _by_weights(words: list[list[str]], least: float) -> np.ndarray:
    """Cosine of counts times smoothed inverse document frequencies, ln((1 + n) / (1 + df)) + 1."""
    df = Counter(w for x in words for w in set(x))
    idf = {w: math.log((1 + len(words)) / (1 + n)) + 1 for w, n in df.items()}
    pairs, dot = _shared_words(words, lambda w, n, m: n * m * idf[w] ** 2)
    norm = np.array([math.sqrt(sum((n * idf[w]) ** 2 for w, n in Counter(x).items())) for x in words])
    return pairs[dot / norm[pairs].prod(1) >= least - 1e-12] if len(pairs) else pairs


#: How templates are likened, and the words that they are likened by.
LIKENESS = {"jaccard": _by_jaccard, "weights": _by_weights}


def similar_templates(found: DataFrame, least: float = 0.85, how: str = "jaccard") -> DataFrame:
    """Templates with the smallest cluster they are linked to by pairs of like words, within a run.

    ``jaccard``: shared words over all; ``weights``: cosine of words weighted by their rarity among the run's templates. Only pairs that
    share a word are compared; templates without words are all alike by Jaccard.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        pairs = LIKENESS[how]([list(x) for x in pdf["words"]], least)
        return pdf[["run_id", "cluster"]].assign(merged=_linked(pdf["cluster"].tolist(), pairs))

    bare = F.regexp_replace(F.regexp_replace("template", r"<:[A-Z_]+:>|<\*>", " "), r"\s+", " ")
    words = t.tokens(bare) if how == "jaccard" else F.regexp_extract_all(F.lower(normalised(F.col("template"))), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    return found.select("run_id", "cluster", words.alias("words")).groupBy("run_id").applyInPandas(fold, "run_id string, cluster int, merged int")


def normalised(template: Column) -> Column:
    """A template with its named masks as ``<MASK>`` (and the bracket that closes them)."""
    return F.regexp_replace(template, r"<:[^:]*:", "<MASK>")


def templates_used(clustered: DataFrame) -> DataFrame:
    return clustered.where("cluster >= 0").groupBy("run_id").agg(F.countDistinct("cluster").alias("templates"))


# Beginnings of lines that stay as they are; words of the payload's head.
PROTECTED = r"^(?:\[TRACEBACK\]|CTX |WARN:|ERR:|METRIC)"
HEAD = ("## DRAIN dedup timeline (RLE, no deletion)", "(temporal/structural strip applied before clustering)", "(frequent-only RLE: unique lines emitted verbatim)")


def inline_timeline(clustered: DataFrame, rare: int = 2, show_rare: bool = True) -> DataFrame:
    """Lines by their templates, ``first`` and ``line``: repeats as ``[xN] <DRAIN:cluster> template``, lines of rare clusters as template and sample.

    Protected lines stay as they are where no repeat is under way. Blank lines go.
    """
    w = Window.partitionBy("run_id").orderBy("pos")
    cluster = Window.partitionBy("run_id", "cluster")
    kept = clustered.withColumn("opens", F.when(F.col("cluster") == F.lag("cluster").over(w), 0).otherwise(1)).withColumn("island", F.sum("opens").over(w))
    kept = kept.where("cluster >= 0").withColumns({"held": F.count("*").over(cluster), "sample": F.first("line").over(cluster.orderBy("pos")), "guarded": F.col("line").rlike(PROTECTED)})
    since = F.min(F.when(~F.col("guarded"), F.col("pos"))).over(Window.partitionBy("run_id", "island"))
    kept = kept.withColumns({"scarce": (F.col("held") <= rare) if show_rare else F.lit(False), "raw": F.col("guarded")}).withColumn("raw", F.col("raw") & (F.col("scarce") | F.coalesce(F.col("pos") < since, F.lit(True))))
    alone = F.when(F.col("raw") | F.col("scarce"), F.col("pos"))
    out = kept.groupBy("run_id", "island", alone.alias("alone")).agg(F.min("pos").alias("first"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("cluster", "template", "sample", "raw", "scarce")], F.min_by("line", "pos").alias("line"))
    shown = normalised(F.col("template"))
    text = F.when(F.col("raw"), F.col("line")).when(F.col("scarce"), F.concat(shown, F.lit("\n  sample: "), F.col("sample"))).otherwise(F.concat(F.format_string("[x%d] <DRAIN:%d> ", "n", "cluster"), shown))
    return out.select("run_id", "first", "n", text.alias("line"))


def payload(rows: DataFrame, stripped: bool = True, frequent_only: bool = True) -> DataFrame:
    """Each run's timeline rows (``first``, ``line``) as one text under a head that says how it was made."""
    head = "\n".join([HEAD[0], *[HEAD[1]] * stripped, *[HEAD[2]] * frequent_only])
    order = F.transform(F.sort_array(F.collect_list(F.struct("first", "line"))), lambda x: x["line"])
    return rows.groupBy("run_id").agg(F.concat(F.lit(head + "\n"), F.array_join(order, "\n")).alias("text"))


# How a template marks what varies.
MASK = re.compile(r"<:([^:>]+):>|<\*>")


def _fixed(text: str) -> str:
    """A pattern for what stands between a template's masks; any white space may stand for its own."""
    space = r"\s+"
    return space * text[:1].isspace() + space.join(map(re.escape, text.split())) + space * bool(text.strip() and text[-1:].isspace())


def _pattern(template: str) -> tuple[re.Pattern | None, list[str]]:
    """What a template's masks stand for in a line, and the masks' names."""
    masks = list(MASK.finditer(template))
    ends = [0, *(x for m in masks for x in m.span()), len(template)]
    between = [_fixed(template[a:b]) for a, b in zip(ends[::2], ends[1::2], strict=True)]
    return (re.compile("^" + "(.+?)".join(between) + "$") if masks else None), [(m[1] or "*").lower() for m in masks]


def line_parameters(line: str | None, template: str | None) -> dict[str, str] | None:
    """What a line has where its template has masks, by the masks' names; others, and names that come again, are numbered."""
    pattern, names = _pattern(template or "")
    m = pattern.match(line or "") if pattern else None
    out: dict[str, str] = {}
    for i, (name, value) in enumerate(zip(names, m.groups(), strict=True) if m else ()):
        out[f"val_{i}" if name == "*" or name in out else name] = value
    return out or None


def template_parameters(clustered: DataFrame, short: bool = True) -> DataFrame:
    """Records of what lines have where their templates have masks: each run's distinct objects once, with the hash of their JSON as ``id``.

    Also ``cluster``: the cluster whose first object it is, or null.
    """
    run = F.pandas_udf(lambda xs, ts: pd.Series([json.dumps(p, ensure_ascii=False, sort_keys=True) if (p := line_parameters(x, y)) else None for x, y in zip(xs, ts, strict=True)], dtype=object), "string")
    found = clustered.where("cluster >= 0").withColumn("value", run("line", "template")).where("value IS NOT NULL")
    id_ = F.upper(F.substring(F.sha2("value", 256), 1, 3 if short else 8))
    found = found.select("run_id", "pos", "cluster", id_.alias("id"), "value")
    keys = F.json_object_keys("value")
    held = found.groupBy("run_id", "id").agg(F.min("pos").alias("pos"), F.min_by("value", "pos").alias("value"))
    firsts = found.groupBy("run_id", "cluster").agg(F.min_by("id", "pos").alias("id"))
    each = held.join(firsts, ["run_id", "id"], "left")
    summary = F.format_string("drain params (%d vals)", F.size(keys))
    return each.select("run_id", "id", (F.col("pos") + 1).alias("line_no"), F.lit("drain").alias("kind"), summary.alias("summary"), F.slice(keys, 1, 5).alias("keys"), "value", F.length("value").alias("size"), "cluster")


def pointerise(rows: DataFrame, parameters: DataFrame, form: str = "[#%s]") -> DataFrame:
    """Timeline rows with ``cluster``: masks give way to pointers to the first object of the row's cluster; clusters without one stay."""
    first = parameters.where("cluster IS NOT NULL").select("run_id", "cluster", F.format_string(form, "id").alias("mark"))
    joined = rows.join(first, ["run_id", "cluster"], "left")
    return joined.withColumn("line", F.when(F.col("mark").isNull(), F.col("line")).otherwise(F.regexp_replace("line", F.lit(r"<:[^:>]+:>|<MASK>>?|<\*>"), F.col("mark")))).drop("mark")


def merge_records(own: DataFrame, more: DataFrame) -> DataFrame:
    """Records, and of the others those whose id a run does not have yet."""
    return own.unionByName(more.select(*own.columns).join(own.select("run_id", "id"), ["run_id", "id"], "left_anti").select(*own.columns))


def template_runs(clustered: DataFrame, frequent_only: bool = True) -> DataFrame:
    """Lines of one cluster that follow one another as one row: ``first``, ``n``, ``cluster`` and ``[xN] template``; lone lines as they are."""
    w = Window.partitionBy("run_id").orderBy("pos")
    opens = F.when((F.col("cluster") >= 0) & (F.col("cluster") == F.lag("cluster").over(w)), 0).otherwise(1)
    islands = clustered.withColumn("opens", opens).withColumn("island", F.sum("opens").over(w))
    out = islands.groupBy("run_id", "island").agg(F.min("pos").alias("first"), F.count("*").alias("n"), F.min_by("line", "pos").alias("line"), F.first("template").alias("template"), F.first("cluster").alias("cluster"))
    lone = F.col("line") if frequent_only else F.coalesce("template", "line")
    shown = F.when(F.col("n") > 1, F.concat(F.lit("[x"), F.col("n").cast("string"), F.lit("] "), "template")).otherwise(lone)
    return out.select("run_id", "first", "n", "cluster", shown.alias("line"))


def project(lines: DataFrame, longest: int = 4, least: float = 0.7, depth: int = 4) -> DataFrame:
    """Repeats of one line, then of sequences of 2 to ``longest`` lines of the same clusters, as one row each.

    Lines are clustered by what is left of them without names of hosts, punctuation and digits; the originals are shown.
    """
    keyed = lines.select("run_id", "pos", "line", t.one_space(F.col("line")).alias("key"), t.cluster_mask(F.col("line")).alias("masked"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        ids, _ = mine(pdf["masked"].fillna("").tolist(), least=least, depth=depth)
        return _timeline(pdf.assign(cluster=[str(i) if i >= 0 else "" for i in ids]), longest)

    return keyed.groupBy("run_id").applyInPandas(fold, "run_id string, first int, n long, line string")
