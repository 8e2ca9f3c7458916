"""Substring dedup by repeated-phrase automata.

Of each 50-word window the least hashed ``GRAM``-word phrase is its anchor, so equal windows share it; consecutive windows with one
anchor make a passage. Anchors that stand in one document only are dropped. For the rest, passages are cut into phrases: runs of
windows that all stand in the same passages, so that a document that holds one window of a phrase holds the phrase. Their
words, taken from the first document of each, are the dictionary, dealt into shards by the first document that holds the anchor;
each shard is compiled into Aho-Corasick automata. Every document streams the stretches around its recurring anchors past the
shards that these belong to, and what the automata find there, word by word, is removed where the phrase's first document comes earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, written
from .rolling import between, prefix

WINDOW, GRAM = 50, 12
#: Bytes of phrases that an automaton holds, and of stretches that a task streams past it, about.
SHARD, STREAM = 4 << 20, 16 << 20
#: The table of shards, one row each, is broadcast up to so many.
MOST_BROADCAST = 100_000


class Passages:
    """The passages of one text: anchor, content hash, first window, number of windows."""

    def __init__(self, words: list[bytes], window: int = WINDOW, gram: int = GRAM):
        self.window = window
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        self.sums, at = prefix(h), np.arange(max(0, len(words) - gram + 1))
        grams = between(self.sums, at, at + gram)
        windows = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
        least = np.concatenate([windows[i : i + 65536].argmin(1) for i in range(0, len(windows), 65536)]) + np.arange(len(windows))
        self.start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        self.n = np.diff(np.r_[self.start, len(least)])
        self.anchor = grams[least[self.start]].view(np.int64)
        self.content = between(self.sums, self.start, self.start + self.n + window - 1).view(np.int64)

    def windows(self, at: int, n: int) -> np.ndarray:
        at = np.arange(at, at + n)
        return between(self.sums, at, at + self.window).view(np.int64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _all_passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each document's passages, each once."""
    for batch in batches:
        out = [np.empty((0, 3), np.int64)]
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            words = words_of(text)
            if len(words) >= WINDOW:
                p = Passages(words)
                own = np.stack([np.full(len(p.anchor), doc_id), p.anchor, p.content], 1)
                order = np.lexsort((p.content, p.anchor))
                own = own[order]
                out.append(own[np.r_[True, (own[1:] != own[:-1]).any(1)]])
        yield pd.DataFrame(np.concatenate(out), columns=["doc_id", "anchor", "content"])


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches of a document around the anchors asked for (kind 0, with the first document that holds the anchor), and the passages asked of it as their first document (1; to be cut: 2)."""
    for batch in batches:
        out: list[tuple] = []
        for doc_id, h, text, asked in zip(batch["doc_id"].tolist(), batch["h"].tolist(), batch["text"], batch["asked"], strict=True):
            words = words_of(text)
            if len(words) < WINDOW:  # a row that only shares another's doc_id
                continue
            p = Passages(words)
            sources, firsts = {x["anchor"]: x["a"] for x in asked if not x["kind"]}, {(x["anchor"], x["content"]): x for x in asked if x["kind"]}
            since, source = 0, None
            for at, n, key in zip([*p.start.tolist(), len(words)], [*p.n.tolist(), 0], [*zip(p.anchor.tolist(), p.content.tolist(), strict=True), (None, None)], strict=True):
                # passages that follow one another and have one source make one stretch
                now = sources.get(key[0])
                if source is not None and now != source:
                    out.append((source, 0, 0, 0, doc_id, h, since, 0, b" ".join(words[since : end + WINDOW - 1]), None))
                since, source, end = at if now != source else since, now, at + n
                if (x := firsts.pop(key, None)) is not None:
                    out.append((x["a"], *key, x["kind"], doc_id, h, at, x["last"], b" ".join(words[at : end + WINDOW - 1]), p.windows(at, n) if x["kind"] > 1 else None))
        yield pd.DataFrame(out, columns=["source", "anchor", "content", "kind", "doc_id", "h", "start", "last", "words", "windows"])


def _phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cut passages: of each, the runs of windows that stand in the same passages, kept by the passage that has the least of these names."""
    for batch in batches:
        out = []
        for source, content, words, windows in zip(batch["source"].tolist(), batch["content"].tolist(), batch["words"], batch["windows"], strict=True):
            words, run = words.split(b" "), None
            for x in [*windows, None]:
                if run is not None and (x is None or (x["place"], x["owner"], x["mark"]) != (run[1], run[2], run[3])):
                    if run[2] == content:
                        out.append((source, run[4], b" ".join(words[run[0] : run[1] + WINDOW - 1])))
                    run = None
                if x is not None:
                    run = (x["place"] if run is None else run[0], x["place"] + 1, x["owner"], x["mark"], x["first"])
        yield pd.DataFrame(out, columns=["source", "first", "words"])


def _locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by shard, a shard's phrases first. Windows found in a stretch of a document that comes after the phrase's first: where they begin, how many."""
    ids: dict[bytes, int] = {}
    phrases: list[tuple[list[bytes], int]] = []
    automaton, current = None, None

    def compiled() -> ahocorasick.Automaton:
        made, firsts = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), {}
        for words, first in phrases:
            code = tuple(ids.setdefault(w, len(ids) + 1) for w in words)
            firsts[code] = min(first, firsts.get(code, first))
        for code, first in firsts.items():
            made.add_word(code, (len(code), first))
        made.make_automaton()
        return made

    for batch in batches:
        out: list[tuple[int, ...]] = []
        for shard, doc_id, h, start, first, words in zip(batch["cell"].tolist(), batch["doc_id"].tolist(), batch["h"].tolist(), batch["start"].tolist(), batch["first"].tolist(), batch["words"], strict=True):
            if shard != current:
                ids, phrases, automaton, current = {}, [], None, shard
            words = words.split(b" ")
            if start < 0:
                phrases.append((words, int(first)))
                continue
            if not phrases:
                continue
            automaton = automaton or compiled()
            code = tuple(ids.get(w, 0) for w in words)
            for end, (n, first) in automaton.iter(code):
                if first < doc_id:
                    out.append((int(doc_id), int(h), int(start) + end - n + 1, n - WINDOW + 1))
        yield pd.DataFrame(out, columns=["doc_id", "h", "start", "n"]).drop_duplicates()


def _kept(words: list[bytes], gone: np.ndarray | None) -> tuple[int, int, bytes]:
    left = words if gone is None else [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
    return len(words), len(words) - len(left), b" ".join(left)


def _remove(batches: Iterator[pd.DataFrame], texts: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, found in zip(batch["text"], batch["found"], strict=True):
            words, gone = words_of(text), None
            if found is not None:
                edge = np.zeros(len(words) + 1, np.int64)
                for x in found:
                    edge[x["start"]] += 1
                    edge[x["start"] + x["n"] + WINDOW - 1] -= 1
                gone = np.cumsum(edge)[:-1] > 0
            out.append(_kept(words, gone))
        n, removed, kept = zip(*out, strict=True) if out else ([], [], [])
        what = {"kept_text": [k.decode() for k in kept]} if texts else {"kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
        yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": n, "n_removed": removed} | what)


def deduplicate_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: bool = True, shard_bytes: int = SHARD, stream_bytes: int = STREAM) -> DataFrame:
    """Remove each word covered by a 50-word window whose words also start in a document with a smaller doc_id.

    One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, and ``kept_text`` (kept words joined by one space) or,
    with ``texts=False``, its ``kept_sha256``. Windows are judged on the input. Null and empty texts have no words. A row
    without doc_id loses nothing and takes nothing from others. Rows of one doc_id take nothing from one another. Other columns are ignored;
    an empty table gives no rows. What goes is what an automaton found word by word; hashes only name candidates. No key's rows meet in one
    task: minima are pre-aggregated, joins are split by adaptive execution, a shard's phrases and stretches are dealt out as a grid.
    """
    texts_of = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    passages = written(texts_of.where("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(_all_passages, "doc_id long, anchor long, content long"), "passages")
    recurring = passages.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor", "a")
    recurring = written(join_hot(passages, recurring, ["anchor"]), "recurring")
    discard(passages)
    # passages of anchors with one passage are phrases as they stand; those of others are cut by their windows
    variants = recurring.groupBy("anchor", "content", "a").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    kinds = variants.groupBy("anchor").agg((F.count("*") > 1).alias("cut"))
    variants = written(join_hot(variants, kinds, ["anchor"]).where("cut OR first < last"), "variants")
    ask = lambda content, kind, last: F.struct("anchor", content.alias("content"), kind.alias("kind"), last.alias("last"), "a").alias("x")
    zero = F.lit(0).cast("long")
    wanted = recurring.where("doc_id > a").select("doc_id", ask(zero, F.lit(0), zero))
    wanted = wanted.union(variants.select(F.col("first"), ask(F.col("content"), F.when(F.col("cut"), 2).otherwise(1), F.col("last")))).groupBy("doc_id").agg(F.collect_list("x").alias("asked"))
    given = texts_of.join(wanted, "doc_id").select("doc_id", "h", "text", "asked").mapInPandas(_asked, "source long, anchor long, content long, kind int, doc_id long, h long, start int, last long, words binary, windows array<long>")
    given = written(given, "stretches")
    stretches = given.where("kind = 0").select("source", "doc_id", "h", "start", "words")
    whole, cut = given.where("kind = 1").select("source", F.col("doc_id").alias("first"), "words"), given.where("kind = 2")
    # a first document's repeated rows give its passages again, each window as often: marks still differ where passages do, and sets take each place once
    windows = cut.select("anchor", "content", "doc_id", "last", F.posexplode("windows").alias("place", "window"))
    mark = F.xxhash64(F.sum(F.xxhash64("content").cast("decimal(38,0)"))).alias("mark")
    same = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("first"), F.max("last").alias("last"), F.min("content").alias("owner"), mark).where("first < last").drop("last")
    each = join_hot(windows.select("anchor", "content", "place", "window"), same, ["anchor", "window"]).groupBy("anchor", "content").agg(F.sort_array(F.collect_set(F.struct("place", "first", "owner", "mark"))).alias("windows"))
    several = cut.select("source", "anchor", "content", "words").join(each, ["anchor", "content"]).mapInPandas(_phrases, "source long, first long, words binary")
    phrases = written(whole.union(several), "phrases")
    bytes_of = lambda df: df.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0]
    shards = max(1, bytes_of(phrases) // shard_bytes, bytes_of(stretches) // stream_bytes)
    shard = F.pmod(F.xxhash64("source"), F.lit(shards)).alias("shard")
    phrases, stretches = phrases.select("*", shard), stretches.select("*", shard)
    grid = phrases.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.length("words")) / (2 * shard_bytes))).cast("int").alias("gp"))
    grid = grid.join(stretches.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.length("words")) / (2 * stream_bytes))).cast("int").alias("gs")), "shard")
    if shards <= MOST_BROADCAST:
        grid = F.broadcast(grid)
    turn = lambda g, *of: F.pmod(F.xxhash64(*of), F.col(g))
    every = lambda g: F.explode(F.sequence(F.lit(0), F.col(g) - 1))
    dictionary = phrases.join(grid, "shard").select("shard", turn("gp", "words").cast("int").alias("p"), every("gs").alias("s"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("h"), F.lit(-1).alias("start"), "first", "words")
    stream = stretches.join(grid, "shard").select("shard", every("gp").alias("p"), turn("gs", "doc_id", "start").cast("int").alias("s"), "doc_id", "h", "start", F.lit(0).cast("long").alias("first"), "words")
    cell = F.xxhash64("shard", "p", "s").alias("cell")
    rows = dictionary.union(stream).select(cell, "doc_id", "h", "start", "first", "words").repartition(F.col("cell")).sortWithinPartitions("cell", "start")
    located = rows.mapInPandas(_locate, "doc_id long, h long, start int, n int")
    found = written(located.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "n")).alias("found")), "found")
    for table in (recurring, given, variants, phrases):
        discard(table)
    column = "kept_text" if texts else "kept_sha256"
    return texts_of.join(found, ["doc_id", "h"], "left").select("doc_id", "text", "found").mapInPandas(lambda b: _remove(b, texts), f"doc_id long, n_words long, n_removed long, {column} string")
