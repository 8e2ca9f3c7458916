"""Embedding near-dedup by product quantisation.

Unit vectors go to inverted lists: cells around coarse centroids, each cut, for large tables, by a second set of centroids that all
cells share. What the centroids leave is coded in subspaces. Codes are sent to every list whose cell may hold something within
the distance that the cosine allows: by the triangle inequality no other list can. There, each vector of the list holds its table
of products with all codes against the coded ones; one is ruled out only where its table distance exceeds the allowed one by
more than its own coding error. Whole vectors are fetched for what is left alone, and their exact cosines decide, so no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, written
from .components import connected_components

COSINE, SEED = 0.98, 5
#: Vectors that centroids and codes are fitted on, at most; centroids of each of the two levels, at most; subspaces; codes; members and queries in a task's block.
MAX_TRAIN, CENTROIDS, SUBSPACES, CODES, BLOCK = 20_000, 1024, 8, 256, 2048
#: Members of a list that travel as one row, at most; what each member takes.
PACK, PACKED = 512, np.dtype([("node", "<i8"), ("list", "<i4"), ("error", "<f4"), ("code", "u1", SUBSPACES)])


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Quantiser:
    """Centroids of two levels and residual codebooks for vectors of one length."""

    def __init__(self, x: np.ndarray, coarse: int, fine: int = 1):
        self.coarse = k_means(x, coarse)
        rest = x - self.coarse[_nearest(x, self.coarse)]
        self.fine = k_means(rest, fine) if fine > 1 else np.zeros((1, x.shape[1]))
        rest = rest - self.fine[_nearest(rest, self.fine)]
        self.cuts = [(int(p[0]), int(p[-1]) + 1) for p in np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))]
        self.codes = [k_means(rest[:, a:b], CODES) for a, b in self.cuts]

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def assign(self, x: np.ndarray) -> np.ndarray:
        i = _nearest(x, self.coarse)
        return i * len(self.fine) + _nearest(x - self.coarse[i], self.fine)

    @staticmethod
    def _cells(x: np.ndarray, c: np.ndarray, home: np.ndarray, reach: float) -> np.ndarray:
        """Cells of centroids c that come within ``reach`` of each vector, as a boolean matrix."""
        far = (c * c).sum(1)[None] - 2 * x @ c.T
        apart = np.sqrt(np.maximum(((c[home][:, None] - c[None]) ** 2).sum(2), 0))
        # the border between the home cell and another is the plane halfway between their centroids
        return far - far[np.arange(len(x)), home][:, None] <= 2 * apart * (reach + 1e-6)

    def probes(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a vector and a list that may hold something within ``reach`` of it."""
        v, i = np.nonzero(self._cells(x, self.coarse, _nearest(x, self.coarse), reach))
        if len(self.fine) == 1:
            return v, i
        rest, out = x[v] - self.coarse[i], []
        for at in range(0, len(rest), 512):
            part = rest[at : at + 512]
            k, j = np.nonzero(self._cells(part, self.fine, _nearest(part, self.fine), reach))
            out.append(np.stack([v[at + k], i[at + k] * len(self.fine) + j]))
        v, i = np.concatenate(out, 1) if out else np.empty((2, 0), np.int64)
        return v, i

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each vector's residual, and how far the coded vector is from it."""
        rest = x - self.centre(home)
        code = np.zeros((len(x), SUBSPACES), np.uint8)
        for s, ((a, b), book) in enumerate(zip(self.cuts, self.codes, strict=True)):
            code[:, s] = _nearest(rest[:, a:b], book)
        return code, np.sqrt(((x - self.decode(home, code)) ** 2).sum(1))

    def decode(self, home: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.centre(home) + np.concatenate([book[code[:, s]] for s, book in enumerate(self.codes)], 1)

    def distances(self, x: np.ndarray, home: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Asymmetric distances from whole vectors to coded ones of any lists, summed from each vector's table of products with the codes."""
        centres, which = np.unique(home, return_inverse=True)
        out = (x @ self.centre(centres).T).astype(np.float32)[:, which]
        for s, ((a, b), book) in enumerate(zip(self.cuts, self.codes, strict=True)):
            out += (x[:, a:b] @ book.T).astype(np.float32)[:, code[:, s]]
        coded = self.decode(home, code)
        return np.sqrt(np.maximum((x * x).sum(1)[:, None].astype(np.float32) + (coded * coded).sum(1)[None].astype(np.float32) - 2 * out, 0))


def _unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors times powers of two, so that no square over- or underflows, and unit vectors."""
    x = np.stack(vectors.to_list()).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x, x / np.sqrt((x * x).sum(1))[:, None]


def _home(batches: Iterator[pd.DataFrame], models: dict[int, Quantiser]) -> Iterator[pd.DataFrame]:
    """Each vector's own list."""
    for batch in batches:
        for size, part in batch.groupby(batch["embedding"].map(len)):
            yield part.assign(dim=size, list=models[size].assign(_unit(part["embedding"])[1]))


def _probe(batches: Iterator[pd.DataFrame], models: dict[int, Quantiser], reach: float) -> Iterator[pd.DataFrame]:
    """Codes of vectors for each list that they probe, packed."""
    for batch in batches:
        for (size, label), part in batch.groupby([batch["embedding"].map(len), "label"]):
            model, packs = models[size], []
            for at in range(0, len(part), 1024):
                rows = part.iloc[at : at + 1024]
                x, home = _unit(rows["embedding"])[1], rows["list"].to_numpy()
                own = np.empty(len(rows), PACKED)
                own["node"], own["list"] = rows["node"], home
                own["code"], own["error"] = model.encode(x, home)
                v, lists = model.probes(x, reach)
                packs.append((lists, own[v]))
            lists, own = (np.concatenate(c) for c in zip(*packs, strict=True))
            order = np.argsort(lists, kind="stable")
            lists, own = lists[order], own[order]
            cuts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
            cuts = np.concatenate([np.arange(a, b, PACK) for a, b in zip(cuts, np.r_[cuts[1:], len(lists)], strict=True)])
            packed = [own[a:b].tobytes() for a, b in zip(cuts, np.r_[cuts[1:], len(lists)], strict=True)]
            yield pd.DataFrame({"label": label, "dim": size, "list": lists[cuts], "n": np.diff(np.r_[cuts, len(lists)]), "salt": own["node"][cuts], "pack": packed})


def _local(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least reachable of n places by links a-b."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _survivors(pdf: pd.DataFrame, models: dict[int, Quantiser], reach: float) -> pd.DataFrame:
    """One block of a list: the members and the queries that the tables leave a pair of."""
    packs, queries = pdf["pack"].dropna(), pdf[pdf["pack"].isna()]
    where = {c: pdf[c].iat[0] for c in ("label", "dim", "list", "bm", "bq")}
    out = []
    if len(packs) and len(queries):
        model = models[int(where["dim"])]
        members = np.frombuffer(b"".join(packs), PACKED)
        for at in range(0, len(queries), 512):
            part = queries.iloc[at : at + 512]
            ids = part["node"].to_numpy(np.int64)
            near = model.distances(_unit(part["embedding"])[1], members["list"], members["code"]) <= reach + members["error"][None] + 1e-3
            near &= ids[:, None] != members["node"][None]
            out += [(x, False) for x in ids[near.any(1)].tolist()] + [(x, True) for x in members["node"][near.any(0)].tolist()]
    found = pd.DataFrame(out, columns=["node", "member"]).drop_duplicates()
    return found.assign(**where)


def _rerank(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """One block's survivors: each query's number of links by exact cosine, and links that connect what the block connects."""
    members, queries, out = pdf[pdf["member"]], pdf[~pdf["member"]], []
    if len(members) and len(queries):
        m, mid, weight = _unit(members["embedding"])[0], members["node"].to_numpy(), members["n"].to_numpy()
        size = np.sqrt((m * m).sum(1))
        for at in range(0, len(queries), 512):
            q, qid = _unit(queries["embedding"].iloc[at : at + 512])[0], queries["node"].to_numpy()[at : at + 512]
            cosine = (q @ m.T) / (np.sqrt((q * q).sum(1))[:, None] * size[None])
            # sums of products in another order may differ in the last places: those near the border are summed again, one by one
            i, j = np.nonzero(cosine >= least - 1e-9)
            close = np.flatnonzero(cosine[i, j] < least + 1e-9)
            exact = np.array([(q[a] * m[b]).sum() / math.sqrt((q[a] * q[a]).sum() * (m[b] * m[b]).sum()) for a, b in zip(i[close], j[close], strict=True)])
            keep = np.ones(len(i), bool)
            keep[close] = exact >= least
            keep &= qid[i] != mid[j]
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            links = np.bincount(i, weight[j], len(qid)).astype(np.int64)
            names = np.unique(np.r_[qid[i], mid[j]])
            root = names[_local(np.searchsorted(names, qid[i]), np.searchsorted(names, mid[j]), len(names))]
            found = np.flatnonzero(links)
            out += [pd.DataFrame({"node": names, "other": root, "links": 0}), pd.DataFrame({"node": qid[found], "other": qid[found], "links": links[found]})]
    return pd.concat(out) if out else pd.DataFrame({"node": [], "other": [], "links": []}).astype("int64")


def fit(vectors: DataFrame, total: int, max_train: int = MAX_TRAIN, centroids: int = CENTROIDS) -> dict[int, Quantiser]:
    """A quantiser for each length, fitted on at most ``max_train`` vectors, those with the least hashes, and one vector of each length.

    There are about as many lists as the square root of ``total``: up to ``centroids`` by coarse centroids, beyond that each cut by finer ones.
    """
    rows = vectors.select("embedding", F.size("embedding").alias("dim"), F.xxhash64("node").alias("h"))
    sample = rows.where((F.shiftrightunsigned("h", 11) / float(1 << 53)) < min(1.0, 1.2 * max_train / max(total, 1))).orderBy("h").limit(max_train).select("dim", "embedding").collect()
    found = {r["dim"]: [r["embedding"]] for r in rows.groupBy("dim").agg(F.first("embedding").alias("embedding")).collect()}
    for r in sample:
        found[r["dim"]].append(r["embedding"])
    wanted = max(1, math.isqrt(total))
    coarse = min(centroids, wanted)
    return {k: Quantiser(_unit(pd.Series(v))[1], min(coarse, max(1, len(v) // 8)), min(centroids, wanted // coarse, max(1, len(v) // 8))) for k, v in sorted(found.items())}


def near_duplicates(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = COSINE, centroids: int = CENTROIDS) -> DataFrame:
    """Link vectors of equal, non-null labels whose cosine in double precision is ``least`` or more.

    One row per row of ``table``: ``vec_id``, ``n_links`` (other rows linked directly), ``component_id`` (smallest vec_id reachable, itself
    included), ``kept`` (vec_id = component_id). Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths; rows without vec_id link with nothing and have neither component nor ``kept``. A vec_id names one vector:
    rows that repeat it with the same label and vector count as linked copies. Other columns are ignored; an empty table gives no rows. Equal
    vectors are handled once, with their number; cosines hold for vectors however large or small. Within a list blocks of coded members meet
    blocks of queries, and each gives the names of what is left, then counts and a spanning forest, never all pairs.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    e = F.col(embedding)
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), e.cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = written(rows.withColumn("sound", F.coalesce(sound & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.lit(False))), "vectors")
    same = F.xxhash64("embedding").alias("same")
    nodes = rows.where("sound").groupBy("label", same, "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    nodes = written(nodes.select("label", "embedding", "node", "n"), "nodes")
    total = nodes.count()
    models = fit(nodes, total, centroids=centroids)
    homes = written(nodes.select("node", "label", "embedding").mapInPandas(lambda b: _home(b, models), "node long, label string, embedding array<double>, dim int, list int"), "homes")
    packs = written(homes.mapInPandas(lambda b: _probe(b, models, reach), "label string, dim int, list int, n int, salt long, pack binary"), "packs")
    key = ["label", "dim", "list"]
    counts = packs.groupBy(*key).agg(F.sum("n").alias("members"))
    grid = counts.join(homes.groupBy(*key).agg(F.count("*").alias("queries")), key)
    grid = grid.select(*key, F.ceil(F.col("members") / BLOCK).cast("int").alias("gm"), F.ceil(F.col("queries") / (2 * BLOCK)).cast("int").alias("gq"))
    turn = lambda of, g, salt: F.pmod(F.xxhash64(of, F.lit(salt)), F.col(g)).cast("int")
    every = lambda g: F.explode(F.sequence(F.lit(0), F.col(g) - 1))
    members = join_hot(packs, grid, key).select(*key, turn("salt", "gm", 1).alias("bm"), every("gq").alias("bq"), "pack", F.lit(None).cast("long").alias("node"), F.lit(None).cast("array<double>").alias("embedding"))
    queries = join_hot(homes, grid, key).select(*key, every("gm").alias("bm"), turn("node", "gq", 2).alias("bq"), F.lit(None).cast("binary").alias("pack"), "node", "embedding")
    block = [*key, "bm", "bq"]
    left = members.union(queries).groupBy(*block).applyInPandas(lambda pdf: _survivors(pdf, models, reach), "node long, member boolean, label string, dim int, list int, bm int, bq int")
    left = written(left, "survivors")
    whole = join_hot(left, nodes.select("node", "n", "embedding"), ["node"])
    found = written(whole.groupBy(*block).applyInPandas(lambda pdf: _rerank(pdf, least), "node long, other long, links long"), "links")
    for table in (homes, packs, left):
        discard(table)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("node", "other"))
    joined = nodes.join(links, "node", "left").join(parts, "node", "left")
    named = joined.select("label", F.xxhash64("embedding").alias("same"), "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    held = rows.withColumn("same", F.when(F.col("sound"), F.xxhash64("embedding")))
    out = held.join(named, ["same", "label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
