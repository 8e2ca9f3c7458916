"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three lower-cased characters are hashed into ``BUCKETS``. Document frequencies are counted over all learnable
documents. Weights are fitted on a bounded sample of them by follow-the-regularised-leader with elastic-net penalties; a
temperature, fitted on a part of the sample that the weights have not seen, calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each_text, free_names
from .rolling import mix

BUCKETS, ORDERS, UNKNOWN = 1 << 16, 3, "und"
#: Labelled rows that weights and temperature are fitted on, at most; every fifth calibrates.
MAX_TRAIN, EPOCHS = 6000, 2
#: Buckets that the sample's rows hold in all, at most; long texts make it shorter.
MAX_ENTRIES = 40_000_000
#: Rows of n-gram counts that leave a worker at once.
LOT = 256
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02


def has_letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that the text's n-grams fall into, and how many fall into each; parts of a long text are added up."""
    total = np.zeros(BUCKETS, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    for at in range(0, len(code), 1 << 19):
        x = code[at : at + (1 << 19) + ORDERS - 1].astype(np.uint64)
        n, gram = min(len(code) - at, 1 << 19), np.zeros(len(x), np.uint64)
        for order in range(1, ORDERS + 1):
            gram = gram[: len(x) - order + 1] * np.uint64(0x110001) + x[order - 1 :] + np.uint64(1)
            total += np.bincount((mix(gram[:n]) >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class Model:
    """Weights by bucket and language (the last row: the bias), inverse document frequencies, temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray = field(repr=False)
    temperature: float = 1.0

    def features(self, found: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(n)) * self.idf[found]
        return np.append(found, BUCKETS), np.append(x / max(np.sqrt(x @ x), 1e-12), 1.0)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letters(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*self.features(*counts(text))) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_the_leader(model: Model, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> None:
    """Fit the weights by FTRL-Proximal, one row at a time in a fixed order; L1 keeps unneeded weights at zero."""
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    solve = lambda z, n: np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x = rows[i]
            zi, ni = z[at], n[at]
            w = solve(zi, ni)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            more = ni + g * g
            z[at], n[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w, more
    model.weights = solve(z, n)


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search on its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()
    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        for text in each_text(batch.column("text")):
            df[counts(text)[0]] += 1
            df[BUCKETS] += 1
    found = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(found, pa.int32()), "n": pa.array(df[found])})


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), LOT):
            part = batch.slice(at, LOT)
            rows = [(a.astype(np.uint16).tobytes(), np.minimum(n, 2**32 - 1).astype(np.uint32).tobytes()) for a, n in map(counts, each_text(part.column("text")))]
            yield pa.RecordBatch.from_pydict({"h": part.column("h"), "lang": part.column("lang"), "at": pa.array([a for a, _ in rows], pa.binary()), "n": pa.array([n for _, n in rows], pa.binary())})


def learnable(doc_id: Column) -> Column:
    """True for the documents that may be learned from; false for held-out ones, null without doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def _spread(rows: DataFrame, sizes: dict[str, int], max_train: int, take: int | None = None) -> DataFrame:
    """At most ``max_train`` rows, or the first ``take`` of them, by ``h`` as a share of their language's threshold, so that each gives up the same part of its own."""
    each = max(1, max_train // len(sizes))
    low = F.create_map(*[F.lit(x) for k in sorted(sizes) for x in (k, min(1.0, 1.1 * each / sizes[k]))])
    part = (F.shiftrightunsigned("h", 11) / float(1 << 53)) / F.element_at(low, F.col("lang"))
    return rows.where(part < 1).orderBy(part, "h", "lang").limit(max_train if take is None else take)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_train: int = MAX_TRAIN, max_entries: int = MAX_ENTRIES) -> Model:
    """Learn from texts with letters and their non-null languages in documents that ``learnable`` names.

    At most ``max_train`` rows, spread evenly over the languages by a hash of doc_id, fit weights and temperature; document frequencies
    come from all learnable rows. Without any, the model knows no language. The driver gets the sample's n-gram counts (of ``max_entries``
    buckets in all; the sample ends where long texts hold more), one row per language and one per bucket.
    """
    rows = docs.where(learnable(F.col(doc_id))).select(F.xxhash64(doc_id).alias("h"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS + 1, 0)))
    df = np.zeros(BUCKETS + 1)
    for r in rows.select("text").mapInArrow(_document_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r["bucket"]] = r["n"]
    costs = [r[0] for r in _spread(rows.select("h", "lang", F.least(F.length("text") * ORDERS, F.lit(BUCKETS)).alias("cost")), sizes, max_train).select("cost").collect()]
    take = max(1, int(np.searchsorted(np.cumsum(costs), max_entries, "right"))) if costs else 0
    sample = _spread(rows, sizes, max_train, take).mapInArrow(_sparse, "h long, lang string, at binary, n binary").collect()
    model = Model(languages, np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1, np.zeros((BUCKETS + 1, len(languages))))
    features = [model.features(np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["n"], np.uint32)) for r in sorted(sample, key=lambda r: (r["h"], r["lang"]))]
    labels = np.array([languages.index(r["lang"]) for r in sorted(sample, key=lambda r: (r["h"], r["lang"]))])
    held = np.arange(len(labels)) % 5 == 4
    follow_the_leader(model, [f for f, x in zip(features, held, strict=True) if not x], labels[~held])
    if held.any() and len(languages) > 1:
        model.temperature = calibrate(np.stack([model.logits(*f) for f, x in zip(features, held, strict=True) if x]), labels[held])
    return model


def _predictions(texts: pa.Array, model: Model) -> pa.Array:
    found = [model.predict(t) for t in each_text(texts)]
    return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["lang", "score"])


def predict(text: Column, model: Model) -> Column:
    """struct<lang, score> of each whole text; a text that is null or without letters is ``und`` with score 0. The weights, 256 kB a language, travel with the function."""
    weights = model.weights.astype(np.float32)
    shared = Model(model.languages, model.idf.astype(np.float32), weights, model.temperature)

    return F.arrow_udf(lambda texts: _predictions(texts, shared), "struct<lang:string,score:double>")(text)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_train: int = MAX_TRAIN) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``lang_pred``, ``score`` (calibrated probability of the prediction, 0 to 1).

    Languages, sources and ids are never inputs of a prediction. Rows without doc_id are neither held out nor learned from. Repeated
    rows stay and count as often; other columns are ignored; an empty table gives no rows.
    """
    model = fit(docs, doc_id, text, lang, max_train)
    held = F.coalesce(~learnable(F.col(doc_id)), F.lit(False))
    found = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), predict(F.col(text), model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, least: float = 0.5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of ``docs`` whose text has letters and whose predicted language has a probability of ``least`` or more.

    All columns stay, whatever their names; rows without doc_id are judged like any other; an empty table gives no rows.
    """
    model = fit(docs, doc_id, text, lang)
    names, p = [F.col(f"`{c}`") for c in docs.columns], free_names(docs, 1)[0]
    return docs.select(*names, predict(F.col(text), model).alias(p)).where((F.col(f"{p}.lang") != UNKNOWN) & (F.col(f"{p}.score") >= least)).select(*names)
