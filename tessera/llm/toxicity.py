"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learned from document labels alone."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE_END = re.compile(r"[.!?\n\r  。！？]+")
EDGE = ",;:'\"()[]{}<>*_-#/\\|`~^&%$@+=«»“”„‘’…¿¡"
PREFIXES = (3, 4, 5, 6)
#: The training set is a bounded sample of labelled rows: this many of each label, by hash order, none longer than MAX_CHARS.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 2500, 4000, 60_000
MIN_TOXIC_DOCS, ROUNDS, RATE, L2 = 3, 150, 0.15, 1e-4
THRESHOLD = 0.7
CACHE_WORDS = 150_000


def features(word: str) -> list[str]:
    """The bare word and its leading letters; a word-start cue covers unseen inflections."""
    w = word.strip(EDGE)
    return ["=" + w, *("^" + w[:k] for k in PREFIXES if len(w) > k)] if w else []


def sentences(text: str | None) -> list[str]:
    return SENTENCE_END.split((text or "").lower())


@dataclass
class Model:
    weights: dict[str, float]
    bias: float


class _Weights(dict):
    """Log-odds by raw token, bounded."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        w = self[word] = sum(self.model.weights.get(f, 0.0) for f in features(word))
        return w


def _softplus(z: float) -> float:
    return z if z > 30 else math.log1p(math.exp(z))


def score(text: str | None, model: Model, weights: _Weights) -> tuple[float, int, float, int]:
    """(document score, worst sentence's index, its score, sentences with words). Noisy-or: 1 - prod(1 - p)."""
    rest, worst, at, n = 0.0, -1.0, -1, 0
    get = weights.__getitem__
    plain = _softplus(model.bias)
    for i, s in enumerate(sentences(text)):
        words = s.split()
        if not words:
            continue
        n += 1
        w = sum(map(get, words))
        add = _softplus(model.bias + w) if w else plain
        rest += add
        if add > worst:
            worst, at = add, i
    return 1 - math.exp(-rest), at, (1 - math.exp(-worst)) if n else 0.0, n


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """Maximum likelihood of the noisy-or by Adam; only features that enough toxic documents have get a weight.

    Without rows of both labels the model is a constant that rejects nothing.
    """
    rows = [(t, int(y)) for t, y in rows if y is not None]
    toxic = [t for t, y in rows if y]
    if not toxic or len(toxic) == len(rows):
        return Model({}, -12.0)
    seen: Counter[str] = Counter()
    clean: Counter[str] = Counter()
    for t, y in rows:
        (seen if y else clean).update({f for w in set((t or "").lower().split()) for f in features(re.sub(r"[.!?]+", "", w))})
    n_t, n_c = len(toxic), len(rows) - len(toxic)
    kept = sorted(f for f, k in seen.items() if k >= MIN_TOXIC_DOCS and k / n_t > 2 * (clean[f] + 1) / (n_c + 1))
    index = {f: i for i, f in enumerate(kept)}
    feats, sent, doc_of, y_of, s = [], [], [], [], 0
    for d, (t, y) in enumerate(rows):
        y_of.append(y)
        for text in sentences(t):
            words = text.split()
            if not words:
                continue
            at = [index[f] for w in words for f in features(w) if f in index]
            feats += at
            sent += [s] * len(at)
            doc_of.append(d)
            s += 1
    feats_a, sent_a, doc_a, y_a = (np.array(x, dtype=np.int64) for x in (feats, sent, doc_of, y_of))
    w, b = np.zeros(len(kept) + 1), math.log(n_t / len(rows) / max(1.0, s / len(rows)))
    w[-1] = b
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, ROUNDS + 1):
        z = np.bincount(sent_a, weights=w[feats_a], minlength=s) + w[-1]
        a = np.bincount(doc_a, weights=np.logaddexp(0, z), minlength=len(rows))
        g_doc = np.where(y_a == 1, -1 / np.expm1(np.clip(a, 1e-6, 50)), 1.0)
        g_sent = g_doc[doc_a] / (1 + np.exp(-np.clip(z, -50, 50)))
        g = np.zeros_like(w)
        g[:-1] = np.bincount(feats_a, weights=g_sent[sent_a], minlength=len(kept)) + L2 * len(rows) * w[:-1] / 10
        g[-1] = g_sent.sum()
        g /= len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Model({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}, float(w[-1]))


def held_out(id_col: str):
    """crc32 of the id as text mod 3 is 1; a row without an id never trains."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on a bounded sample (MAX_TOXIC, MAX_CLEAN rows) of the labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    order = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    picked = known.where("__toxic = 1").orderBy(order, "doc_id").limit(MAX_TOXIC)
    picked = picked.unionByName(known.where("__toxic = 0").orderBy(order, "doc_id").limit(MAX_CLEAN))
    picked = picked.select(F.col("doc_id").alias("__id"), "__toxic")  # at most MAX_TOXIC + MAX_CLEAN rows: bounded, so broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("__doc"), F.col(text_col).cast("string").alias("__text"))
    found = texts.where(F.coalesce(F.length("__text"), F.lit(0)) <= MAX_CHARS).join(F.broadcast(picked), F.col("__doc") == F.col("__id"))
    found = found.groupBy("__doc").agg(F.min("__text").alias("__text"), F.max("__toxic").alias("__toxic"))
    rows = sorted((r["__doc"], r["__text"], r["__toxic"]) for r in found.collect() if r["__text"] is not None)
    return fit([(t, y) for _, t, y in rows])


def apply(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, worst_sentence (0-based, -1: none), worst_score of every whole text.

    Null and empty texts score 0. Repeated rows are each scored; a null doc_id stays null. With keep, the rows of docs
    that are not predicted toxic come back instead, with all their columns.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    if keep:
        return docs.where(_clean_udf(shared)(F.col(text_col).cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        weights = _Weights(model)
        for batch in batches:
            out = [score(t.as_py(), model, weights) for t in batch.column(2)]
            p = [o[0] for o in out]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(p, pa.float64()),
                    pa.array([int(x >= THRESHOLD) for x in p], pa.int32()),
                    pa.array([o[3] for o in out], pa.int64()),
                    pa.array([o[1] for o in out], pa.int64()),
                    pa.array([o[2] for o in out], pa.float64()),
                ],
                names=["doc_id", "held_out", "score", "predicted", "n_sentences", "worst_sentence", "worst_score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, held_out boolean, score double, predicted int, n_sentences long, worst_sentence long, worst_score double"
    return rows.mapInArrow(run, schema)


def _clean_udf(shared):
    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Model(*shared.value)
        weights = _Weights(model)
        for texts in parts:
            yield pd.Series([score(t, model, weights)[0] < THRESHOLD for t in texts], dtype=bool)

    return clean


def crc_fold(doc_id: int) -> int:
    """The fold of a doc_id, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 3
