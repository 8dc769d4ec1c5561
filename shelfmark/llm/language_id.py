"""Operator 3, language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: n-grams of one to three lower-cased characters, hashed into 2**BITS buckets; a bucket's share of the text's
n-grams times its inverse document frequency, which is counted over all training documents. Training: follow the
regularised leader with elastic-net penalties, on a bounded sample of labelled rows (`per_language` of each language,
drawn row by row with a seed). Calibration: one temperature, fitted on a fifth of the sample that training leaves out.

A text that is null, empty or has no letter is `und` with score 0. Ties go to the language first in order. Rows without
a language train nothing but are predicted. With no training row at all every text is `und`. Repeated rows and equal or
null ids stay rows of their own; further columns are ignored or, in `labelled`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import filtered, prepare, remainder

BITS, ORDERS = 16, (1, 2, 3)
SCALE = 40.0
PER_LANGUAGE = 1000
UNKNOWN = "und"


def _buckets(points: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [hashing.ngrams(points, at, n, BITS) for n in ORDERS]


def _grouped(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = hashing.buffers(texts)
    for a, b in hashing.groups(offsets):
        points, at = hashing.code_points(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
        yield a, b, points, at


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each bucket, documents). Each task sends one row for each bucket, whatever its rows."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen, n = np.zeros(1 << BITS, np.int64), np.zeros((1 << BITS) + 1, np.uint8), 0
        for batch in batches:
            for a, b, points, at in _grouped(batch.column("text")):
                n += b - a
                orders = _buckets(points, at)
                for k in range(b - a):
                    seen[:] = 0
                    for o in orders:
                        seen[o[at[k] : at[k + 1]]] = 1
                    found += seen[:-1]
        full = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1)), pa.array(np.append(found[full], n))], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(1 << BITS, np.int64), 0
    for bucket, n in rows:
        if bucket < 0:
            total = n
        else:
            out[bucket] = n
    return out, total


def sampled(docs: DataFrame, languages: dict[str, int], per_language: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Counted buckets, language and fold of at most about `per_language` labelled rows of each language."""
    share = F.create_map(*[x for k, n in languages.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    chosen = docs.filter(F.rand(3) < share[F.col("lang")]).select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(5)).alias("fold"))  # row by row: no group of copies comes as a whole

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for a, b, points, at in _grouped(batch.column("text")):
                orders = _buckets(points, at)
                for k in range(b - a):
                    own = np.concatenate([o[at[k] : at[k + 1]] for o in orders])
                    i, c = hashing.counted(own[own < 1 << BITS])
                    ids.append(i.tobytes())
                    counts.append(c.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("fold"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["lang", "fold", "ids", "counts"])

    rows = chosen.mapInArrow(count, "lang string, fold bigint, ids binary, counts binary").collect()
    rows.sort(key=lambda r: (r.ids, r.lang))  # alike whatever the order of tasks
    order = {k: i for i, k in enumerate(sorted(languages))}
    rows = [rows[i] for i in np.random.default_rng(3).permutation(len(rows))]
    return [(np.frombuffer(r.ids, np.uint32), np.frombuffer(r.counts, np.uint32)) for r in rows], np.array([order[r.lang] for r in rows], int), np.array([r.fold for r in rows], int)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow the regularised leader, one coordinate-wise learning rate for each weight; the last column is the intercept."""

    def __init__(self, classes: int, features: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((classes, features + 1)), np.zeros((classes, features + 1))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax(w @ x)
        error[label] -= 1
        g = np.outer(error, x)
        n = self.n[:, at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[:, at] += g - sigma * w
        self.n[:, at] = n + g * g


class Model:
    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.languages, self.table, self.bias, self.temperature = languages, table, bias, temperature

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for a, b, points, at in _grouped(texts):
            orders = _buckets(points, at)
            total = sum(np.maximum(np.diff(at) - n + 1, 0) for n in ORDERS)
            logits = np.stack([sum(hashing.sums(own[o], at) for o in orders) for own in self.table], axis=1)
            p = softmax((logits / np.maximum(total, 1)[:, None] + self.bias) / self.temperature)
            best = p.argmax(axis=1)
            ascii_letter = ((points >= 97) & (points <= 122)).astype(np.uint8)
            letters = hashing.sums(ascii_letter, at) if len(points) else np.zeros(b - a)
            for k in range(b - a):
                if letters[k] or any(chr(c).isalpha() for c in points[at[k] : at[k + 1]].tolist()):
                    names[a + k], scores[a + k] = self.languages[best[k]], p[k, best[k]]
        return names, scores


def trained(docs: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = 3) -> Model:
    """docs: the rows to learn from; of these, those with a language."""
    docs = docs.filter("lang is not null")
    languages = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros(0), 1.0)
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    bags, labels, fold = sampled(docs, languages, per_language)
    x = [(np.append(i, 1 << BITS).astype(np.int64), np.append(c / max(c.sum(), 1) * idf[i] * SCALE, 1.0)) for i, c in bags]
    ftrl = Ftrl(len(languages), 1 << BITS)
    fitted = np.flatnonzero(fold != 0) if (fold != 0).any() else np.arange(len(x))
    for _ in range(epochs):
        for k in fitted.tolist():
            ftrl.learn(*x[k], labels[k])
    w = ftrl.weights()
    out = np.array([k for k in range(len(x)) if fold[k] == 0], int)
    temperature = 1.0
    if len(out):
        logits = np.stack([w[:, x[k][0]] @ x[k][1] for k in out])
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(out)), labels[out]] + 1e-12).mean()
        temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    table = np.zeros((len(languages), (1 << BITS) + 1), np.float32)
    table[:, :-1] = w[:, :-1] * idf * SCALE
    return Model(sorted(languages), table, w[:, -1], temperature)


def labelled(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two more columns, language and score, in place of any that have these names."""
    prepare(docs.sparkSession)
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights a language
    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), f"`{names[0]}` string", f"`{names[1]}` double"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = shared.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores)], [*batch.schema.names, *names])

    return docs.mapInArrow(add, schema)


def accepted(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows whose text is of a known language with a score of `least` or more; all columns as they are."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights a language

    def keep(texts: pa.Array) -> np.ndarray:
        found, scores = shared.value.predict(texts)
        return (scores >= least) & np.array([f != UNKNOWN for f in found], bool)

    return filtered(docs, keep)


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document, learned from those that aren't held out."""
    model = trained(docs.filter(remainder(F.col("doc_id"), 3) != 1), per_language)
    out = labelled(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


