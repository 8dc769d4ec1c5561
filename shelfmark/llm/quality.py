"""Operator 2, quality classifier: supervised subword embeddings.

Every word and every n-gram of three and four characters (spaces mark where words begin and end) has a bucket by hash,
and every bucket a learned vector; a word that repeats the word before it also counts in a bucket of its own kind. A text is the average of its vectors; a softmax over two outputs follows. Vectors and
output weights are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows (`sample_rows`,
drawn row by row with a seed; each row's whole text counts). As the output is linear in the average, a bucket's vector and the output
weights are folded into one number a bucket before all texts are scored: the same score for a small part of the work.

Null and empty texts have the score of the intercept alone. Labels that are null or belong to no document train nothing;
with none left every score is 0.5. A document with several labels is a training row for each. Repeated rows and equal
or null ids stay rows of their own; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import prepare, remainder

BITS, ORDERS, SIZE = 17, (3, 4), 8
SAMPLE_ROWS = 3000
_REPEAT = (len(ORDERS) + 1) << BITS  # the bucket of a word that is the word before it once more
_BUCKETS = _REPEAT + 1


def _grouped(texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first, last, [(bucket of each token, offsets)]) of groups of texts; bucket _BUCKETS stands for none."""
    data, offsets = hashing.buffers(texts)
    for a, b in hashing.groups(offsets):
        raw, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        which, h = hashing.word_hashes(raw, at)
        count = np.bincount(which, minlength=b - a)
        kinds = [((h >> np.uint64(64 - BITS)).astype(np.int32), np.append(0, np.cumsum(count)))]
        again = np.full(len(h), _BUCKETS, np.int32)
        again[1:][(h[1:] == h[:-1]) & (which[1:] == which[:-1])] = _REPEAT
        kinds.append((again, kinds[0][1]))
        points, at = hashing.code_points(raw, at)
        for k, n in enumerate(ORDERS):
            own = hashing.ngrams(points, at, n, BITS)
            kinds.append((np.where(own == 1 << BITS, _BUCKETS, own + ((k + 1) << BITS)), at))
        yield a, b, kinds


class Model:
    def __init__(self, table: np.ndarray, bias: float) -> None:
        self.table, self.bias = table, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b, kinds in _grouped(texts):
            of = [0, 0, *(n - 1 for n in ORDERS)]
            means = [hashing.sums(self.table[k], at) / np.maximum(np.diff(at) - n, 1) for n, (k, at) in zip(of, kinds, strict=True)]
            out[a:b] = 1 / (1 + np.exp(-(sum(means) / len(kinds) + self.bias)))
        return out


def _weights(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A bucket's part in the text's average: words, repeats and each length of n-grams have equal parts; repeats are counted against words."""
    kind = ids >> BITS
    total = np.maximum(np.bincount(kind, counts, len(ORDERS) + 2), 1)
    total[-1] = total[0]
    return counts / total[kind] / len(total)


def sampled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Counted buckets and labels of about `sample_rows` labelled rows."""
    labels = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").alias("of"), F.col("quality").cast("int").alias("quality")).distinct()
    n = docs.select("doc_id").join(labels, F.col("doc_id") == F.col("of")).count()
    share = min(1.0, sample_rows / max(n, 1))
    chosen = docs.filter(F.rand(2) < share).join(labels, F.col("doc_id") == F.col("of")).select("quality", "text")  # row by row: no repeated id comes as a whole

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for a, b, kinds in _grouped(batch.column("text")):
                for k in range(b - a):
                    own = np.concatenate([x[at[k] : at[k + 1]] for x, at in kinds])
                    i, c = hashing.counted(own[own < _BUCKETS])
                    ids.append(i.tobytes())
                    counts.append(c.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["quality", "ids", "counts"])

    rows = chosen.mapInArrow(count, "quality int, ids binary, counts binary").collect()
    rows.sort(key=lambda r: (r.ids, r.quality))  # alike whatever the order of tasks
    return [(np.frombuffer(r.ids, np.uint32), np.frombuffer(r.counts, np.uint32)) for r in rows], np.array([r.quality > 0 for r in rows], int)


def trained(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, epochs: int = 5, rate: float = 0.25) -> Model:
    """docs: the rows to learn from."""
    prepare(docs.sparkSession)
    bags, y = sampled(docs, labels, sample_rows)
    weights = [_weights(*bag) for bag in bags]
    rng = np.random.default_rng(2)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (_BUCKETS, SIZE))
    output, bias = np.zeros((SIZE, 2)), np.zeros(2)
    squares, output_squares, bias_square = np.full(_BUCKETS, 1e-8), 1e-2, 1e-2  # each part's step shrinks with its own gradients
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(bags)).tolist():
            ids = bags[k][0]
            weight = weights[k]
            hidden = weight @ vectors[ids] if len(ids) else np.zeros(SIZE)
            logits = hidden @ output + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[y[k]] -= 1
            back, change = output @ error, np.outer(hidden, error)
            output_squares += (change * change).mean()
            bias_square += (error * error).mean()
            output -= lr * change / np.sqrt(output_squares)
            bias -= lr * error / np.sqrt(bias_square)
            squares[ids] += weight * weight * (back @ back) / SIZE
            vectors[ids] -= lr * (weight / np.sqrt(squares[ids]))[:, None] * back
    table = np.zeros(_BUCKETS + 1, np.float32)
    table[:-1] = vectors @ (output[:, 1] - output[:, 0])
    return Model(table, float(bias[1] - bias[0]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each document."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number a bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(batch.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of each document, learned from labels of those that aren't held out."""
    fold = remainder(F.col("doc_id"), 3)
    kept = labels.filter(fold != 1)
    model = trained(docs.select("doc_id", "text").filter(fold != 1), kept, sample_rows)
    return scored(docs, model).select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
