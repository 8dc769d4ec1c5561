import random

import numpy as np
import pyarrow as pa
from shelfmark.llm import quality


def corpus(n=300):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        good = k % 3 > 0
        words = [rng.choice("the of and thing water straße garçon".split()) + rng.choice(("", "s", "ing")) for _ in range(rng.randrange(4, 80))]
        rows.append((k, " ".join(w if good else w + "$$$" for w in words), None))
        labels.append((k, int(good), None))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    extra = [(None, None, 1), (None, "", 1), (5, "again", 1), (400, " ", 1)]
    docs = spark.createDataFrame(rows + extra, "doc_id bigint, text string, score int").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (7, None, 1), (999, 1, 1), (8, 1, 0)], "doc_id bigint, quality int, toxic int")
    out = quality.quality(docs, marks).collect()
    assert len(out) == len(rows) + len(extra)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert len({r.score for r in out if r.doc_id is None or r.doc_id == 400}) == 1


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality.quality(docs, none).collect()} == {0.5}
    assert quality.quality(docs.limit(0), none).count() == 0


def test_folded_score_equals_the_average_of_vectors():
    rng = np.random.default_rng(0)
    vectors, output = rng.normal(size=(quality._BUCKETS, 4)), rng.normal(size=(4, 2))
    model = quality.Model(np.append(vectors @ (output[:, 1] - output[:, 0]), 0), 0.25)
    texts = pa.array(["one two two  three", "x", "é日 é日", None])
    for a, b, kinds in quality._grouped(texts):
        for k in range(b - a):
            own = np.concatenate([x[at[k] : at[k + 1]] for x, at in kinds])
            ids, n = quality.hashing.counted(own[own < quality._BUCKETS])
            logits = quality._weights(ids, n) @ vectors[ids] @ output
            assert np.isclose(model.score(texts)[a + k], 1 / (1 + np.exp(-(logits[1] - logits[0] + 0.25))))
