import random
import zlib

import numpy as np
import pyarrow as pa
from shelfmark.llm import hashing, language_id

WORDS = {"en": "the of and thing with water", "de": "der und nicht für straße öl", "fr": "le été où garçon avec être", "ru": "и не что вода дом"}


def corpus(n=240):
    rng = random.Random(1)
    rows = []
    for k in range(n):
        lang = sorted(WORDS)[k % 4]
        rows.append((k, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(3, 60))), lang, None))
    return [*rows, (None, None, "en", "x"), (n, "", "de", "x"), (n, "123 $%", "fr", "x"), (n + 1, "WATER THE", None, "y"), (0, "Ж", None, None), *rows[:3]]


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string").repartition(3)
    out = language_id.language_id(docs).collect()
    assert len(out) == len(rows)
    truth = {i: l for i, t, l, _ in rows[:240]}
    held = [r for r in out if r.held_out and r.doc_id in truth and r.doc_id]
    assert len(held) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in out)
    assert [(r.lang_pred, r.score) for r in out if r.doc_id is None] == [("und", 0.0)]
    assert sorted(r.lang_pred for r in out if r.doc_id == 240) == ["und", "und"]
    assert [r.lang_pred for r in out if r.doc_id == 241] == ["en"]


def test_no_training_rows_and_empty_table(spark):
    schema = "doc_id bigint, text string, lang string"
    out = language_id.language_id(spark.createDataFrame([(1, "water", None)], schema)).collect()
    assert (out[0].lang_pred, out[0].score) == ("und", 0.0)
    assert language_id.language_id(spark.createDataFrame([], schema)).count() == 0


def test_ngrams_match_strings():
    texts = ["", "a", "Ab", "abÉb日", "", "xabab"]
    points, at = hashing.code_points(*hashing.buffers(pa.array(texts)))
    for n in (1, 2, 3):
        h = hashing.ngrams(points, at, n, 16)
        grams = {}
        for k, t in enumerate(texts):
            for i in range(len(t)):
                bucket = h[at[k] + i]
                assert (bucket == 1 << 16) == (i + n > len(t))
                if i + n <= len(t):
                    assert grams.setdefault(t[i : i + n], bucket) == bucket


def test_penalty_leaves_weights_out():
    rng = np.random.default_rng(0)
    model = language_id.Ftrl(2, 50, l1=8.0)
    for _ in range(400):
        x = rng.normal(size=51)
        model.learn(np.arange(51), x, int(x[0] > 0))
    w = model.weights()
    assert (w[1, 0] - w[0, 0]) > 1 and (w[:, 1:50] == 0).mean() > 0.5


def test_accepted_keeps_columns_of_any_name(spark):
    names = ["language_found", "language_score", "lang_pred", "score", "q`u.o te"]
    schema = "doc_id bigint, text string, lang string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    rows = [(k, ("the cat and the dog " if k % 2 else "der hund und das haus ") * 9, "en" if k % 2 else "de", *(f"{c} {k}" for c in names)) for k in range(40)]
    rows += [(50, "123 !!", None, *names), (51, None, None, *names)]
    docs = spark.createDataFrame(rows, schema)
    model = language_id.trained(docs)
    out = language_id.accepted(docs, model, 0.3)
    assert out.columns == ["doc_id", "text", "lang", *names]
    assert sorted(map(tuple, out.collect())) == rows[:40]
    more = language_id.labelled(docs.drop("q`u.o te"), model)
    assert more.columns == ["doc_id", "text", "lang", "language_found", "language_score", "lang_pred", "score"]
