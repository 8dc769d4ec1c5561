import math
import random
import zlib
from collections import Counter

import numpy as np
from shelfmark.llm import language_model as lm


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "VOCABULARY", 40)
    rng = random.Random(6)
    kinds = [[f"{a}{k}" for k in range(60)] for a in ("the", "É", "Der")]
    rows = [(k, " ".join(rng.choice(kinds[k % 3][: rng.randrange(2, 60)]) for _ in range(rng.randrange(5, 90))), 0) for k in range(300)]
    rows += [(None, None, 1), (2, "", 1), (2, "\t", 1), (5, "never seen\x0bWORDS \xa0x", 1), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int").repartition(3)
    train = Counter()
    for i, t, _ in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    expected = []
    for i, t, _ in rows:
        own = tokens(t)
        expected.append((i or -1, len(own), sum(train[w] > 0 for w in own), round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in own), 6)))
    monkeypatch.setattr(lm, "FREQUENT", 70)  # so that many tokens take the other way
    monkeypatch.setattr(lm, "SHARD_TOKENS", 2500)
    monkeypatch.setattr(lm, "LANES", 4)
    monkeypatch.setattr(lm, "AVERAGED", 2)
    monkeypatch.setattr(lm.lookup, "__defaults__", (70,))
    out = lm.language_model(docs).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == sorted(expected)
    assert {r.train_tokens for r in out} == {n}
    held = [r for r in out if r.held_out]
    assert len(held) > 20 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_no_rows(spark):
    assert lm.language_model(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def model():
    lm_rng = np.random.default_rng(1)
    return lm.Gru(1 + lm_rng.random(30) * 100)


def test_probabilities_sum_to_one():
    gru = model()
    h = np.random.default_rng(2).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    total = sum(math.exp(gru.outputs(h, np.array([w]))[0]) for w in range(30))
    assert abs(total - 1) < 1e-4


def test_state_is_carried_across_windows():
    gru = model()
    texts = [np.random.default_rng(k).integers(0, 30, n) for k, n in enumerate((1, 5, 33, 70, 64))]
    stream, at = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    whole, cut = gru.score(stream, at, 0, window=100), gru.score(stream, at, 0, window=7)
    assert np.allclose(whole, cut, atol=1e-3)
    h, log, before = np.zeros((1, lm.HIDDEN), np.float32), 0.0, 0
    for w in texts[2]:
        h = gru.step(h, gru.w["x"][[before]])[0]
        log += gru.outputs(h, np.array([w]))[0]
        before = w
    assert abs(log - whole[2]) < 1e-3


def test_gradients(monkeypatch):
    gru = model()
    monkeypatch.setattr(lm, "LANES", 2)
    monkeypatch.setattr(lm, "WINDOW", 6)
    monkeypatch.setattr(lm, "LEAST_STEPS", 1)
    stream = np.array([3, 7, 0, 5, 2, 9, 4, 4, 11, 0, 8, 1])
    got = {}

    def update(grads, seen, n, rate):
        dx = np.zeros_like(gru.w["x"])
        dx[seen] = grads["x"]
        got.update(grads | {"x": dx})

    monkeypatch.setattr(gru, "update", update)
    gru.train(stream, 0, 0.1)

    def loss():
        total = 0.0
        for lane in (stream[:6], stream[6:]):
            h, before = np.zeros((1, lm.HIDDEN), np.float32), 0
            for w in lane:
                h = gru.step(h * np.float32(before != 0), gru.w["x"][[before]])[0]
                total -= float(gru.outputs(h, np.array([w]))[0])
                before = w
        return total

    rng = np.random.default_rng(3)
    for name, g in got.items():
        for at in [np.unravel_index(np.argmax(np.abs(g)), g.shape), tuple(rng.integers(0, s) for s in g.shape)]:
            own = gru.w[name][at]
            gru.w[name][at] = own + 1e-2
            up = loss()
            gru.w[name][at] = own - 1e-2
            down = loss()
            gru.w[name][at] = own
            assert abs((up - down) / 2e-2 - g[at]) < 0.02 * abs(g[at]) + 3e-3, (name, at)


def test_every_training_text_is_learnt_from_once(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 200_000)
    rows = [(k % 7, " ".join(f"w{(k % 60 * 7 + i) % 90}" for i in range(2500))) for k in range(400)]  # ids and texts repeat
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    look = lm.lookup(lm.counts(docs))
    assert look.n == 400 * 2501
    words = lm.encoded(lm.with_row_key(docs), look)
    assert words.agg({"n_tokens": "sum"}).first()[0] == look.n
    passes = []
    monkeypatch.setattr(lm, "_averaged", lambda frame, averaged=0: passes.append(int(frame["n"].sum())) or frame)
    lm.trained(words.select("row_file", "row_index", "words"), look)
    assert sum(passes) == look.n and len(passes) == len(lm.ROUNDS) and min(passes) > 0


def test_ids_by_hash_are_those_of_the_index():
    rng = random.Random(2)
    words = sorted({("é" * (k % 3) + "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9)))).encode() for k in range(4000)})
    look = lm.Lookup(10**6, 10**5, [(w, 1 + k) for k, w in enumerate(words[::2])] + [(lm.END, 9)])
    data, at = lm.hashing.buffers(lm.pa.array(words, lm.pa.binary()))
    assert look.ids(lm.hashing.spans(data, at[:-1], at[1:])).tolist() == [look.index.get(w, -1) for w in words]


def test_words_of_the_model_grow_with_the_counts():
    frequent = [(b"%d" % k, 10_000_000 // (k + 1)) for k in range(80_000)]
    n = sum(c for _, c in frequent)
    assert lm.Lookup(n, 80_000, frequent).words == lm.MOST_WORDS
    assert lm.Lookup(n, 80_000, [(w, c // 100) for w, c in frequent]).words == lm.VOCABULARY
    assert lm.Lookup(n, 80_000, [(w, c // 10) for w, c in frequent]).words == sum(c // 10 >= lm.LEAST_COUNT for _, c in frequent) > lm.VOCABULARY


def test_no_token_of_a_stream_is_left_out(monkeypatch):
    gru, seen = model(), []
    monkeypatch.setattr(gru, "outputs", lambda h, word, grad=False, own=gru.outputs: (seen.extend(word.tolist()), own(h, word, grad))[1])
    stream = np.concatenate([np.full(lm.LANES * lm.WINDOW * lm.LEAST_STEPS, 3), [7, 7, 7]])
    gru.train(stream, 0, 0.01)
    assert seen.count(7) == 3
