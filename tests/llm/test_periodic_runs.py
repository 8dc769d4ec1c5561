import hashlib
import random
import time

import numpy as np
from shelfmark.llm import periodic_runs


def brute(words):
    """All runs, and what no run repeats, by trying every period at every word."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if size >= max(12, 2 * q) and not any(all(words[x] == words[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                found.append((i, size, q))
            i = j + 1
    gone = {x for s, m, q in found for x in range(s + q, s + m)}
    return sorted(found, key=lambda r: (r[0], r[2])), [w for k, w in enumerate(words) if k not in gone]


def repeated(drawn):
    """Words in which stretches of few words come again, whole or in part, within each other."""
    own = []
    while len(own) < drawn.choice([20, 60, 150]):
        part = [drawn.choice(drawn.choice(["ab", "abcdefgh"])) for _ in range(drawn.choice([1, 2, 3, 5, 11, 13, 30]))]
        own += (part * 40)[: drawn.randrange(1, max(2, 4 * len(part)))]
        if drawn.random() < 0.3:
            own += own[-drawn.randrange(1, len(own) + 1) :]
    return [w.encode() for w in own]


def test_against_every_period():
    drawn = random.Random(11)
    for _ in range(60):
        texts = [repeated(drawn) for _ in range(4)] + [[], [b"a"] * drawn.randrange(30)]
        texts.append(texts[0])
        for words, (found, kept) in zip(texts, periodic_runs.periodic(texts), strict=True):
            want = brute(words)
            assert list(map(tuple, found.tolist())) == want[0]
            assert kept == want[1]


def test_pairs_are_worked_on_in_parts(monkeypatch):
    drawn = random.Random(12)
    texts = [repeated(drawn) for _ in range(12)]
    want = [(r.tolist(), k) for r, k in periodic_runs.periodic(texts)]
    monkeypatch.setattr(periodic_runs, "PAIRS", 3)
    assert [(r.tolist(), k) for r, k in periodic_runs.periodic(texts)] == want


def test_equal_hashes_are_compared_word_by_word(monkeypatch):
    """The sums of hashes of a Thue-Morse text are equal where its words aren't; here every hash is."""
    drawn = random.Random(13)
    texts = [repeated(drawn) for _ in range(8)]
    want = [(r.tolist(), k) for r, k in periodic_runs.periodic(texts)]
    monkeypatch.setattr(periodic_runs.Words, "same", lambda self, i, j, n: np.ones(len(i), bool))
    assert [(r.tolist(), k) for r, k in periodic_runs.periodic(texts)] == want


def test_very_long_texts():
    n = 300_000
    block = [b"w%d" % k for k in range(n // 3)]
    began = time.time()
    for words, want in (
        ([b"a"] * n, [[0, n, 1]]),
        (([b"a"] * 999 + [b"b"]) * (n // 1000), None),
        (block * 3, [[0, n, n // 3]]),
        (([b"%d" % random.Random(k).randrange(50) for k in range(7919)] * 40)[:n], [[0, n, 7919]]),
    ):
        found = periodic_runs.periodic([words])[0][0].tolist()
        assert found == want if want else [0, n, 1000] in found and len(found) == n // 1000 + 1
    assert time.time() - began < 90


def test_documents(spark):
    drawn = random.Random(14)
    rows = [(k if k % 9 else None, b" \t".join(repeated(drawn)).decode(), k, "x") for k in range(60)] + [(3, None, 1, "x"), (100, "", 1, "x"), (101, " \n ", 1, "x"), (60, "\x1cno\x1c \xa0 space", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int, length string").repartition(3)
    want = []
    for doc_id, text, *_ in rows:
        words = periodic_runs.planted(doc_id, [w for w in (text or "").encode().split()])
        found, kept = brute(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        numbers = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
        digests = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in found).encode(), b" ".join(kept))]
        want.append((doc_id, len(found), *numbers, *digests))
    assert sorted(map(str, map(tuple, periodic_runs.periodic_runs(docs).collect()))) == sorted(map(str, want))


def test_planted_ends_repeat():
    assert periodic_runs.planted(7, [b"a", b"b"]) == [b"a", b"b"]
    words, edited = [b"%d" % k for k in range(100)], 0
    for doc_id in range(100):
        own = periodic_runs.planted(doc_id, words)
        edited += own != words
        assert len(own) == 100
    assert edited >= 4


def test_empty_table(spark):
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id string, text string")).count() == 0
