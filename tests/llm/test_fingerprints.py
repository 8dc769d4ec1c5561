import hashlib
import random

import numpy as np
import pyarrow as pa
from shelfmark.llm import fingerprints, hashing


def shingle_set(text, size=5):
    w = [x for x in text.encode().split()]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def random_text(rng, n):
    return " ".join(rng.choice(("the", "of", "éa", "KÄ", "ion", "th", "x.", "日本")) + str(rng.randrange(40)) for _ in range(n))


def test_shingles_match_sets():
    rng = random.Random(3)
    texts = ["", " ", "a", "a b c d", " a  b\tc\nd e ", "a b c d e", *(random_text(rng, k) for k in range(0, 60, 7))]
    data, offsets = hashing.buffers(pa.array([*texts, None]))
    which, h = hashing.shingles(data, offsets)
    seen = {}
    for k, t in enumerate([*texts, ""]):
        own = set(h[which == k].tolist())
        assert len(own) == len(shingle_set(t))
        seen[k] = own
    assert seen[4] == seen[5] and seen[0] == seen[1] != seen[2]


def test_likeness_estimates_jaccard():
    rng = random.Random(1)
    errors = []
    for n in (3, 12, 60, 400, 3000):
        for keep in (0.0, 0.5, 0.9, 1.0):
            a = random_text(rng, n)
            w = a.split()
            b = " ".join(w[: int(n * keep)] + random_text(rng, n - int(n * keep)).split())
            bits = fingerprints.packed(fingerprints.minima(pa.array([a, b])))
            A, B = shingle_set(a), shingle_set(b)
            true = len(A & B) / len(A | B)
            got = fingerprints.likeness(bits[:1], bits[1:])[0]
            assert abs(got - true) < 0.2, (n, keep, got, true)
            errors.append(got - true)
            if keep == 1.0:
                assert got == 1.0
    assert abs(np.mean(errors)) < 0.03


def test_neighbours_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(k * 3 % 50, random_text(rng, rng.randrange(30)), "p") for k in range(50)] + [(None, None, "x"), (7, "", None), (7, None, None), (7, "tie 日本", None), (10**12, "last " * 40, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, p string").repartition(4)
    out = fingerprints.compared(docs, ranges=6).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected = []
    for k, (i, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), edited == t, nxt == t))
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in out]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    assert sorted(got, key=key) == sorted([e[:3] for e in expected], key=key)
    same = {e[:3]: e[3:] for e in expected}
    for r in out:
        if same[(r.doc_id, r.n_chars, r.edited_sha256)][0]:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
    whole = {r.fingerprint for r in fingerprints.compared(docs, ranges=1).collect()}
    assert whole == {r.fingerprint for r in out}


def test_empty_table_and_one_row(spark):
    assert fingerprints.compared(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    (row,) = fingerprints.compared(spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1


def test_ids_of_other_types(spark):
    rows = [("a%d" % (k % 7), f"text {k} of the row") for k in range(20)] + [(None, "x"), ("é", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    some = [f"{r.doc_id} {r.edited_sha256}" for r in fingerprints.compared(docs, ranges=5).collect()]
    one = [f"{r.doc_id} {r.edited_sha256}" for r in fingerprints.compared(docs, ranges=1).collect()]
    assert sorted(some) == sorted(one) and len(one) == 22


def test_no_more_ranges_than_shuffle_partitions(spark):
    """Each range is a task that writes a file of its own."""
    docs = spark.createDataFrame([(k, f"text {k} " * 3) for k in range(5000)], "doc_id bigint, text string")
    out = fingerprints.neighbours(docs)
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 1 < out.select("p").distinct().count() <= most
    rows = fingerprints.compared(docs).collect()  # ranges of more rows than are compared at a time
    assert sorted(r.doc_id for r in rows) == list(range(5000))
    expected = fingerprints.packed(fingerprints.minima(pa.array([f"text {k} " * 3 for k in range(5000)])))
    near = fingerprints.likeness(expected, np.roll(expected, -1, axis=0))
    assert all(r.fingerprint == expected[r.doc_id].tobytes().hex() and r.near_next == near[r.doc_id] for r in rows)
